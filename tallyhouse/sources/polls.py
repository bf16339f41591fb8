"""The table of polls and that of final results: creation, look-up, append, conditional write."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FINAL, POLL


def migration_files(folder: str) -> list[str]:
    """SQL files of a folder by name."""
    return sorted(str(p) for p in Path(folder).iterdir() if p.suffix == ".sql" and p.is_file())


def migrate(spark: SparkSession, folder: str | None = None) -> list[str]:
    """Creates the tables, then runs the statements of a folder's files; running it again changes nothing."""
    for name, columns in (("polls", POLL), ("poll_results", FINAL)):
        spark.sql(f"create table if not exists {name} ({columns}) using parquet")
    done = migration_files(folder) if folder else []
    for path in done:
        for statement in filter(None, map(str.strip, Path(path).read_text().split(";"))):
            spark.sql(statement)
    return done


def create_poll(polls: DataFrame, path: str) -> None:
    polls.write.mode("append").parquet(path)


def get_poll(polls: DataFrame, poll_id: str) -> DataFrame:
    """One poll or no row; the predicate reaches the scan."""
    return polls.where(F.col("id") == poll_id)


def public_view(polls: DataFrame) -> DataFrame:
    return polls.drop("results")


def with_results(polls: DataFrame, finals: DataFrame) -> DataFrame:
    """Polls with their nested result; null while there is none."""
    from ..operators.tally import nested_results

    return polls.drop("results", "status").join(nested_results(finals).withColumnRenamed("poll_id", "id"), "id", "left").withColumn("status", F.when(F.col("results").isNull(), "active").otherwise("completed"))
