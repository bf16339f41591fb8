"""The vote domain over the test table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECRET = b"not a secret"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vote for each event: poll of its day, voter of its user, option of its properties."""
    return votes_of_events(events(spark, sf_dir))


def votes_of_events(rows: DataFrame) -> DataFrame:
    option = F.get_json_object("props", "$.k").cast("bigint") % 4 + 1
    return rows.select(
        F.date_format("ts", "yyyy-MM-dd").alias("poll_id"),
        F.col("user_id").cast("string").alias("fingerprint"),
        option.alias("option_id"),
        F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("worker_id"),
        F.col("event_id").alias("seq"),
        "ts",
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll for each day with events: options 1 to 3, open until 20:00."""
    day = F.col("ts").cast("date")
    options = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(f"option {i}").alias("text")) for i in (1, 2, 3)])
    days = events(spark, sf_dir).select(day.alias("day")).distinct()
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("id"), options.alias("options"), (F.col("day").cast("timestamp_ntz") + F.expr("interval 20 hours")).alias("ends_at"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each vote; of each poll's workers w0 and w1 the last one says done, and so does w2's on even days."""
    v = votes(spark, sf_dir)
    last = v.groupBy("poll_id", "worker_id").agg(F.max("seq").alias("seq"))
    speaks = (F.col("worker_id") != "w2") | (F.substring("poll_id", 9, 2).cast("int") % 2 == 0)
    ends = last.where(speaks).withColumn("_done", F.lit(True))
    return v.join(ends, ["poll_id", "worker_id", "seq"], "left").withColumn("done", F.coalesce("_done", F.lit(False))).drop("_done")
