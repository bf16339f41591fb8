"""Final results, written once in effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(finals: DataFrame, polls: DataFrame, completed: DataFrame) -> DataFrame:
    """(poll_id, outcome) of final polls: written, already_completed or not_found."""
    known = polls.select(F.col("id").alias("poll_id")).distinct().withColumn("_known", F.lit(True))
    done = completed.select("poll_id").distinct().withColumn("_done", F.lit(True))
    rows = finals.select("poll_id").distinct().join(known, "poll_id", "left").join(done, "poll_id", "left")
    return rows.select("poll_id", F.when(F.col("_known").isNull(), "not_found").when(F.col("_done"), "already_completed").otherwise("written").alias("outcome"))


def new_finals(finals: DataFrame, completed: DataFrame) -> DataFrame:
    """Results of polls that have none yet: the first result of a poll stays, late votes change nothing."""
    return finals.join(completed.select("poll_id").distinct(), "poll_id", "left_anti")


def evictable(finals: DataFrame, pending: DataFrame) -> DataFrame:
    """Settled polls without pending messages, whose state can go."""
    return finals.select("poll_id").distinct().join(pending.select("poll_id").distinct(), "poll_id", "left_anti")
