"""Votes into batches of a fixed size, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import placed


def batch_numbers(votes: DataFrame, size: int) -> DataFrame:
    """``votes`` with the number of its batch within poll and worker; the last may be short.

    No task orders more of a worker's votes than one range of ``seq``.
    """
    return placed(votes, ["poll_id", "worker_id"], "seq", place="_place").withColumn("batch", F.expr(f"_place div {int(size)}")).drop("_place")


def pack(votes: DataFrame, size: int) -> DataFrame:
    """Batches with their votes in order, then for each poll and worker a last message that says done."""
    vote = F.struct("seq", F.struct("fingerprint", "option_id").alias("vote"))
    rows = batch_numbers(votes, size).groupBy("poll_id", "worker_id", "batch").agg(F.transform(F.array_sort(F.collect_list(vote)), lambda x: x["vote"]).alias("votes"))
    rows = rows.withColumn("done", F.lit(False))
    ends = rows.groupBy("poll_id", "worker_id").agg((F.max("batch") + 1).alias("batch"), F.slice(F.first("votes"), 1, 0).alias("votes")).withColumn("done", F.lit(True))
    return rows.unionByName(ends)


def done_is_last(messages: DataFrame) -> DataFrame:
    """(poll_id, worker_id, ok): whether no message of a worker follows its last word."""
    last = F.max(F.when(F.col("done"), F.col("seq")))
    return messages.groupBy("poll_id", "worker_id").agg((F.coalesce(last == F.max("seq"), F.lit(True))).alias("ok"))
