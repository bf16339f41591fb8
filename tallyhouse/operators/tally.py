"""Counting: the first vote of a fingerprint holds; options without votes have no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_votes(votes: DataFrame, keep_seq: bool = False) -> DataFrame:
    """One row for each poll and fingerprint, with the option of the lowest ``seq``, and that number if it is to be kept.

    The shuffle is by poll and fingerprint, so that a poll with most of all votes is spread, and
    each task sends one row for each such pair at most.
    """
    seq = [F.min("seq").alias("seq")] if keep_seq else []
    return votes.groupBy("poll_id", "fingerprint").agg(F.min_by("option_id", "seq").alias("option_id"), *seq)


def tally(votes: DataFrame) -> DataFrame:
    return first_votes(votes).groupBy("poll_id", "option_id").agg(F.count("*").alias("count"))


def poll_totals(votes: DataFrame) -> DataFrame:
    """Distinct fingerprints of each poll, which is also the number of its votes that count."""
    return tally(votes).groupBy("poll_id").agg(F.sum("count").alias("total"))


def workers(messages: DataFrame) -> DataFrame:
    """Workers seen and done of each poll; nameless ones don't count."""
    name = F.when(F.col("worker_id") != "", F.col("worker_id"))
    one = messages.groupBy("poll_id", name.alias("worker")).agg(F.max(F.col("done").cast("int")).alias("done"))
    return one.groupBy("poll_id").agg(F.count("worker").alias("workers_seen"), F.count(F.when(F.col("done") == 1, F.col("worker"))).alias("workers_done"))


def nested_results(finals: DataFrame) -> DataFrame:
    """(poll_id, results) with the options of a poll, few by nature, as an array by number."""
    options = F.array_sort(F.collect_list(F.struct("option_id", "count")))
    rows = finals.groupBy("poll_id").agg(F.sum("count").alias("total"), options.alias("options"), F.max("workers_seen").alias("workers_seen"), F.max("workers_done").alias("workers_done"))
    return rows.select("poll_id", F.struct("total", "options", "workers_seen", "workers_done").alias("results"))


def snapshot(messages: DataFrame, votes: DataFrame, completed: DataFrame) -> DataFrame:
    """What is known of each poll that has messages, by poll."""
    done = completed.select("poll_id").distinct().withColumn("flushed", F.lit(True))
    rows = workers(messages).join(poll_totals(votes), "poll_id", "left").join(done, "poll_id", "left")
    return rows.select("poll_id", F.coalesce("total", F.lit(0)).alias("total"), "workers_seen", "workers_done", F.coalesce("flushed", F.lit(False)).alias("flushed")).orderBy("poll_id")
