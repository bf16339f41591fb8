"""How many cookies an address may get for a poll."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def issue_limit(requests: DataFrame, limit: int, slack: str = "interval 10 minutes") -> DataFrame:
    """``requests`` (poll_id, ip_hash, ts, seq, ends_at) without cookies, with issued.

    The first ``limit`` of a poll and address get one; all do if the limit is 0 or less, and after
    the end of the poll plus ``slack``.  Each task keeps ``limit`` requests of an address before they are sent, so
    an address of very many is nowhere ordered as a whole; its last one that gets a cookie is what all are compared with.
    """
    if limit <= 0:
        return requests.withColumn("issued", F.lit(True))
    keys = ["poll_id", "ip_hash"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "seq"))
    first = requests.select(*keys, "ts", "seq").withColumn("_rank", rank).where(F.col("_rank") <= limit)
    last = first.groupBy(*keys).agg(F.max(F.struct("ts", "seq")).alias("_last"), F.count("*").alias("_n"))
    last = last.where(F.col("_n") == limit).select(*[F.col(k).alias(f"_{k}") for k in keys], "_last")
    own = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = requests.join(last, own, "left")  # addresses with fewer requests have no last one
    issued = F.col("_last").isNull() | (F.struct("ts", "seq") <= F.col("_last")) | F.coalesce(F.col("ts") > F.col("ends_at") + F.expr(slack), F.lit(False))
    return rows.withColumn("issued", issued).drop("_last", *[f"_{k}" for k in keys])


def issue_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("poll_id", "ip_hash").agg(F.count("*").alias("requests"))


def newest_entries(entries: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries (key, first_seen) that came last: what a bounded first-in-first-out store keeps."""
    return entries.orderBy(F.desc("first_seen"), F.desc("key")).limit(most)
