"""How far each partition can be committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def commit_prefix(messages: DataFrame, settled: DataFrame) -> DataFrame:
    """(partition, committed): last offset up to which all messages are of settled polls or malformed.

    The first open offset of a partition is a minimum, and the offset before it a maximum, so no
    partition has to be ordered in one task.
    """
    done = settled.select("poll_id").distinct().withColumn("_ok", F.lit(True))
    rows = messages.join(done, "poll_id", "left").withColumn("_ok", F.col("malformed") | F.coalesce("_ok", F.lit(False)))
    first_open = rows.where("not _ok").groupBy("partition").agg(F.min("offset").alias("first_open"))
    ok = rows.select("partition", "offset").join(first_open, "partition", "left").where("first_open is null or offset < first_open")
    return ok.groupBy("partition").agg(F.max("offset").alias("committed"))


def deltas(running: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``running`` with the increase of a running total since the row before."""
    w = Window.partitionBy(key).orderBy(order)
    return running.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(w))
