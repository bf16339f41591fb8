"""When a poll is final: quorum of workers, silence, or a hard timeout, never before the grace is over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numeric import quorum
from .tally import workers


def stale_counts(messages: DataFrame, mode: str = "code") -> DataFrame:
    """Messages of other polls that each poll has seen go by: (poll_id, stale).

    ``messages`` has poll_id and a dense number ``seq`` of well-formed messages from 0 of one consumer.
    ``code``: all since the poll's first message; ``spec``: only those since its last.
    """
    total = messages.agg(F.count("*").alias("total"))
    own = messages.groupBy("poll_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("own"))
    return own.join(F.broadcast(total)).select("poll_id", silence(F.col("total"), mode).alias("stale"))  # one row


def silence(total: Column, mode: str) -> Column:
    """Messages that went by, from a poll's columns first, last (numbers of its messages) and own (how many they are)."""
    return total - 1 - F.col("first") - (F.col("own") - 1) if mode == "code" else total - 1 - F.col("last")


def deadlines(seen: DataFrame, polls: DataFrame, config: Config) -> DataFrame:
    """End of each seen poll; one that isn't known ends a hard timeout after its first message."""
    hard = F.expr(f"interval {config.hard_timeout} seconds")
    rows = seen.groupBy("poll_id").agg(F.min("arrived").alias("first_seen"))
    known = polls.select(F.col("id").alias("poll_id"), "ends_at")
    return rows.join(known, "poll_id", "left").select("poll_id", F.coalesce("ends_at", F.col("first_seen") + hard).alias("ends_at"), F.col("ends_at").isNotNull().alias("known"))


def judge(summary: DataFrame, ends: DataFrame, now: Column, config: Config) -> DataFrame:
    """``summary`` (poll_id, workers_seen, workers_done, stale) with reason, which is null while the poll goes on.

    Hard timeout goes before silence, and silence counts only without a quorum.  ``ends`` has poll_id and ends_at.
    """
    rows = summary.join(ends.select("poll_id", "ends_at"), "poll_id")
    after = lambda s: now >= F.col("ends_at") + F.expr(f"interval {s} seconds")
    enough = (F.col("workers_seen") > 0) & (F.col("workers_done") >= quorum(F.col("workers_seen"), config.done_percent))
    reason = (
        F.when(~after(config.close_grace), None)
        .when(after(config.hard_timeout), "hard_timeout")
        .when(~enough & (F.col("stale") >= config.stale_messages), "stale")
        .when(enough, "quorum")
    )
    return rows.select("poll_id", "workers_seen", "workers_done", "stale", reason.alias("reason"))


def completion(messages: DataFrame, ends: DataFrame, now: Column, config: Config) -> DataFrame:
    """(poll_id, workers_seen, workers_done, stale, reason) of ``messages`` (poll_id, worker_id, done, seq)."""
    return judge(workers(messages).join(stale_counts(messages, config.stale_mode), "poll_id"), ends, now, config)


def numbered(messages: DataFrame, order: str, *groups: str) -> DataFrame:
    """``messages`` with a dense ``seq`` from 0: by ``groups`` (say micro-batch and partition), inside a group by ``order``.

    Messages are ordered inside their group only; of the groups one count each is ordered.
    """
    counts = messages.groupBy(*groups).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(order)) - 1
    return messages.withColumn("_place", place).join(starts, list(groups)).withColumn("seq", F.col("_start") + F.col("_place")).drop("_start", "_place")
