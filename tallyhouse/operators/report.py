"""Checks and figures of a run: accepted against counted, percentiles, rates, load profiles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import floor_rank, load_share


def reconcile(accepted: DataFrame, counted: DataFrame) -> DataFrame:
    """``accepted`` (poll_id, accepted) against ``counted`` (poll_id, total), with a verdict."""
    rows = accepted.join(counted, "poll_id", "left")
    gap = F.col("total") - F.col("accepted")
    verdict = F.when(F.col("total").isNull(), "NO RESULT").when(gap < 0, F.concat(F.lit("LOST "), (-gap).cast("string"))).when(gap > 0, F.concat(F.lit("+"), gap.cast("string"), F.lit(" unconfirmed"))).otherwise("OK")
    return rows.select("poll_id", "accepted", F.col("total").alias("counted"), verdict.alias("verdict"), (gap.isNull() | (gap < 0)).alias("failed"))


def percentiles(values: DataFrame, key: str, value: str, shares: dict[str, float], ranges: int = 128) -> DataFrame:
    """For each key the value of rank floor(p * (n - 1)); exact.

    Values are counted in ranges, cut at approximate quantiles of their key; only the ranges that hold a wanted rank are
    ordered, so no task orders a key.  A key's bounds are ``ranges`` numbers at most.
    """
    rows = values.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    cuts = rows.groupBy(key).agg(F.array_distinct(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 20 * ranges)).alias("_cuts"))
    cut = rows.groupBy(key, "_v").agg(F.count("*").alias("_n")).join(cuts.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")))
    cut = cut.select(key, "_v", "_n", F.aggregate("_cuts", F.lit(0), lambda a, c: a + (c < F.col("_v")).cast("int")).alias("_range"))
    counts = cut.groupBy(key, "_range").agg(F.sum("_n").alias("_in"), F.max("_v").alias("_top"))
    upto, every = Window.partitionBy(key).orderBy("_range"), Window.partitionBy(key)
    placed = counts.withColumns({"_before": F.sum("_in").over(upto) - F.col("_in"), "n": F.sum("_in").over(every), "highest": F.max("_top").over(every)})
    rank = lambda p: floor_rank(F.col("n"), p)
    holds = lambda p: (F.col("_before") <= rank(p)) & (rank(p) < F.col("_before") + F.col("_in"))
    wanted = placed.where(reduce(or_, map(holds, shares.values()))).select(F.col(key).alias("_key"), F.col("_range").alias("_of"), "_before", "n", "highest")
    near = cut.join(wanted, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    near = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(key, "_range").orderBy("_v")))
    picks = [F.max(F.when((F.col("_upto") > rank(p)) & (F.col("_upto") - F.col("_n") <= rank(p)), F.col("_v"))).alias(name) for name, p in shares.items()]
    return near.groupBy(key).agg(F.first("n").alias("n"), *picks, F.first("highest").alias("highest"))


def throughput(rows: DataFrame, at: str, width: str) -> DataFrame:
    """Rows in each tumbling window that has any."""
    return rows.groupBy(F.window(at, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def mean_rate(rows: DataFrame, at: str) -> DataFrame:
    """Rows a second from first to last."""
    seconds = (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / F.lit(1e6)
    return rows.agg(F.count("*").alias("n"), F.when(seconds > 0, F.count("*") / seconds).otherwise(0.0).alias("rate"))


def load_profile_of(targets: DataFrame, key: str, target: str, ticks: int) -> DataFrame:
    """(key, tick, want, launch): of each target the part begun by each tick, from 1, and the part begun at it.

    A tick's part before is computed, not looked up, so rows are independent.
    """
    share = lambda tick: F.floor(F.col(target) * load_share(tick / F.lit(float(ticks)))).cast("bigint")
    rows = targets.select(key, target, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(ticks).cast("bigint"))).alias("tick"))
    return rows.select(key, "tick", share(F.col("tick")).alias("want"), (share(F.col("tick")) - share(F.col("tick") - 1)).alias("launch"))


def rolled_up(rates: DataFrame, run: str, rate: str) -> DataFrame:
    """(runs, lowest, median, highest) of the summed rates of each run's clients."""
    each = rates.groupBy(run).agg(F.sum(rate).alias("_rate"))
    return each.agg(F.count("*").alias("runs"), F.min("_rate").alias("lowest"), F.median("_rate").alias("median"), F.max("_rate").alias("highest"))


def option_of(seq: Column, options: int) -> Column:
    return F.pmod(seq, F.lit(options)) + 1


def labelled_counts(polls: DataFrame, finals: DataFrame) -> DataFrame:
    """Every option of each poll with its text and count; 0 where nobody voted for it."""
    options = polls.select(F.col("id").alias("poll_id"), F.explode("options").alias("o")).select("poll_id", F.col("o.id").cast("bigint").alias("option_id"), F.col("o.text").alias("text"))
    rows = options.join(finals.select("poll_id", "option_id", "count"), ["poll_id", "option_id"], "left")
    return rows.select("poll_id", "option_id", "text", F.coalesce("count", F.lit(0)).alias("count"))
