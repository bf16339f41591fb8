"""Mixing sources to target weights by a low-discrepancy schedule of token blocks.

The documents of a source, shuffled by a hash, are one stream of tokens, cut into blocks of
equal length.  Slots of the schedule are the points ``i * golden ratio mod 1``, mapped to
sources through the cumulative targets; the r-th slot of a source takes block
``r mod blocks`` of it.  Slots beyond the source's quota are left out and the slot at its end is
cut; a source that the points reach too seldom gets the missing slots at the end, so
each source gives its quota exactly.  All of it is DataFrame operations; running sums go by
three levels of hash prefixes, so that no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Tokens of a block, at least; longer where more than MOST_SLOTS slots would be needed.
BLOCK_TOKENS = 64
MOST_SLOTS = 1 << 26
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
_CHUNK = 4096
_ONE = 10**18
#: Golden ratio's fraction in units of 1/_ONE.
_GOLDEN = 618033988749894848
_GRID = 4096


def count_words(text):
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with place (0.. by code point, null last) and target.

    Targets share the sum of sizes by weight; those above ``most`` times their size stop there
    and the rest is shared again: target = min(most * size, level * weight) for the one level
    at which they add up.  Sources are ordered by the level at which they stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = s.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * most})
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after).cast("double")
    s = s.withColumns({"level": level, "order": F.row_number().over(by_stop)})
    s = s.withColumn("stops", F.col("cap").cast("double") <= F.col("level") * F.col("weight"))
    free = F.min_by(F.col("level"), F.when(~F.col("stops"), F.col("order"))).over(everything)
    some = F.min(F.when(~F.col("stops"), F.col("order"))).over(everything)
    s = s.withColumns({"first_free": some, "free_level": free})
    capped = F.col("first_free").isNull() | (F.col("order") < F.col("first_free"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("free_level") * F.col("weight"))
    return s.select("source", "source_size", "place", target.alias("target"))


def _starts(rows: DataFrame) -> DataFrame:
    """``rows`` (place, hash, id, size) with the token at which each begins in its source's stream."""
    rows = rows.withColumns({"p1": F.substring("hash", 1, 2), "p2": F.substring("hash", 3, 2)})
    second = rows.groupBy("place", "p1", "p2").agg(F.sum("size").alias("s"))
    first = second.groupBy("place", "p1").agg(F.sum("s").alias("s"))

    def running(df, keys, by):
        w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("s").over(w), F.lit(0))

    first = first.select("place", "p1", running(first, ["place"], "p1").alias("at1"))
    second = second.select("place", "p1", "p2", running(second, ["place", "p1"], "p2").alias("at2"))
    at = second.join(first, ["place", "p1"]).select("place", "p1", "p2", (F.col("at1") + F.col("at2")).alias("at"))
    inside = Window.partitionBy("place", "p1", "p2").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_group", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(at, ["place", "p1", "p2"]).select("place", "id", "size", (F.col("at") + F.col("in_group")).alias("start"))


def schedule(sources: DataFrame, block: int, total: int, count: int) -> DataFrame:
    """(slot, place, rank): which block of which source comes when.

    ``sources`` has place, target, slots (that each needs).  A slot of null number is one of those
    that are added at the end.
    """
    spark = sources.sparkSession
    n = -(-total // block) + 4 * count
    point = F.pmod(F.col("id").cast("decimal(19,0)") * F.lit(_GOLDEN).cast("decimal(18,0)"), F.lit(_ONE).cast("decimal(19,0)")).cast("long")
    points = spark.range(1, n + 1).select(F.col("id").alias("slot"), point.alias("point"))
    until = F.sum("target").over(Window.orderBy("place"))
    share = sources.withColumn("high", F.round(until / F.lit(float(max(total, 1))) * _ONE).cast("long"))
    share = share.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("place")), F.lit(0)))
    width = _ONE // _GRID + 1
    cells = share.where("high > low").select("place", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    hit = points.withColumn("cell", F.expr(f"point div {width}")).join(cells, "cell").where("point >= low and point < high")
    hit = hit.select("slot", "place", F.expr(f"slot div {_CHUNK}").alias("chunk"))
    ranked = hit.withColumn("in_chunk", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1)
    chunks = hit.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("place", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), "n")
    reached = chunks.groupBy("place").agg(F.sum("n").alias("reached"))
    ranked = ranked.join(chunks.drop("n"), ["place", "chunk"]).select("slot", "place", (F.col("earlier") + F.col("in_chunk")).alias("rank"))
    ranked = ranked.join(sources.select("place", "slots"), "place").where("rank < slots").drop("slots")
    missing = sources.join(reached, "place", "left").select("place", F.coalesce("reached", F.lit(0)).alias("reached"), "slots").where("reached < slots")
    missing = missing.select(F.lit(None).cast("long").alias("slot"), "place", F.explode(F.sequence("reached", F.col("slots") - 1)).alias("rank"))
    return ranked.unionByName(missing)


def mix_sources(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", weights: tuple = WEIGHTS, most: int = MOST_REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per row of ``docs``: id, size (words), source_size, target (of its source), taken (words), first_slot.

    ``first_slot`` is the place of the schedule at which a document first comes, so that the mix in the
    order of slots has every source in its share all along; null if it doesn't come, or only in the slots added at the end.

    A null source is a source of its own; a null text has size 0 and taken 0.  Rows that repeat an
    id are documents of their own.  Order within a source is by md5 of the id, then id and size; a rerun
    gives the same.  An empty table gives an empty result.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col).cast("string")).alias("size"))
    docs = written(docs.withColumn("hash", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))), "sizes")
    sources = written(source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "sources")
    total, count = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    block = max(block_tokens, -(-total // MOST_SLOTS))

    quota = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most)
    plan = sources.withColumn("quota", quota).withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    slots = F.expr(f"case when source_size = 0 then 0 else (quota div source_size) * blocks + (quota % source_size + {block - 1}) div {block} end")
    plan = plan.withColumn("slots", slots)
    slot = schedule(plan.select("place", "target", "slots"), block, total, count).join(plan.select("place", "source_size", "quota", "blocks"), "place")
    slot = slot.withColumns({"block": F.expr("rank % blocks"), "past": F.expr(f"(rank div blocks) * source_size + (rank % blocks) * {block}")})
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    slot = slot.select("place", "block", "slot", length.alias("length"), F.least(length, F.col("quota") - F.col("past")).alias("takes"))
    uncut = F.col("takes") == F.col("length")
    slot = slot.groupBy("place", "block").agg(
        F.count_if(uncut).alias("whole"), F.max(F.when(~uncut, F.col("takes")).otherwise(0)).alias("part"),
        F.min(F.when(uncut, F.col("slot"))).alias("whole_slot"), F.min(F.when(~uncut, F.col("slot"))).alias("part_slot"),
    )

    known = docs.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    placed = _starts(known.select("place", "hash", "id", "size"))
    placed = placed.select("place", "id", "size", "start")
    pieces = placed.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    first = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    last = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.withColumns({"a": first, "b": last}).join(slot, ["place", "block"])
    got = F.col("whole") * (F.col("b") - F.col("a")) + F.greatest(F.least("b", "part") - F.col("a"), F.lit(0))
    came = F.least("whole_slot", F.when(F.col("part") > F.col("a"), F.col("part_slot")))
    taken = pieces.groupBy("place", "start").agg(F.sum(got).alias("taken"), F.min(came).alias("first_slot"))
    out = placed.join(taken, ["place", "start"], "left").join(sources, "place")
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "first_slot")
