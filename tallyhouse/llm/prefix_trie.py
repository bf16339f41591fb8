"""Trie of conversations by prefix-doubling names.

Turns are level 0.  Equal blocks of 2**k turns get one dense number each (``dense_names``): a block of
level k+1 is the pair of names of its halves, so that every level takes one round of grouping,
numbering and joining back, and the longest conversation of n turns takes about log2(n) rounds.
Only blocks that begin at a multiple of their length are named, which are twice as many as turns at most.

A prefix of d turns is the prefix without its last block (d with its lowest bit cleared) and that
block.  Prefixes are named by how many bits d has, again a logarithmic number of rounds; the
name of a prefix is the smallest conversation that has it, which with d tells the node.

Sums over subtrees come from conversations: a node's subtree is what its members still say,
so every row carries a sum of the rest of its conversation, and a node adds those of its members.

Keys that many rows share (an opening turn of a third of all conversations) are joined by
broadcast: those with at least one row in ``HOT`` of all, so ``HOT`` keys at most; all others have fewer rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import placed
from .scratch import partitions, written

#: Keys with one row in so many are joined by broadcast: so many keys at most.
HOT = 1000
#: Turns of a conversation whose rest is added up in one piece.
PIECE = 1024
#: Ids of one piece of a list that is hashed.
IDS = 256
_WORDS = "[^\\x20\\x09-\\x0D]+"


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key, ``n`` the number of rows that have it)."""
    total = table.agg(F.sum(n)).first()[0] or 0
    hot, cold = F.broadcast(table.where(F.col(n) * HOT >= total).drop(n)), table.where(F.col(n) * HOT < total).drop(n)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))


def dense_names(counts: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """``counts`` (distinct keys) with numbers from 0 without gaps, for equal keys the same.

    Keys are dealt to buckets by hash, numbered in each, and each bucket starts where the ones before end.
    """
    spark = counts.sparkSession
    dealt = written(counts.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(partitions(spark)))), "keys")
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_size"))  # a row for each bucket
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)) - 1
    return dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_bucket").withColumn(name, F.col("_start") + F.col("_inside")).drop("_bucket", "_inside", "_start")


def _named(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """``rows`` with the dense name of their keys in place of these."""
    names = written(dense_names(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys), f"{tag}-names")
    return written(looked_up(rows, names, keys).drop(*keys), tag)


def turn_blocks(turns: DataFrame) -> DataFrame:
    """Names of aligned blocks: (conv_id, level, j, name) for the turns j*2**level to (j+1)*2**level - 1.  ``turns`` has conv_id, place, key."""
    level = _named(turns.select("conv_id", F.col("place").alias("j"), "key"), ["key"], "level0")
    longest = turns.agg(F.max("place")).first()[0]
    found = level.withColumn("level", F.lit(0))
    for k in range(1, 0 if longest is None else int(longest + 1).bit_length()):
        half = F.col("j") % 2
        pairs = level.groupBy("conv_id", F.expr("j div 2").alias("j")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"))
        level = _named(pairs.where("right is not null"), ["left", "right"], f"level{k}")
        found = found.unionByName(level.withColumn("level", F.lit(k)))
    return found


def prefix_names(blocks: DataFrame) -> DataFrame:
    """(conv_id, depth, top): the smallest conversation with the same first ``depth`` turns."""
    even = blocks.where("j % 2 = 0")
    size = F.expr("shiftleft(1L, level)")
    steps = even.select("conv_id", ((F.col("j") + 1) * size).alias("depth"), (F.col("j") * size).alias("before"), "name").withColumn("bits", F.bit_count("depth"))
    steps = written(steps, "steps")
    most = steps.agg(F.max("bits")).first()[0] or 0
    found = before = None
    for bits in range(1, most + 1):
        own = steps.where(F.col("bits") == bits).drop("bits")
        if before is None:
            own = own.withColumn("head", F.lit(None).cast("long"))
        else:
            own = own.join(before.select("conv_id", F.col("depth").alias("before"), F.col("top").alias("head")), ["conv_id", "before"])
        own = written(own.select("conv_id", "depth", F.coalesce("head", F.lit(0).cast("long")).alias("head"), "name"), "heads")
        tops = written(own.groupBy("depth", "head", "name").agg(F.count("*").alias("n"), F.min("conv_id").alias("top")), "tops")
        before = written(looked_up(own, tops, ["depth", "head", "name"]).select("conv_id", "depth", "top"), "prefixes")
        # later rounds look back at any depth with fewer bits by one, so only the last round's are needed
        found = before if found is None else found.unionByName(before)
    return found


def _hash_pieces(batches):
    """SHA-256 of each node's ids; pieces come by node and in order, one node after another."""
    now, digest = None, None
    for batch in batches:
        out = []
        for top, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("top", "depth", "ids"))):
            if (top, depth) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (top, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _digests(out)
    if now is not None:
        yield _digests([(*now, digest.hexdigest())])


def _digests(rows):
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["top", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(top, depth, ends_sha256) of the conversations that end at each node: ``ends`` has conv_id, top, depth.

    Ids are ordered and joined in pieces of ``IDS``, whatever the size of a node; a node's pieces are hashed as a stream, as
    SHA-256 is a chain: one task reads a node's pieces in order and holds one batch of them.
    """
    ranked = placed(ends, ["top", "depth"], "conv_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ranked.groupBy("top", "depth", F.expr(f"place div {IDS}").alias("piece")).agg(ids.alias("ids"))
    ordered = pieces.repartition("top", "depth").sortWithinPartitions("top", "depth", "piece")
    return ordered.select("top", "depth", "ids").mapInArrow(_hash_pieces, "top long, depth long, ends_sha256 string")


def rests(rows: DataFrame, *values: str) -> DataFrame:
    """``rows`` (conv_id, depth, ...) with each value added up from its depth to the end of the conversation.

    Sums run inside pieces of ``PIECE`` turns; what later pieces add comes from their totals.
    """
    cut = rows.withColumn("_piece", F.expr(f"depth div {PIECE}"))
    totals = cut.groupBy("conv_id", "_piece").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    later = Window.partitionBy("conv_id").orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "_piece", *[F.coalesce(F.sum(f"_{v}").over(later), F.lit(0)).alias(f"_{v}") for v in values])
    own = Window.partitionBy("conv_id", "_piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({v: F.sum(v).over(own) for v in values}).join(totals, ["conv_id", "_piece"])
    return summed.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_piece", *[f"_{v}" for v in values])


def placed_turns(turns: DataFrame) -> DataFrame:
    """Turns with their place in their conversation from 0: by turn (null first), then role, then text.  Null roles and texts become empty."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return placed(rows, ["conv_id"], "turn", "role", "text").drop("turn")


def conversation_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of all conversations, from the root of no turn: one row for each distinct prefix.

    ``turns`` has conv_id, place (from 0 without gaps), role, text; ``conversations`` has every conv_id once, those without turns too.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (words that members but one say again, summed over the subtree) and ends_sha256 (of the ids of the
    members that end there).  Without conversations there is no node, not even a root; rows with a null conv_id
    take no part; other columns are ignored.
    """
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    words = F.regexp_count("text", F.lit(_WORDS)).cast("long")
    rows = written(turns.select("conv_id", F.col("place").cast("long"), key.alias("key"), words.alias("words")), "turns")
    convs = written(conversations.select(F.col("conv_id").cast("long")).where("conv_id is not null"), "conversations")
    first, every = convs.agg(F.min("conv_id"), F.count("*")).first()
    names = prefix_names(turn_blocks(rows))
    lengths = rows.groupBy("conv_id").agg(F.count("*").alias("length"))
    if names is None:
        names = convs.sparkSession.createDataFrame([], "conv_id long, depth long, top long")
    said = rows.select("conv_id", (F.col("place") + 1).alias("depth"), "words")
    last = lengths.select("conv_id", F.col("length").alias("depth"), F.lit(1).alias("last"))
    path = written(names.join(said, ["conv_id", "depth"]).join(last, ["conv_id", "depth"], "left").withColumn("last", F.coalesce("last", F.lit(0))), "path")
    silent = convs.join(lengths, "conv_id", "left_anti")
    members = written(path.groupBy("top", "depth").agg(F.count("*").alias("n_convs"), F.sum("last").alias("n_ends")), "members")
    # a leaf's smallest member ends there, and stands for it
    leaves = members.where("n_convs = n_ends").select(F.col("top").alias("conv_id"), "depth", F.lit(1).cast("long").alias("leaf"))
    spoken = path.join(leaves, ["conv_id", "depth"], "left").select("conv_id", "depth", "top", F.coalesce("leaf", F.lit(0)).alias("leaves"), F.when(F.col("top") != F.col("conv_id"), F.col("words")).otherwise(0).alias("saved"))
    sums = written(rests(spoken, "leaves", "saved"), "sums")
    nodes = sums.groupBy("top", "depth").agg(F.count("*").alias("n_convs"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    # the parent is found on the path of the node's smallest member
    own = path.where("top = conv_id").select("top", "depth")
    up = path.select(F.col("conv_id").alias("top"), (F.col("depth") + 1).alias("depth"), F.col("top").alias("parent"))
    tree = written(own.join(up, ["top", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(first))), "tree")
    children = tree.groupBy(F.col("parent").alias("top"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = path.where("last = 1").select("conv_id", "top", "depth").unionByName(silent.select("conv_id", F.lit(first).alias("top"), F.lit(0).cast("long").alias("depth")))
    root = sums.where("depth = 1").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = root.select(F.lit(first).cast("long").alias("top"), F.lit(0).cast("long").alias("depth"), F.lit(every).cast("long").alias("n_convs"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"))
    out = nodes.join(tree, ["top", "depth"]).unionByName(root.where("n_convs > 0").withColumn("parent", F.lit(None).cast("long")))
    out = out.join(children, ["top", "depth"], "left").join(ends_digests(ends), ["top", "depth"], "left")
    return out.select(
        F.col("top").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that share openings: the first h turns of conversation c - c % ``group``, then the own ones after the first h.

    h is the unsigned crc32 of the id in decimal, modulo ``most``.  An id of a turn without a number is ordered first.
    """
    rows = written(placed_turns(turns), "placed")
    lengths = written(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    own = F.crc32(F.col("conv_id").cast("string")) % most
    convs = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("source"), own.alias("h"), "n")
    heads = rows.where(F.col("place") < most - 1).where(F.col("conv_id") % group == 0)
    head = convs.select("conv_id", "source", "h").join(heads.withColumnRenamed("conv_id", "source"), "source").where("place < h").select("conv_id", "place", "role", "text")
    taken = convs.join(lengths.select(F.col("conv_id").alias("source"), F.col("n").alias("have")), "source", "left")
    shift = taken.select("conv_id", "n", "h", (F.least("h", F.coalesce("have", F.lit(0))) - F.col("h")).alias("shift"))
    tail = looked_up(rows, shift, ["conv_id"]).where("place >= h").select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "role", "text")
    return head.unionByName(tail), lengths.select("conv_id")
