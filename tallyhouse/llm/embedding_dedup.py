"""Embedding near-duplicates: int8 tile products with error bounds.

Each vector v of unit length is coded as int8 codes q with scale s, and with the norm e of
what rounding lost: v = s*q + r, |r| <= e.  For two vectors

    |v.w - s*t*(q.p)| <= e_v * |t*p| + e_w * |s*q| + e_v * e_w,

so pairs whose estimate plus bound is below the threshold are out, and only the others are
computed again in double precision.  Estimate and bound are one product of rows in float32, with
two columns more for the bound; what float32 rounds is allowed for.

Equal vectors become one class first, and classes are packed into blocks, a row for each.  Tiles are
pairs of blocks out of a Cartesian product, which reads the blocks again where it needs them and
shuffles nothing, so disk grows with the vectors and not with the tiles.  Work is that of all pairs.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .scratch import partitions, written

#: Vectors of a block, about, and their numbers; a tile multiplies two blocks.
BLOCK, BLOCK_NUMBERS = 4096, 1 << 18
#: Partitions of blocks, at most.
MOST_PARTITIONS = 20_000
#: Blocks that a task keeps coded.
KEPT = 16


def _prepared(batches, packed=False):
    """Key of each vector that takes part, null for the others; and its numbers as bytes, of float32 if none changes by that."""
    for batch in batches:
        keys, widths, vectors = [], [], []
        for v in batch.column("vector").to_pylist():
            x = None if v is None or not v or None in v else np.array(v, np.float64) + 0.0  # -0.0 becomes 0.0
            if x is None or not np.isfinite(x).all() or not x.any():
                keys.append(None)
                widths.append(None)
                vectors.append(None)
                continue
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            if packed:
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                widths.append(len(x))
                vectors.append((short if (short == x).all() else x).tobytes())
        columns = {"id": batch.column("id"), "key": pa.array(keys, pa.binary())}
        if packed:
            columns |= {"width": pa.array(widths, pa.int32()), "vector": pa.array(vectors, pa.binary())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that neither squares of large nor of tiny numbers are lost."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the coded vectors, norms of the remainders (rounded up)."""
    scale = np.maximum(np.abs(v).max(axis=1), np.finfo(float).tiny) / 127
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.sqrt((coded**2).sum(axis=1)) * (1 + 1e-12), np.sqrt(((v - coded) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-15


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products with the other form are estimate plus bound: e_v*(|t*p| + e_w) + e_w*|s*q| is a sum of two terms."""
    codes, scale, norm, lost = quantise(v)
    rows = codes * scale[:, None]
    return np.column_stack([rows, lost, norm]).astype(np.float32), np.column_stack([rows, norm + lost, lost]).astype(np.float32)


def _close(v: np.ndarray, left: np.ndarray, w: np.ndarray, right: np.ndarray, least: float):
    """Indexes of pairs of rows with cosine ``least`` or more, for some rows of ``v`` at a time."""
    floor = np.float32(least - left.shape[1] * 2.0**-22 - 1e-6)
    for a in range(0, len(v), 512):
        near = left[a : a + 512] @ right.T >= floor
        if not near.any():
            continue
        i, j = np.nonzero(near)
        keep = np.zeros(len(i), bool)
        step = max(1, 4_000_000 // v.shape[1])
        for b in range(0, len(i), step):
            c = slice(b, b + step)
            keep[c] = np.einsum("ij,ij->i", v[a + i[c]], w[j[c]]) >= least
        yield a + i[keep], j[keep]


def close_pairs(v: np.ndarray, w: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs of rows with cosine ``least`` or more."""
    found = list(_close(v, coded(v)[0], w, coded(w)[1], least)) or [(np.zeros(0, np.int64),) * 2]
    return tuple(np.concatenate(x) for x in zip(*found))


BLOCKS = "block long, width int, ids binary, keys binary, weights binary, vectors binary"


def _packed(rows: int):
    """Rows put together as blocks of one width."""

    def run(batches):
        waiting, at = {}, TaskContext.get().partitionId() << 32

        def block(width):
            nonlocal at
            at += 1
            ids, keys, weights, vectors = zip(*waiting.pop(width))
            short = all(len(v) == 4 * width for v in vectors)
            numbers = b"".join(vectors) if short else b"".join(np.frombuffer(v, np.float32 if len(v) == 4 * width else np.float64).astype(np.float64).tobytes() for v in vectors)
            packed = (at, width, np.array(ids, np.int64).tobytes(), b"".join(keys), np.array(weights, np.int64).tobytes(), numbers)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(packed, (pa.int64(), pa.int32(), *[pa.binary()] * 4))], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for width, *row in zip(*(batch.column(c).to_pylist() for c in ("width", "id", "key", "weight", "vector"))):
                waiting.setdefault(width, []).append(row)
                if len(waiting[width]) >= max(16, min(rows, BLOCK_NUMBERS // width)) * 5 // 4:
                    yield block(width)
        for width in list(waiting):
            yield block(width)

    return run


class _Blocks:
    """The blocks that a task meets, as nodes of one forest, and the last of them coded."""

    def __init__(self):
        self.start, self.kept, self.ids, self.keys, self.forest = {}, {}, [], [], Forest(0)

    def get(self, block: int, width: int, ids: bytes, keys: bytes, weights: bytes, vectors: bytes):
        """(first node, ids, weights, unit vectors, both coded forms)"""
        if block not in self.start:
            self.start[block] = len(self.forest.up)
            self.forest.up.extend(range(len(self.forest.up), len(self.forest.up) + len(ids) // 8))
            self.ids.append(np.frombuffer(ids, np.int64))
            self.keys.append(np.frombuffer(keys, "V16"))
        if block not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.pop(next(iter(self.kept)))
            numbers = np.frombuffer(vectors, np.float32 if len(vectors) == len(ids) // 8 * width * 4 else np.float64)
            v = unit(numbers.reshape(-1, width).astype(np.float64))
            self.kept[block] = (np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64), v, *coded(v))
        return (self.start[block], *self.kept[block])

    def union(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Joins nodes; returns those of the pairs that joined something."""
        find, edges = self.forest.find, []
        _, first = np.unique(i, return_index=True)  # a pair of each node first, which leaves few roots
        for p, q in ((i[first], j[first]), (i, j)):
            nodes, at = np.unique(np.concatenate([p, q]), return_inverse=True)
            root = np.fromiter((find(x) for x in nodes.tolist()), np.int64, len(nodes))[at]
            a, b = root[: len(p)], root[len(p) :]
            apart = np.flatnonzero(a != b)
            _, once = np.unique(np.stack([a[apart], b[apart]]), axis=1, return_index=True)
            once = apart[once]
            edges += [(x, y) for x, y in zip(p[once].tolist(), q[once].tolist()) if self.forest.union(x, y)]
        return edges


def _tiles(least: float):
    """Links of the pairs of blocks of a task: (0, a, b) of a spanning forest and (1, id, links) with the key of the vector."""

    def run(batches):
        blocks, links, edges = _Blocks(), np.zeros(0, np.int64), []
        for batch in batches:
            for r in range(batch.num_rows):
                one, other = ([column[r].as_py() for column in batch.columns[k : k + 6]] for k in (0, 6))
                x, ids_x, weight_x, v, left, _ = blocks.get(*one)
                y, ids_y, weight_y, w, _, right = blocks.get(*other)
                links = np.concatenate([links, np.zeros(len(blocks.forest.up) - len(links), np.int64)])
                for i, j in _close(v, left, w, right, least):
                    use = (ids_x[i] != ids_y[j]) & ((i < j) | (x != y))  # an id may have several vectors
                    i, j = i[use], j[use]
                    if len(i):
                        links[x : x + len(v)] += np.bincount(i, weight_y[j], len(v)).astype(np.int64)
                        links[y : y + len(w)] += np.bincount(j, weight_x[i], len(w)).astype(np.int64)
                        edges += blocks.union(x + i, y + j)
        if edges or links.any():
            ids, keys, seen = np.concatenate(blocks.ids), np.concatenate(blocks.keys), np.flatnonzero(links)
            ends = np.array(edges, np.int64).reshape(-1, 2)
            a, b = np.concatenate([ids[ends[:, 0]], ids[seen]]), np.concatenate([ids[ends[:, 1]], links[seen]])
            key = pa.array([None] * len(ends) + [k.tobytes() for k in keys[seen]], pa.binary())
            kind = pa.array(np.repeat([0, 1], [len(ends), len(seen)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([kind, pa.array(a), pa.array(b), key], names=["kind", "a", "b", "key"])

    return run


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """Per row of ``vectors``: id, n_links (other rows linked directly), component_id, kept.

    Rows link when the cosine of their vectors in double precision is ``least`` or more (0.5 to 1).
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing
    and are their own component; vectors of different lengths don't link with each other.  Rows with a null id have a null component
    and are not kept.  Rows that repeat an id are one node: it has the links of all its rows, and n_links
    adds up those of its different vectors.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    keys = written(rows.mapInArrow(_prepared, "id long, key binary"), "keys")
    members = keys.where("id is not null and key is not null")
    classes = written(members.groupBy("key").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("weight")), "classes")
    # one row for each class, whatever repeats
    full = rows.where("id is not null").mapInArrow(partial(_prepared, packed=True), "id long, key binary, width int, vector binary").where("key is not null")
    held = full.join(classes.withColumnRenamed("rep", "id"), ["id", "key"]).dropDuplicates(["id", "key"])
    count = classes.count()
    size = min(BLOCK, max(256, count // partitions(spark)))
    blocks = written(held.repartition(min(max(1, -(-count // size)), MOST_PARTITIONS), "id", "key").mapInArrow(_packed(size), BLOCKS), "blocks")
    # each two blocks once, in half of the cases as (lower, higher), so that tasks have equal shares; by hint a product without shuffle
    low, high = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns)) for side in ("low", "high"))
    one, other = F.col("low_block"), F.col("high_block")
    wanted = (F.col("low_width") == F.col("high_width")) & ((one == other) | ((one < other) & (F.xxhash64(one, other) % 2 == 0)) | ((one > other) & (F.xxhash64(other, one) % 2 != 0)))
    links = written(low.join(high.hint("shuffle_replicate_nl"), wanted).mapInArrow(_tiles(least), "kind int, a long, b long, key binary"), "links")
    # ids with several vectors, or with one that takes part and one that doesn't, are one node of all of them
    kinds = keys.where("id is not null").groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("key").alias("n"), F.count("*").alias("rows"))
    several = written(kinds.where("low <> high or (n > 0 and n < rows)").select("id"), "several")
    theirs = written(members.join(several, "id", "left_semi").distinct().join(classes, "key").select("id", "key", "rep"), "theirs")
    joined = written(components(links.where("kind = 0").select("a", "b").union(theirs.select(F.col("id").alias("a"), F.col("rep").alias("b")))), "joined")
    counts = links.where("kind = 1").groupBy("key").agg(F.sum("b").alias("links"))
    by_class = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "key", "left")
    by_class = by_class.select("key", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    by_id = theirs.join(by_class, "key").groupBy("id").agg(F.min("component").alias("id_component"), F.sum("links").alias("id_links"))
    out = keys.join(by_class, "key", "left").join(by_id, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("id_component", "component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("id_links", "links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
