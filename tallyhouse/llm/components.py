"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations with joins on node ids; state lies in Parquet in the
shared folder.  Before the first round every partition replaces its edges by a
spanning forest, which keeps all links and shortens paths.  Nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written_at


class Forest:
    """Union-find over small local indexes; roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node joined with it) that connect what the given edges connect."""
    ids, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(ids))
    for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist()):
        forest.union(x, y)
    root = np.fromiter((forest.find(x) for x in range(len(ids))), np.int64, len(ids))
    own = root != np.arange(len(ids))
    return ids[own], ids[root[own]]


def _forests(batches):
    for pdf in batches:
        a, b = stars(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
        yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node with an edge; the component is its smallest node.

    ``edges`` has two long columns ``a`` and ``b``; nulls and loops are ignored,
    repeated and reversed edges are allowed.  An empty table gives an empty table.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    state, uri = written_at(edges.mapInPandas(_forests, "a long, b long").distinct(), "cc")
    for _ in range(most_rounds):
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after, after_uri = written_at(small, "cc")
        changed = after.groupBy().agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        before = state.groupBy().agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(spark, uri)
        state, uri = after, after_uri
        if changed == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
