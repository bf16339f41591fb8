"""Hard negatives by a search over two trees, one of anchors and one of candidates.

Vectors become whole numbers, floor(scale * x), and scores are their inner products, exact in
doubles where sums stay below 2**53 and computed in Python's integers elsewhere.

Both trees have the same upper nodes: centres fitted on a bounded sample, to which every row is
routed; below them lie leaves of a bounded number of rows, cut at medians.  A node knows a centre
and a radius that holds all its rows, so for nodes A and C every score lies within

    a.c -+ (|a| * r_C + |c| * r_A + r_A * r_C),    a, c their centres.

The trees are walked together, a level of both at a time, as joins of pairs with children.  A pair
whose interval lies below what every anchor of A needs, or beyond what any can use, is dropped with
all pairs under it; rows of the leaf pairs that are left are scored.  What an anchor needs comes from the
sample first: k rows of it with a score prove that the k-th best has that score at least.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import partitions, written

#: Numbers of the sample at most, and rows of it at most; upper nodes are fitted on it.
SAMPLE_NUMBERS, SAMPLE_ROWS = 1 << 20, 4096
#: Numbers of a leaf of candidates and of one of anchors at most, and rows of them at most.
LEAF_NUMBERS, LEAF_ROWS, ANCHOR_ROWS = 1 << 19, 1024, 256
#: Leaves' worth of rows that one task cuts into leaves.
CHUNK_LEAVES = 8
#: Halvings of the upper nodes: at the level of the first number of them, and that of the second.
LEVELS = (4, 8)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

_ROW = "side int, id long, label long, width int, form string, codes binary, h long, salt long"
_LEAF = "side int, leaf long, width int, n1 int, n2 int, d1 double, d2 double, center binary, radius double, low long, high long, ids binary, labels binary, form string, codes binary, need binary, least double, most double"
_NODE = ["width", "n1", "n2", "leaf", "center", "radius", "low", "high", "least", "most"]


def coded(v: list, scale: int) -> tuple[str, bytes]:
    """floor(scale * x) of each number: as int16, as int64, or as text where those are too small."""
    codes = [math.floor(y) if math.isfinite(y := x * scale) else int(x) * scale for x in v]
    most = max(map(abs, codes), default=0)
    if most < 1 << 15:
        return "h", np.array(codes, np.int16).tobytes()
    return ("q", np.array(codes, np.int64).tobytes()) if most < 1 << 62 else ("t", " ".join(map(str, codes)).encode())


def matrix(forms: list[str], codes: list[bytes], width: int) -> np.ndarray:
    """Rows of codes as doubles, or as Python's integers if one doesn't fit a double."""
    if set(forms) <= {"h"}:
        return np.frombuffer(b"".join(codes), np.int16).reshape(len(codes), width).astype(np.float64)
    rows = [np.frombuffer(c, np.int16 if f == "h" else np.int64).tolist() if f in "hq" else list(map(int, c.split())) for f, c in zip(forms, codes)]
    exact = np.array(rows, object).reshape(len(rows), width)
    return exact.astype(np.float64) if exact.size and max(map(abs, exact.ravel())) < 1 << 53 else exact


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as int64, exact; beyond its range they count as its ends."""
    bound = lambda x: max(map(abs, x.ravel()), default=0)
    if a.dtype == c.dtype == np.float64 and float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, a.shape[1]) < 2**53:
        return (a @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    a, c = whole(a), whole(c)
    if not a.shape[1]:
        return np.zeros((len(a), len(c)), np.int64)
    out = a @ c.T
    return np.clip(out, _LOW, _HIGH).astype(np.int64) if bound(out) > _HIGH else out.astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the ``most`` highest scores, ties by smaller id, equal (id, score) once: row, id, score."""
    order = np.lexsort((ids, ~scores, rows))  # ~ turns the order of int64 without overflow
    rows, ids, scores = rows[order], ids[order], scores[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    rows, ids, scores = rows[new], ids[new], scores[new]
    start = np.searchsorted(rows, rows, "left")
    keep = np.arange(len(rows)) - start < most
    return rows[keep], ids[keep], scores[keep]


class Router:
    """Upper nodes by halving: row numbers at two levels, and centres of both."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.levels = [min(x, depth) for x in LEVELS]
        self.splits: dict[int, tuple[np.ndarray, float]] = {}
        self.centers: dict[int, np.ndarray] = {}
        self._grow(1, sample, self.levels[1])

    def _grow(self, node: int, x: np.ndarray, depth: int) -> None:
        self.centers[node] = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        if not depth:
            return
        away = x[np.argmax(((x - self.centers[node]) ** 2).sum(axis=1))] if len(x) else self.centers[node]
        far = x[np.argmax(((x - away) ** 2).sum(axis=1))] if len(x) else away
        axis = far - away
        at = x @ axis
        cut = float(np.median(at)) if len(x) else 0.0
        self.splits[node] = (axis, cut)
        self._grow(2 * node, x[at <= cut], depth - 1)
        self._grow(2 * node + 1, x[at > cut], depth - 1)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = np.ones(len(x), np.int32)
        found = [node.copy()] if not self.levels[0] else []
        for step in range(1, self.levels[1] + 1):
            for n in np.unique(node):
                own = np.flatnonzero(node == n)
                axis, cut = self.splits[int(n)]
                node[own] = 2 * n + (x[own] @ axis > cut)
            if step == self.levels[0]:
                found.append(node.copy())
        return found[0], node


def _distance(x: np.ndarray, center: np.ndarray) -> float:
    return float(np.sqrt(((x - center) ** 2).sum(axis=1)).max(initial=0)) * (1 + 1e-12)


def _leaves(x: np.ndarray, most: int):
    """Indexes of leaves of at most ``most`` rows: halves at the median along the line between two far rows."""
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            yield own
            continue
        y = x[own]
        away = y[np.argmax(((y - y.mean(axis=0)) ** 2).sum(axis=1))]
        far = y[np.argmax(((y - away) ** 2).sum(axis=1))]
        order = np.argsort(y @ (far - away), kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]


class Sample:
    """Some rows of the table, no id twice, that prove lower bounds."""

    def __init__(self, ids, labels, codes):
        self.ids, self.labels, self.codes = ids, labels, codes

    def kth(self, scores: np.ndarray, use: np.ndarray, k: int) -> np.ndarray:
        """k-th highest score of each row among those in use, or the lowest number if there are fewer."""
        if scores.shape[1] < k:
            return np.full(len(scores), _LOW)
        return np.partition(np.where(use, scores, _LOW), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _prepare(scale: int):
    def run(batches):
        for batch in batches:
            out = [coded(v, scale) for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("side", "id", "label", "width")] + [pa.array([f for f, _ in out], pa.string()), pa.array([c for _, c in out], pa.binary()), batch.column("h"), batch.column("salt")],
                names=["side", "id", "label", "width", "form", "codes", "h", "salt"],
            )

    return run


def _routed(shared):
    """Rows with their upper nodes."""

    def run(batches):
        width, router, _ = shared.value
        for batch in batches:
            n1, n2 = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            own = np.flatnonzero(batch.column("width").to_numpy() == width)
            if len(own) and width:
                rows = batch.take(pa.array(own))
                x = matrix(rows.column("form").to_pylist(), rows.column("codes").to_pylist(), width).astype(np.float64)
                n1[own], n2[own] = router.route(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n1), pa.array(n2)], names=[*batch.schema.names, "n1", "n2"])

    return run


def _cut(shared, positives: int):
    """Leaves of the rows of one side, upper node and chunk; leaves of anchors know what each anchor needs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        main, router, sample = shared.value
        side, width, n1, n2, chunk = (int(pdf[c].iloc[0]) for c in ("side", "width", "n1", "n2", "chunk"))
        pdf = pdf.sort_values(["id", "label", "codes"], kind="stable")
        forms, codes = pdf["form"].to_numpy(), pdf["codes"].to_numpy()
        exact = matrix(forms.tolist(), codes.tolist(), width)
        x, ids, labels = exact.astype(np.float64), pdf["id"].to_numpy(), pdf["label"].to_numpy()
        tops = [router.centers[n] if width == main and n else np.zeros(width) for n in (n1, n2)]
        out = []
        most = max(16, min(ANCHOR_ROWS if side else LEAF_ROWS, LEAF_NUMBERS // max(1, width)))
        for number, own in enumerate(_leaves(x, most)):
            own = np.sort(own)
            y = x[own]
            center = y.mean(axis=0)
            need = np.full(len(own), _LOW)
            if side and width == main:
                s = products(exact[own], sample.codes)
                need = sample.kth(s, (sample.labels == labels[own][:, None]) & (sample.ids != ids[own][:, None]), positives)
            form = "h" if set(forms[own]) <= {"h"} else "t"
            blob = b"".join(codes[own]) if form == "h" else b"\n".join(" ".join(str(int(v)) for v in r).encode() for r in exact[own])
            name = hash_name(side, width, n2, chunk, number)
            out.append((side, name, width, n1, n2, *(_distance(y, t) for t in tops), center.tobytes(), _distance(y, center), int(labels[own].min()), int(labels[own].max()), ids[own].tobytes(), labels[own].tobytes(), form, blob, need.astype(np.int64).tobytes(), float(need.min()), math.inf))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _LEAF.split(", ")])

    return run


def hash_name(*parts: int) -> int:
    """A number for a leaf, from what tells it."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big", signed=True)


def _nodes(leaves: DataFrame, level: int, centers: DataFrame) -> DataFrame:
    """Upper nodes of one side at a level, from their leaves: radius around the fitted centre, needs and labels over all."""
    keys = ["width", "n1"] if level == 1 else ["width", "n1", "n2"]
    own = leaves.groupBy(*keys).agg(F.max(f"d{level}").alias("radius"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"))
    return own.join(F.broadcast(centers.withColumnRenamed("node", f"n{level}")), ["width", f"n{level}"], "left")


def _interval(a: pd.Series, ra: pd.Series, c: pd.Series, rc: pd.Series) -> pd.DataFrame:
    """Lowest and highest score between rows of two nodes; a missing centre is zero."""
    low, high = np.zeros(len(a)), np.zeros(len(a))
    for i, (x, p, y, q) in enumerate(zip(a, ra, c, rc)):
        x, y = (np.frombuffer(v, np.float64) if v is not None else np.zeros(1) for v in (x, y))
        if len(x) != len(y):  # one centre is missing
            x, y = (np.zeros(max(len(x), len(y))) if len(v) < max(len(x), len(y)) else v for v in (x, y))
        nx, ny = math.sqrt(x @ x), math.sqrt(y @ y)
        mid, slack = float(x @ y), nx * q + ny * p + p * q
        slack += 1e-9 * (nx + p) * (ny + q) + 1e-6
        low[i], high[i] = mid - slack, mid + slack
    return pd.DataFrame({"low": np.nan_to_num(low, nan=-np.inf, neginf=-np.inf, posinf=np.inf), "high": np.nan_to_num(high, nan=np.inf, neginf=-np.inf, posinf=np.inf)})


def leaf_pairs(anchors: DataFrame, candidates: DataFrame, centers: DataFrame, same_label: bool) -> DataFrame:
    """(a, c): pairs of leaves that may hold a score that some anchor needs.

    ``anchors`` and ``candidates`` are tables of leaves without their rows.  Each round joins the pairs
    that are left with the children on both sides, by the node above.
    """
    interval = F.pandas_udf(_interval, "low double, high double")
    pairs = None
    for level, up in ((1, ["width"]), (2, ["width", "n1"]), (0, ["width", "n2"])):
        a, c = (x.select(*_NODE) if not level else _nodes(x, level, centers) for x in (anchors, candidates))
        own = ["n1"] if level == 1 else ["n2"] if level == 2 else ["leaf"]
        held = ["center", "radius", "low", "high"]
        a = a.select(*up, *[F.col(n).alias(f"a_{n}") for n in own + held + ["least", "most"]])
        c = c.select(*up, *[F.col(n).alias(f"c_{n}") for n in own + held])
        if pairs is None:
            both = a.join(c, up)
        else:
            above = up[-1]
            a = a.withColumnRenamed(above, f"above_a_{above}")
            c = c.withColumnRenamed(above, f"above_c_{above}")
            both = pairs.join(a, ["width", f"above_a_{above}"]).join(c, ["width", f"above_c_{above}"])
        if same_label:
            both = both.where("a_low <= c_high and c_low <= a_high")
        else:
            both = both.where("not (a_low = a_high and c_low = c_high and a_low = c_low)")
        both = both.withColumn("score", interval("a_center", "a_radius", "c_center", "c_radius"))
        both = both.where("score.high >= a_least and score.low <= a_most")
        pairs = both.select("width", *[F.col(f"{s}_{own[0]}").alias(f"above_{s}_{own[0]}") for s in "ac"])
    return pairs.select(F.col("above_a_leaf").alias("a"), F.col("above_c_leaf").alias("c"))


def _unpacked(form, codes: bytes, n: int, width: int) -> np.ndarray:
    if form == "h":
        return np.frombuffer(codes, np.int16).reshape(n, width).astype(np.float64)
    return matrix(["t"] * n, codes.split(b"\n") if width else [b""] * n, width)


def _scored(pick: Callable, names: list[str]):
    """Runs ``pick`` on the rows of each pair of leaves."""

    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                ids, cids = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                labels, clabels = np.frombuffer(r["a_labels"], np.int64), np.frombuffer(r["c_labels"], np.int64)
                s = products(_unpacked(r["a_form"], r["a_codes"], len(ids), r["width"]), _unpacked(r["c_form"], r["c_codes"], len(cids), r["width"]))
                same = labels[:, None] == clabels
                own = ids[:, None] != cids
                found += [(np.full(len(x[0]), r["a"]), *x) for x in pick(r, s, same & own, ~same & own, cids)]
            columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return run


def _rows_of_pairs(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, pick: Callable, names: list[str]) -> DataFrame:
    """Scores of the pairs of leaves; pairs are dealt evenly, as a leaf may be in many of them."""
    columns = ["ids", "labels", "form", "codes"]
    a = anchors.select(F.col("leaf").alias("a"), "width", "need", *[F.col(c).alias(f"a_{c}") for c in columns])
    c = candidates.select(F.col("leaf").alias("c"), *[F.col(c).alias(f"c_{c}") for c in columns])
    joined = pairs.join(c, "c").join(a, "a").repartition(3 * partitions(pairs.sparkSession), "a", "c")
    return joined.mapInArrow(_scored(pick, names), ", ".join(f"{n} long" for n in names))


def _pick_positives(most: int):
    def pick(r, s, same, other, ids):
        use = same & (s >= np.frombuffer(r["need"], np.int64)[:, None])
        i, j = np.nonzero(use)
        yield best(ids[j], s[i, j], i, most)

    return pick


def _pick_negatives(most: int, positives: int):
    def pick(r, s, same, other, ids):
        need = np.frombuffer(r["need"], np.int64).reshape(2, -1, positives)
        for k in range(positives):
            i, j = np.nonzero(other & (s >= need[0, :, k, None]) & (s <= need[1, :, k, None]))
            row, found, score = best(ids[j], s[i, j], i, most)
            yield row, np.full(len(row), k + 1), found, score

    return pick


def window_of(score: int, least: int, most: int) -> tuple[int, int]:
    """Whole scores of negatives that 100 times lie between ``least`` and ``most`` times a positive's score."""
    return -((-least * score) // 100), most * score // 100


def _windows(shared, least: int, most: int, positives: int, negatives: int):
    """Leaves of anchors with the lowest and highest score that each positive allows; the lowest is raised by the sample."""

    def run(batches):
        main, _, sample = shared.value
        for batch in batches:
            out = {"leaf": [], "need": [], "least": [], "most": []}
            for r in batch.to_pylist():
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                low, high = np.full((len(ids), positives), _HIGH), np.full((len(ids), positives), _LOW)
                for p in r["found"]:
                    low[p["row"], p["rank"] - 1], high[p["row"], p["rank"] - 1] = (min(max(x, _LOW), _HIGH) for x in window_of(p["score"], least, most))
                if r["width"] == main:
                    s = products(_unpacked(r["form"], r["codes"], len(ids), r["width"]), sample.codes)
                    other = (sample.labels != labels[:, None]) & (sample.ids != ids[:, None])
                    for k in range(positives):
                        raised = sample.kth(s, other & (s >= low[:, k, None]) & (s <= high[:, k, None]), negatives)
                        low[:, k] = np.maximum(low[:, k], raised)
                some = low <= high
                out["leaf"].append(r["leaf"])
                out["need"].append(np.stack([low, high]).astype(np.int64).tobytes())
                out["least"].append(float(low[some].min()) if some.any() else math.inf)
                out["most"].append(float(high[some].max()) if some.any() else -math.inf)
            yield pa.RecordBatch.from_arrays([pa.array(out["leaf"], pa.int64()), pa.array(out["need"], pa.binary()), pa.array(out["least"], pa.float64()), pa.array(out["most"], pa.float64())], names=list(out))

    return run


def _ranked(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of each key by score, then id; the same row found twice counts once."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= most).distinct()


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives of an anchor are its first rows of the same label, negatives of a positive the first rows of another label whose
    score is ``least`` to ``most`` percent of the positive's; first is by score, ties by smaller id.  A negative
    score of a positive leaves none, as the range is empty then.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part; vectors of
    different lengths have no score with each other, empty ones have the score 0.  Rows of an anchor's own id are never its partners.
    Equal rows count once; rows of one id with other vectors are rows of their own, and two of them with equal scores
    count once.  Scores beyond a long count as its largest or smallest.  Other columns are ignored, an
    empty table gives an empty one.
    """
    spark = vectors.sparkSession
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False)))
    sides = F.explode(F.when(F.col("anchor"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select(sides.alias("side"), "id", "label", F.size("vector").alias("width"), "vector", F.xxhash64("id", "label", "vector").alias("h"))
    # equal anchors are one; equal candidates stay, dealt apart by where they were read
    rows = rows.where("side = 1").distinct().withColumn("salt", F.lit(0).cast("long")).unionByName(rows.where("side = 0").withColumn("salt", F.monotonically_increasing_id()))
    rows = written(rows.mapInArrow(_prepare(scale), _ROW), "vectors")
    main, count = rows.where("side = 0").groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").select("width", "n").first() or (0, 0)
    wanted = min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, main))
    share = min(1.0, 4 * wanted / max(1, count))  # hashes are even, so this share of them holds enough rows
    low = rows.where((F.col("side") == 0) & (F.col("width") == main) & (F.col("h") <= min(_HIGH, _LOW + int(share * 2**64))))
    taken = low.select("h", "id", "label", "form", "codes").distinct().orderBy("h", "id", "label", "codes").limit(wanted).collect()
    taken = list({r.id: r for r in taken}.values())
    codes = matrix([r.form for r in taken], [bytes(r.codes) for r in taken], main)
    sample = Sample(np.array([r.id for r in taken], np.int64), np.array([r.label for r in taken], np.int64), codes)
    leaf_rows = max(16, min(LEAF_ROWS, LEAF_NUMBERS // max(1, main)))
    router = Router(codes.astype(np.float64), min(LEVELS[1], max(0, int(count // (CHUNK_LEAVES * leaf_rows)).bit_length())))
    shared = spark.sparkContext.broadcast((main, router, sample))
    centers = spark.createDataFrame([(main, int(n), c.tobytes()) for n, c in router.centers.items()], "width int, node int, center binary")

    routed = written(rows.mapInArrow(_routed(shared), f"{_ROW}, n1 int, n2 int"), "routed")
    # at most one row for each side, upper node and length of vectors; a cell of any size is cut into chunks by hash
    sizes = routed.groupBy("side", "width", "n1", "n2").agg(F.count("*").alias("n"))
    per = F.greatest(F.lit(16), F.least(F.lit(LEAF_ROWS), F.floor(F.lit(LEAF_NUMBERS) / F.greatest(F.col("width"), F.lit(1))))) * CHUNK_LEAVES
    chunks = sizes.select("side", "width", "n1", "n2", F.ceil(F.col("n") / per).alias("chunks"))
    chunks = F.broadcast(chunks) if chunks.limit(100_001).count() <= 100_000 else chunks
    dealt = routed.join(chunks, ["side", "width", "n1", "n2"]).withColumn("chunk", F.pmod(F.xxhash64("h", "salt"), "chunks")).drop("chunks", "salt")
    leaves = written(dealt.groupBy("side", "width", "n1", "n2", "chunk").applyInPandas(_cut(shared, positives), _LEAF), "leaves")
    anchors, candidates = leaves.where("side = 1"), leaves.where("side = 0")

    pairs = written(leaf_pairs(anchors, candidates, centers, True), "pairs")
    near = _rows_of_pairs(pairs, anchors, candidates, _pick_positives(positives), ["a", "row", "id", "score"])
    near = written(_ranked(near, ["a", "row"], positives), "positives")

    found = near.groupBy(F.col("a").alias("leaf")).agg(F.collect_list(F.struct("row", "rank", "score")).alias("found"))  # ANCHOR_ROWS * positives at most
    wanted = anchors.join(found, "leaf").select("leaf", "width", "ids", "labels", "form", "codes", "found")
    wanted = wanted.mapInArrow(_windows(shared, least, most, positives, negatives), "leaf long, need binary, least double, most double")
    asking = written(anchors.drop("need", "least", "most").join(wanted, "leaf"), "asking")
    pairs = written(leaf_pairs(asking, candidates, centers, False), "pairs")
    far = _rows_of_pairs(pairs, asking, candidates, _pick_negatives(negatives, positives), ["a", "row", "k", "id", "score"])
    far = _ranked(far, ["a", "row", "k"], negatives)
    unpacked = anchors.select(F.col("leaf").alias("a"), "ids").mapInArrow(_anchor_ids, "a long, row long, anchor_id long")
    out = near.select("a", "row", F.col("rank").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = out.join(far.select("a", "row", F.col("k").cast("int").alias("k"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["a", "row", "k"])
    return out.join(unpacked, ["a", "row"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _anchor_ids(batches):
    for batch in batches:
        found = [(a, np.frombuffer(i, np.int64)) for a, i in zip(batch.column("a").to_pylist(), batch.column("ids").to_pylist())]
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([np.full(len(i), a) for a, i in found], [np.arange(len(i)) for _, i in found], [i for _, i in found])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["a", "row", "anchor_id"])
