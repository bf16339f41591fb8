import math
import random

import numpy as np
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from tallyhouse.llm import hard_negatives as hn
from tallyhouse.llm import queries as q
from tallyhouse.llm.hard_negatives import best, mine_hard_negatives, products

ROW = "vec_id long, embedding array<double>, label int, anchor_id long, score string"


def code(x):
    return math.floor(256 * x) if abs(x) < 2**40 else int(x) * 256


def brute(rows, every=50, positives=5, negatives=3):
    take = [(i, tuple(map(code, v)), l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    take = list(dict.fromkeys(take))
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    out = set()
    for a, va, la in take:
        if a % every:
            continue
        scores = [(-cut(sum(x * y for x, y in zip(va, v))), i, l) for i, v, l in take if i != a and len(v) == len(va)]
        pos = sorted({(s, i) for s, i, l in scores if l == la})[:positives]
        for s, p in pos:
            neg = sorted({(t, i) for t, i, l in scores if l != la and 50 * -s <= 100 * -t <= 95 * -s})[:negatives]
            out |= {(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(neg)}
    return out


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], ROW).repartition(parts)


def mined(spark, rows, **how):
    return {tuple(r) for r in mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, **how).collect()}


def clustered(seed, n, width=8, noise=0.4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(6, width))[rng.integers(0, 6, n)] + rng.normal(scale=noise, size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]


def test_against_brute_force(spark):
    """Nulls, ties, repeated rows, repeated ids, empty vectors, other lengths, numbers beyond an int."""
    rng = random.Random(1)
    rows = clustered(1, 300)
    rows += [rows[0], rows[50], (50, rows[7][1], 1), (51, rows[3][1], 0), (None, rows[3][1], 0), (350, None, 1), (400, rows[9][1], None), (450, [None] * 8, 1), (500, [math.nan] * 8, 1), (550, [math.inf] * 8, 1)]
    rows += [(1000 + i, [], i % 2) for i in range(4)] + [(2000 + i, [float(rng.randrange(4)) for _ in range(3)], i % 3) for i in range(60)]
    rows += [(3000 + 10 * i, [rng.choice([1e6, 3e9, -2e12, 1e300, 0.5]), 1.0], i % 2) for i in range(12)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_many_leaves_prune_and_lose_nothing(spark, monkeypatch):
    """Small leaves and upper nodes; clusters apart let whole pairs of nodes go."""
    for name, value in (("LEAF_ROWS", 16), ("ANCHOR_ROWS", 2), ("CHUNK_LEAVES", 2), ("SAMPLE_ROWS", 64), ("LEVELS", (2, 3))):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(2, 900, noise=0.03)
    kept = []
    real = hn.leaf_pairs

    def counted(anchors, candidates, *rest):
        pairs = real(anchors, candidates, *rest)
        kept.append((pairs.count(), anchors.count() * candidates.count()))
        return pairs

    monkeypatch.setattr(hn, "leaf_pairs", counted)
    assert mined(spark, rows) == brute(rows)
    assert kept[0][0] < 0.5 * kept[0][1], kept


def test_equal_vectors_and_few_labels(spark):
    same = [(i, [0.5, 0.5], 0) for i in range(0, 120)]
    assert mined(spark, same) == set()  # one label, no negatives
    rows = [(i, [1.0, 0.0], i % 2) for i in range(200)] + [(1000 + i, [0.9, 0.1], i % 2) for i in range(30)] + [rows_ for rows_ in [(7, [1.0, 0.0], 1)] * 200]
    assert mined(spark, rows) == brute(rows) != set()


def test_nothing(spark):
    assert mined(spark, []) == set() == mined(spark, [(1, [1.0], 1)]) == mined(spark, [(50, [1.0], 1)])


@pytest.mark.parametrize("top", [2**20, 2**35, 2**62])
def test_products_are_exact(top):
    rng = random.Random(top)
    a, c = ([[rng.randrange(-top, top) for _ in range(5)] for _ in range(4)] for _ in range(2))
    form = lambda rows: np.array(rows, np.float64 if top < 2**40 else object)
    want = [[max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(r, s)))) for s in c] for r in a]
    assert products(form(a), form(c)).tolist() == want


def test_best_orders_by_score_then_id():
    rows, ids, scores = best(np.array([5, 3, 3, 9, 1]), np.array([2, 2, 2, -(2**63), 2**63 - 1]), np.array([0, 0, 0, 0, 1]), 3)
    assert list(zip(rows.tolist(), ids.tolist(), scores.tolist())) == [(0, 3, 2), (0, 5, 2), (0, 9, -(2**63)), (1, 1, 2**63 - 1)]


def test_query_equals_sql(spark, duck):
    got = q.op11_hard_negatives(spark, DATA).toPandas()
    assert rows_of(got) == rows_of(duck.execute(q.SQL["op11_hard_negatives"]).fetchdf()) and len(got) > 100
