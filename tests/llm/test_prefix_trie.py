import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from conftest import DATA, rows_of

from tallyhouse.llm import queries as q
from tallyhouse.llm.prefix_trie import conversation_trie, dense_names, looked_up, rebuilt

TURN = "conv_id long, turn long, role string, text string, place string, top string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(said.get(c - c % 20, [])[:h] + said[c][h:])
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    saved, leaves = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[x] for x in children[path])
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
    out = set()
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(made[c]) == len(path))
        out.add((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURN)


def trie(spark, rows, parts=3):
    return conversation_trie(*rebuilt(frame(spark, rows).repartition(parts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    """Few texts, so that many openings are shared; null ids, turns, roles and texts, repeated turns, ids without a source, one long conversation."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(300), 70):
        for i in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([i, i, i, None]), rng.choice(["user", "user", None]), rng.choice(["a b", "a  b\tc", "", None, "é é"])))
    rows += [(40, i, "user", rng.choice(["a b", "c"])) for i in range(150)] + [(60, i, "user", "a b") for i in range(140)] + [(80, i, "user", "a b") for i in range(133)]
    rows += [(None, 1, "user", "lost"), (7, 1, "user", "twice"), (7, 1, "user", "twice")]
    assert {tuple(r) for r in trie(spark, rows).collect()} == brute(rows)


def test_trie_of_nothing_and_of_silent_conversations(spark):
    assert trie(spark, []).count() == 0
    # conversations of h turns or fewer without a source have none left
    silent = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1][:5]
    rows = [(c, 0, "user", "gone") for c in silent]
    got = {tuple(r) for r in trie(spark, rows).collect()}
    assert got == brute(rows) and len(got) == 1
    rows.append((silent[0], 9, "user", "x " * 50_000))
    assert {tuple(r) for r in trie(spark, rows).collect()} == brute(rows)


def test_equal_conversations_end_together(spark):
    """A node with more ids than one piece of the hashed list; ids of different lengths are ordered as numbers."""
    rows = [(c * 20, i, "user", f"t{i}") for c in range(1, 700) for i in range(2)]
    assert {tuple(r) for r in trie(spark, rows, 5).collect()} == brute(rows)


def test_names_are_dense_and_hot_keys_are_found(spark):
    rows = spark.createDataFrame([(i % 3 if i < 4000 else i, i) for i in range(6000)], "k long, i long")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    names = dense_names(counts, ["k"])
    assert sorted(r.name for r in names.collect()) == list(range(2003))
    got = looked_up(rows, names, ["k"])
    assert got.count() == 6000 and got.select("k", "name").distinct().count() == 2003


def test_query_equals_sql_and_brute_force(spark, duck):
    got = q.op13_prefix_trie(spark, DATA).toPandas()
    assert rows_of(got) == rows_of(duck.execute(q.SQL["op13_prefix_trie"]).fetchdf())
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert len(got) == len(brute(rows))
