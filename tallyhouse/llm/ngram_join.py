"""N-gram Jaccard self-join of documents by T-occurrence search (DivideSkip).

1. Texts with equal shingle sets become one class, represented by its smallest id.
2. A global order of shingles puts those that occur in one class only first.  A set of
   n shingles that reaches the threshold with another must share one of its first
   n - ceil(t*n) + 1 (its prefix).  Most texts have that many shingles of their own and
   are done.  To find this out only the part of each set below ``CUT`` of the hash
   space travels (all of it where that part is shorter than the prefix).
3. The home of a shingle is the smallest document with it in its prefix.  Each of the
   others visits the homes of its prefix shingles, which are few, as near copies share most
   homes.  The visitors of a home are cut into blocks, and each pair of blocks is searched by DivideSkip: the
   longest inverted lists are set aside, the short ones merged, and those documents that
   reach the reduced threshold are looked up in the long lists by binary search.
4. Links inside each pair of blocks leave as a spanning forest and counts.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .scratch import drop, partitions, written, written_at
from .textkit import mix, pieces, release, releasing, shingle_sets, string_parts

#: Share of the hash space whose shingles travel for the count of own shingles.
CUT = np.uint64(int(0.35 * 2**64))
#: Entries held by a task before it writes them out.
HOLD = 1_500_000
#: Ids up to which a key list may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Documents of a buffer, so that two bytes number them; LAST stands for more than one.
MOST_DOCS = 60_000
LAST = 0xFFFF
#: Weight of a probe against a merge step in the choice of how many lists count as long.
MU = 0.05


def needed(n, num: int, den: int):
    """Least overlap of a set of ``n`` with any set it links with."""
    return -(-n * num // den)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[object, np.ndarray]]:
    data, offsets = string_parts(batch.column("text"))
    ids = batch.column("id").to_pylist()
    for i, j in pieces(offsets):
        cut = offsets[i : j + 1]
        yield from zip(ids[i:j], shingle_sets(data[cut[0] : cut[-1]], cut - cut[0], k))


def _keys(k: int):
    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for doc, s in _sets(batch, k):
                a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                for column, v in zip(out, (doc, len(s), a, b)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["id", "n", "key1", "key2"])

    return run


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _views(blobs: pa.ChunkedArray, kinds: tuple) -> Iterator[list[np.ndarray]]:
    for blob in blobs:
        view = blob.as_buffer()
        sizes, at, found = np.frombuffer(view, np.int64, len(kinds)), 8 * len(kinds), []
        for kind, size in zip(kinds, sizes.tolist()):
            found.append(np.frombuffer(view, kind, size, at))
            at += found[-1].nbytes
        yield found


def _joined(views: list, kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate(v) for v in zip(*views)] if views else [np.zeros(0, kind) for kind in kinds]


def _split(key: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays dealt out by ``key`` in 0..n-1."""
    order = np.argsort(key, kind="stable")
    arrays = [a[order] for a in arrays]
    edges = np.searchsorted(key[order], np.arange(n + 1))
    for p in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield p, [a[edges[p] : edges[p + 1]] for a in arrays]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Place of documents by their keys; 1,024 neighbours of a buffer stay together."""
    return (mix((keys >> 10).astype(np.uint64)) % np.uint64(n)).astype(np.int64)


#: A document's key is a random number of its buffer, then its number in the buffer.
_DOC = (np.int64, np.int64, np.int64, np.int64, np.int64, np.uint64)  # key, id, n, n below CUT; key and hash of a shared shingle
_ENTRY = (np.int64, np.uint64, np.uint16)  # key of the buffer; hash, number in the buffer


def _asks(k: int, num: int, den: int, parts: int):
    """Per buffer of documents: (0, part, hashes with ids) and (1, bucket, documents with shingles known to be shared)."""

    def flush(held):
        base = np.array([secrets.randbits(46) << 16])
        docs = np.array([(d, n, m) for d, n, m, _ in held], np.int64).reshape(-1, 3)
        key = base + np.arange(len(docs))
        h = np.concatenate([s for *_, s in held])
        owner = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(s) for *_, s in held])
        held.clear()
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        del order
        lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(lead, len(h)))
        many = np.repeat(size > 1, size)
        ask, who = h[lead], np.where(size > 1, LAST, owner[lead]).astype(np.uint16)
        rows = [(0, p, _pack(base, *x)) for p, x in _split((ask % np.uint64(parts)).astype(np.int32), parts, ask, who)]
        del ask, who
        own = dict(_split(_bucket(key, parts), parts, key, *docs.T))
        shared = dict(_split(_bucket(key[owner[many]], parts), parts, key[owner[many]], h[many]))
        none = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        rows += [(1, p, _pack(*x, *shared.get(p, none))) for p, x in own.items()]
        side, part, blob = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(side, pa.int32()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], names=["side", "part", "blob"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc, s in _sets(batch, k):
                n = len(s)
                if not n:
                    continue
                below = int(np.searchsorted(s, CUT))
                keep = s[:below].copy() if below >= n - needed(n, num, den) + 1 else s.copy()
                held.append((doc, n, below, keep))
                size += len(keep) + 8
                if size >= HOLD or len(held) >= MOST_DOCS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _answers(parts: int):
    """Shingles of one part of the hash space that occur in more than one document, sent to those documents."""

    def run(table: pa.Table) -> pa.Table:
        views = [(h, np.where(who == LAST, -1, base + who.astype(np.int64))) for base, h, who in _views(table["blob"], _ENTRY)]
        h, owner = _joined(views, (np.uint64, np.int64))
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(lead, len(h)))
        told = np.repeat(size > 1, size) & (owner >= 0) if len(h) else np.zeros(0, bool)
        none = np.zeros(0, np.int64)
        rows = [(p, _pack(none, none, none, none, *x)) for p, x in _split(_bucket(owner[told], parts), parts, owner[told], h[told])]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _prefixes(num: int, den: int):
    """Shared shingles in the prefix of each document that isn't done."""

    def run(table: pa.Table) -> pa.Table:
        doc, ids, n, below, who, h = _joined(list(_views(table["blob"], _DOC)), _DOC)
        order = np.argsort(doc, kind="stable")
        doc, ids, n, below = doc[order], ids[order], n[order], below[order]
        late = h >= CUT
        order = np.lexsort((h, late, who))
        who, h, late = who[order], h[order], late[order]
        at = np.searchsorted(doc, who)
        shared0 = np.bincount(at[~late], minlength=len(doc))
        shared1 = np.bincount(at[late], minlength=len(doc))
        prefix = n - needed(n, num, den) + 1
        take0 = np.clip(prefix - (below - shared0), 0, shared0)
        take1 = np.where(prefix > below, np.clip(prefix - below - (n - below - shared1), 0, shared1), 0)
        first0 = np.concatenate(([0], np.cumsum(shared0 + shared1)))[:-1]
        rank = np.arange(len(h)) - first0[at] if len(h) else np.zeros(0, np.int64)
        keep = np.where(late, rank - shared0[at] < take1[at], rank < take0[at]) if len(h) else np.zeros(0, bool)
        return pa.table({"shingle": pa.array(h[keep].view(np.int64)), "id": pa.array(ids[at[keep]]), "n": pa.array(n[at[keep]])})

    return run


def _full(k: int):
    def run(batches):
        for batch in batches:
            rows = [(doc, s.tobytes()) for doc, s in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "set"])

    return run


class InvertedIndex:
    """Inverted lists of a block of sets, as one array of owners ordered by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(h, kind="stable")
        h, self.owner = h[order], owner[order]
        lead = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        self.start = np.append(np.flatnonzero(lead), len(h))
        self.key = h[lead]

    def search(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Indexes of the sets whose Jaccard similarity with ``query`` is num/den or more."""
        least = needed(len(query), num, den)
        at = np.searchsorted(self.key, query)
        at = at[(at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] == query)] if len(self.key) else at[:0]
        if not least or len(at) < least:
            return np.zeros(0, np.int64)
        begin, length = self.start[at], self.start[at + 1] - self.start[at]
        longest = int(length.max())
        n_long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
        order = np.argsort(length, kind="stable")
        short, long = order[: len(at) - n_long], order[len(at) - n_long :]
        size = length[short]
        where = np.repeat(begin[short] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        count = np.bincount(self.owner[where], minlength=len(self.sizes))
        found = np.flatnonzero(count >= max(1, least - n_long))
        # the length filter: sizes outside t*n .. n/t can't reach the threshold
        found = found[(self.sizes[found] * den >= len(query) * num) & (self.sizes[found] * num <= len(query) * den)]
        overlap = count[found]
        for i in long.tolist():
            if not len(found):
                break
            part = self.owner[begin[i] : begin[i] + length[i]]
            spot = np.searchsorted(part, found.astype(part.dtype))
            overlap += part[np.minimum(spot, len(part) - 1)] == found
        return found[den * overlap >= num * (len(query) + self.sizes[found] - overlap)]


def _tile(num: int, den: int):
    """Links within a block or between two blocks: (0, a, b) of a spanning forest and (1, id, links).

    A pair that meets at several homes counts at the smallest.
    """

    def run(table: pa.Table) -> pa.Table:
        home, low, high = (table[c][0].as_py() for c in ("home", "low", "high"))
        # rows that repeat an id with the same set are one
        _, which, count = np.unique(table["id"].to_numpy(), return_inverse=True, return_counts=True)
        repeated = np.flatnonzero(count[which] > 1)  # only their sets are copied to be compared
        once = {(int(which[at]), table["set"][int(at)].as_buffer().to_pybytes()): int(at) for at in repeated}
        if len(once) < len(repeated):
            table = table.take(pa.array(sorted([*np.flatnonzero(count[which] == 1).tolist(), *once.values()])))
        del once
        block = table["block"].to_numpy()
        ids, weight = table["id"].to_numpy(), table["weight"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"]]
        ask = np.flatnonzero(block == low)
        of = ask if low == high else np.flatnonzero(block == high)
        index = InvertedIndex([sets[i] for i in of.tolist()])
        lower = [frozenset(x for x in own if x < home) for own in table["homes"].to_pylist()]
        forest, links, edges = Forest(len(ids)), np.zeros(len(ids), np.int64), []
        for i in ask.tolist():
            found = of[index.search(sets[i], num, den)]
            if low == high:
                found = found[(found > i) & (ids[found] != ids[i])]
            if lower[i] and len(found):
                found = found[[lower[i].isdisjoint(lower[j]) for j in found.tolist()]]
            if len(found):
                links[i] += weight[found].sum()
                links[found] += weight[i]
                edges += [(i, j) for j in found.tolist() if forest.union(i, j)]
        seen = np.flatnonzero(links)
        a = np.concatenate([ids[[x for x, _ in edges]], ids[seen]]).astype(np.int64)
        b = np.concatenate([ids[[x for _, x in edges]], links[seen]]).astype(np.int64)
        kind = np.repeat([0, 1], [len(edges), len(seen)]).astype(np.int32)
        return pa.table({"kind": pa.array(kind), "a": pa.array(a), "b": pa.array(b)})

    return run


def only_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on ``id``; ``ids`` is broadcast only if counted to be small."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, n_links (other rows linked directly), component_id.

    Two rows link when den * |intersection| >= num * |union| of their sets of ``k``-word
    shingles.  Texts without words have an empty set, no link, and are their own component;
    a null text counts as empty.  Rows with a null id keep n_shingles, have null n_links and
    component_id and link with nothing.  Rows that repeat an id are one node: it has the
    links of all its rows, and n_links adds up those of its different texts.  Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = written(docs.mapInArrow(releasing(_keys(k)), "id long, n long, key1 long, key2 long"), "keys")
    full = keys.where("id is not null and n > 0")
    classes = written(full.groupBy("key1", "key2").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("weight"), F.max("n").alias("n")), "classes")
    reps = classes.groupBy(F.col("rep").alias("id")).agg(F.max("weight").alias("weight"), F.max("n").alias("n"))
    copies = written(full.select("id").distinct().join(reps.select("id"), "id", "left_anti"), "copies")
    size = full.agg(F.sum("n")).first()[0] or 0
    parts = max(4 * partitions(spark), math.ceil(size * 16 / (64 << 20)))

    texts = only_ids(docs.where("id is not null"), copies, "left_anti")
    asks, asks_uri = written_at(texts.mapInArrow(releasing(_asks(k, num, den, parts)), "side int, part int, blob binary"), "asks")
    answers = asks.where("side = 0").groupBy("part").applyInArrow(_answers(parts), "part int, blob binary")
    known = asks.where("side = 1").select("part", "blob").unionByName(answers)
    postings = written(known.groupBy("part").applyInArrow(_prefixes(num, den), "shingle long, id long, n long"), "postings")
    drop(spark, asks_uri)

    least = postings.groupBy("shingle").agg(F.min("id").alias("home"), F.count("*").alias("c")).where("c > 1")
    visits = written(postings.join(least, "shingle").select("id", "n", "home").distinct(), "visits")
    total = visits.agg(F.sum("n")).first()[0] or 0
    block = min(max(total * 32 // partitions(spark), 64 << 10), 16 << 20)
    blocks = visits.groupBy("home").agg(F.ceil(F.sum("n") * 8 / F.lit(block)).alias("blocks"))
    homes = visits.groupBy("id").agg(F.collect_list("home").alias("homes"))
    searched = written(homes.join(reps, "id").select("id", "weight", "homes"), "searched")
    sets = only_ids(docs.where("id is not null"), searched.select("id"), "left_semi").mapInArrow(releasing(_full(k)), "id long, set binary")
    placed = visits.join(blocks, "home").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    tiles = (
        placed.select("id", "home", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select("id", "home", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .join(searched.join(sets, "id"), "id")
    )
    links = written(tiles.groupBy("home", "low", "high").applyInArrow(_tile(num, den), "kind int, a long, b long"), "links")

    # ids with several texts are joined with the representatives of all of them
    kinds = keys.where("id is not null").groupBy("id").agg(F.min(F.struct("key1", "key2")).alias("low"), F.max(F.struct("key1", "key2")).alias("high"))
    several = written(kinds.where("low <> high").select("id"), "several")
    theirs = written(only_ids(full, several, "left_semi").select("id", "key1", "key2").distinct().join(classes, ["key1", "key2"]).select("id", "rep"), "theirs")
    joined = written(components(links.where("kind = 0").select("a", "b").union(theirs.select(F.col("id").alias("a"), F.col("rep").alias("b")))), "joined")
    counts = links.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    by_class = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(counts.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("key1", "key2", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    by_id = theirs.withColumn("node", F.col("rep")).join(joined, "node", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("id_component"))
    found = keys.join(by_class, ["key1", "key2"], "left").join(by_id, "id", "left")
    alone = F.col("id").isNotNull()
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone & (F.col("n") > 0), F.col("links")).when(alone, F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.coalesce("id_component", F.when(F.col("n") > 0, F.col("component")), "id")).alias("component_id"),
    )
