"""Benchmark decontamination: an FM-index per shard of the corpus, searched for test windows.

A shard is a run of whole documents inside a task.  Words outside the benchmark's
vocabulary can't be part of a match, so each run of them becomes one stop symbol, as does
the end of each document.  All windows are searched at once; their occurrences are
located by sampled suffix positions and merged into spans of words.

The benchmark is the query set: it is read in blocks of ``block_words`` words, and only one
block at a time is sent to the executors, so what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .fm_index import FMIndex
from .scratch import written
from .textkit import ALNUM, LOWER, pieces, releasing, string_parts, word_hashes, words

#: Symbols after which a shard is indexed and searched.
SHARD = 1_000_000
SPAN = StructType().add("first", "long").add("last", "long")
FOUND = StructType().add("n_words", "long").add("spans", ArrayType(SPAN)).add("items", ArrayType(StringType()))


class Windows:
    """Distinct windows of a block of benchmark items, as symbol strings."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        data, offsets = string_parts(pa.array([t for _, t in items], pa.string()))
        low = LOWER[data]
        starts, ends, bounds = words(low, offsets, ALNUM)
        h = word_hashes(low, starts, ends)
        self.names = sorted({x for x, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h) + 1
        count = np.maximum(np.diff(bounds) - width + 1, np.minimum(np.diff(bounds), 1))  # windows of each item
        item = np.repeat(np.arange(len(items)), count)
        start = bounds[:-1][item] + np.arange(len(item)) - (np.cumsum(count) - count)[item]
        length = np.minimum(np.diff(bounds)[item], width)
        place = np.arange(width) - (width - length)[:, None]  # short windows stand at the right
        each = np.zeros((len(item), width), np.int32)
        inside = place >= 0
        each[inside] = ids[(start[:, None] + place)[inside]]
        self.symbols, which = np.unique(each, axis=0, return_inverse=True)
        self.lengths = np.count_nonzero(self.symbols, axis=1)
        name = np.array([number[x] for x, _ in items], np.int64)[item]
        pairs = np.unique(np.stack([which.reshape(-1), name]), axis=1) if len(item) else np.zeros((2, 0), np.int64)
        self.owner, self.owner_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.symbols) + 1))

    def owners(self, window: int) -> list[int]:
        """Numbers of the items that have a window."""
        return self.owner[self.owner_at[window] : self.owner_at[window + 1]].tolist()

    def encode(self, h: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 outside the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def _search_shard(docs: list[tuple[object, np.ndarray]], windows: Windows) -> Iterator[tuple]:
    """Rows of FOUND for the documents (row, symbols of its words) of one shard."""
    sizes = np.array([len(s) for _, s in docs], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]  # one stop symbol behind each document
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    for b, (_, s) in zip(begin.tolist(), docs):
        text[b : b + len(s)] = s
    keep = (text > 0) | np.concatenate(([True], text[:-1] > 0))  # of a run of stops the first stays
    place = np.flatnonzero(keep)
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    if len(windows.lengths) and len(place):
        index = FMIndex(text[keep], len(windows.vocabulary))
        low, high = index.search(windows.symbols, windows.lengths)
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        rows = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        which = np.repeat(hit, many)
        at = place[index.locate(rows)]
        delta = np.zeros(len(text) + 1, np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + windows.lengths[which], -1)
        inside = np.concatenate(([False], np.cumsum(delta) > 0))
        first, last = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
        for d, a, b in zip((np.searchsorted(begin, first, "right") - 1).tolist(), first.tolist(), last.tolist()):
            spans.setdefault(d, []).append({"first": a - int(begin[d]), "last": b - int(begin[d])})
        pair = np.unique(np.stack([np.searchsorted(begin, at, "right") - 1, which]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        for d, w in zip(*pair.tolist()):
            items.setdefault(d, set()).update(windows.owners(w))
    for d, (row, s) in enumerate(docs):
        yield row, len(s), spans.get(d, []), [windows.names[i] for i in sorted(items.get(d, ()))]


def _scan(shared):
    kinds = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def out(docs, windows, own):
        rows = list(zip(*_search_shard(docs, windows)))
        schema = pa.schema([own, *kinds])  # ids keep their type
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    def run(batches):
        windows, docs, size = shared.value, [], 0
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            ids, own = batch.column("row").to_pylist(), batch.schema.field("row")
            for i, j in pieces(offsets):
                cut = offsets[i : j + 1] - offsets[i]
                low = LOWER[data[offsets[i] : offsets[j]]]
                starts, ends, bounds = words(low, cut, ALNUM)
                symbols = windows.encode(word_hashes(low, starts, ends))
                for d, a, b in zip(ids[i:j], bounds[:-1].tolist(), bounds[1:].tolist()):
                    docs.append((d, symbols[a:b].astype(np.int32)))
                    size += b - a + 1
                if size >= SHARD:
                    yield out(docs, windows, own)
                    docs, size = [], 0
        if docs:
            yield out(docs, windows, own)

    return run


def _merged(batches):
    """Sorted spans that touch or overlap become one."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        merged = []
        for spans in batch.column("spans").to_pylist():
            own: list[dict] = []
            for s in spans:
                if own and s["first"] <= own[-1]["last"]:
                    own[-1]["last"] = max(own[-1]["last"], s["last"])
                else:
                    own.append(s)
            merged.append(own)
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, "spans", pa.array(merged, kind))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for name, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if name is None or not text:
            continue
        block.append((name, text))
        size += text.count(" ") + 1
        if size >= most:
            yield block
            block, size = [], 0
    yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """Per row of ``docs``: id, n_words, spans of words to remove, names of the items found.

    A window is ``width`` consecutive words of an item, or all of a shorter one.  Spans count
    words from 0 and exclude their last.  Null and empty texts have no words and no spans; items
    with a null id or without words find nothing; items that share an id count as one; repeated
    rows each give a row.  Ids keep their type.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = list(_take_two(_blocks(benchmark, item_col, item_text_col, block_words)))
    if len(blocks) == 1:  # the id itself serves as row
        shared = spark.sparkContext.broadcast(Windows(blocks[0], width))
        schema = StructType([StructField("row", docs.schema["id"].dataType), *FOUND.fields])
        return docs.withColumnRenamed("id", "row").mapInArrow(releasing(_scan(shared)), schema).withColumnRenamed("row", id_col)
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    schema = StructType([StructField("row", LongType()), *FOUND.fields])
    found = None
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast(Windows(block, width))
        part = written(rows.select("row", "text").mapInArrow(releasing(_scan(shared)), schema), "found")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    spans, items = F.array_sort(F.flatten(F.collect_list("spans"))), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    once = found.groupBy("row").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), items.alias("items"))
    once = once.mapInArrow(_merged, schema)
    return rows.select("row", F.col("id").alias(id_col)).join(once, "row").drop("row")


def _take_two(blocks: Iterator) -> Iterator:
    """No more than two: enough to know whether one is all."""
    for _, block in zip(range(2), blocks):
        yield block


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of what ``find_benchmark`` found."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
