"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct shingles of ``k`` words (of a shorter line its whole sequence of
words).  In a common order of tokens, two lines with Jaccard similarity num/den share one of the
first n - ceil(num/den * n) + 1 of each (their prefixes), at places from which the overlap can still
be reached (prefix, positional and length filters).  Equal token sets are one line from the start.

The order is by rarity: tokens that no other line has in its prefix come first, the others follow.  The prefix itself is
cut by hash, so that it can be cut before anything is counted and only prefixes are ever shuffled.  A token that one line
alone has in its prefix may still be in another line behind its prefix, but of a similar pair the longer line has no more such tokens
than it has tokens of its own (``_may_reach``), so its place counts them; the shorter line's place is that by hash.

Whether a line goes depends only on some earlier line being similar, so candidates are found by
semi joins: their output is at most one row for each posting, however many copies a line has.
Sets are compared only where their parity bitmaps differ in few enough bits.

Tokens are made by DataFrame functions (``native``) or in numpy.  All that follows is joins and
aggregations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import only_ids
from .scratch import drop, written, written_at
from .textkit import NOT_BLANK, mix, pieces, shingles, string_parts, word_hashes, words

#: Removed lines up to which their list may be broadcast (8 bytes each); beyond, texts are shuffled by id.
BROADCAST_LINES = 2_000_000
#: Tokens of several lines up to which their set may be broadcast (8 bytes each); beyond, postings are shuffled.
BROADCAST_TOKENS = 3_000_000
#: Lines up to which a list of them may be broadcast (16 to 28 bytes each).
BROADCAST_WANTED = 1_000_000
#: Longs of a line's parity bitmap, a power of two: one alone tells little of lines of over 100 tokens.
BITMAPS = 4


def _token_sets(data: np.ndarray, offsets: np.ndarray, k: int, least_words: int):
    """Token sets of the lines of some texts: text and line of each, where its tokens start, all tokens sorted."""
    starts, ends, bounds = words(data, offsets, NOT_BLANK)
    breaks = np.flatnonzero(data == 10)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    unit = np.searchsorted(breaks, starts) + text  # a number for each line, growing over all texts
    h = word_hashes(data, starts, ends)
    n = max(0, len(h) - k + 1)
    size = np.bincount(unit)[unit]
    keep = np.flatnonzero((unit[:n] == unit[k - 1 :][:n]) & (size[:n] >= least_words)) if n else np.zeros(0, np.int64)
    token = shingles(h, k)[keep]
    lead = np.flatnonzero(np.diff(unit, prepend=-1))
    for m in range(max(1, least_words), k):  # a shorter line has one token, its whole sequence
        at = lead[size[lead] == m]
        keep, token = np.concatenate([keep, at]), np.concatenate([token, shingles(h, m)[at]])
    unit, text, token = unit[keep], text[keep], token.view(np.int64)
    order = np.lexsort((token, unit))
    token, unit, text = token[order], unit[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (unit[1:] != unit[:-1])
    token, unit, text = token[new], unit[new], text[new]
    at = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))) if len(unit) else np.zeros(0, np.int64)
    text = text[at]
    line = unit[at] - text - np.searchsorted(breaks, offsets[:-1])[text]
    return text, line, at, token


def _runs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


LINES = "id long, line int, key1 long, key2 long, n int, tokens array<long>"


def _lines(k: int, num: int, den: int, least_words: int, whole: bool):
    """Rows of ``LINES``: two hashes of the token set, its size, and its prefix by hash (or all of it)."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            data, offsets = string_parts(batch.column("low"))
            for a, b in pieces(offsets):
                text, line, at, token = _token_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k, least_words)
                if not len(at):
                    continue
                n = np.diff(np.concatenate((at, [len(token)])))
                bits = token.view(np.uint64)
                key1, key2 = (pa.array(np.add.reduceat(mix(x), at).view(np.int64)) for x in (bits.copy(), bits ^ np.uint64(0x5851F42D4C957F2D)))
                size = n if whole else n - (n * num + den - 1) // den + 1
                held = token if whole else token[np.arange(len(token)) - np.repeat(at, n) < np.repeat(size, n)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][text]), pa.array(line.astype(np.int32)), key1, key2, pa.array(n.astype(np.int32)), _runs(held, size)], names=["id", "line", "key1", "key2", "n", "tokens"])

    return run


def _spaced(low: Column) -> Column:
    for blank in "\t\x0b\x0c\r":  # one by one is several times faster than translate
        low = F.replace(low, F.lit(blank), F.lit(" "))
    return low


def _once(value: Column) -> Column:
    """``value`` as a generator of one row: what filters and later columns read of it isn't computed again for each."""
    return F.explode(F.array(value))


def _native_lines(docs: DataFrame, k: int, num: int, den: int, least_words: int, whole: bool, wanted: DataFrame | None = None) -> DataFrame:
    """Rows of ``LINES`` of texts (id, text) by functions alone; of the lines ``wanted`` (id, line), if given, only."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    if wanted is not None:
        lines = lines.join(wanted, ["id", "line"], "left_semi")

    def runs(w: Column) -> Column:
        # nulls behind the last word of a line of under k words leave a hash as it is
        first = F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))
        return F.when(F.size(w) >= max(1, least_words), F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])))

    # the words go through a one-element array: cut once, read in place by each run, and never copied into a row
    words = F.array_remove(F.split(_spaced(F.lower("s")), " "), "")
    hashed = lines.select("id", "line", _once(F.get(F.transform(F.array(words), runs), 0)).alias("h")).where("h is not null")
    made = hashed.select("id", "line", _once(F.sort_array(F.array_distinct("h"))).alias("t"))
    n = F.size("t")
    prefix = F.slice("t", F.lit(1), n - F.floor((n * num + (den - 1)) / F.lit(den)).cast("int") + 1)
    return made.select("id", "line", F.xxhash64("t").alias("key1"), F.xxhash64(F.lit(1), "t").alias("key2"), n.alias("n"), (F.col("t") if whole else prefix).alias("tokens"))


def _earlier(y: str, x: str) -> Column:
    c = F.col
    return (c(f"{y}.id") < c(f"{x}.id")) | ((c(f"{y}.id") == c(f"{x}.id")) & (c(f"{y}.line") < c(f"{x}.line")))


def _may_reach(x: str, y: str, num: int, den: int) -> Column:
    """Length and positional filter for postings of one token.

    Let the longer line x have a tokens that y lacks, and y have b that x lacks, so n - m = a - b.  Of the p(n) tokens in x's
    prefix those that y lacks or has behind its own prefix are at most max(a, p(n) - p(m) + b), and that is a, as p grows by no more than n does.
    """
    xn, yn = F.col(f"{x}.n"), F.col(f"{y}.n")
    xp, yp = F.when(xn >= yn, F.col(f"{x}.pos")).otherwise(F.col(f"{x}.at")), F.when(yn >= xn, F.col(f"{y}.pos")).otherwise(F.col(f"{y}.at"))
    fits = (yn * den >= xn * num) & (xn * den >= yn * num)
    # overlap o reaches num/den if o * (num + den) >= num * (n + m)
    return fits & (F.least(xn - xp, yn - yp) * (num + den) >= (xn + yn) * num)


def _alike(num: int, den: int) -> Column:
    return F.size(F.array_intersect("x.t", "y.t")) * (num + den) >= (F.col("x.n") + F.col("y.n")) * num


def _bitmaps(sets: DataFrame, which: list[str]) -> DataFrame:
    """``which`` and ``bits``, ``BITMAPS`` longs: whether the tokens ``t`` of each remainder are odd in number."""
    own = [F.expr(f"bit_xor(case when (token >> 6) & {BITMAPS - 1} = {j} then shiftleft(1L, cast(token & 63 as int)) else 0L end)").alias(f"b{j}") for j in range(BITMAPS)]
    bits = sets.select(*which, F.explode("t").alias("token")).groupBy(*which).agg(*own)
    return bits.select(*which, F.struct(*[f"b{j}" for j in range(BITMAPS)]).alias("bits"))


def _bits_fit(num: int, den: int) -> Column:
    """Bits that differ are no more than the tokens that differ, n + m - 2 * o."""
    differ = sum((F.bit_count(F.col(f"x.bits.b{j}").bitwiseXOR(F.col(f"y.bits.b{j}"))) for j in range(BITMAPS)), F.lit(0))
    return differ * (num + den) <= (F.col("x.n") + F.col("y.n")) * (den - num)


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df``, a written table, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= most else df


def similar_lines(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, least_words: int = 5, native: bool = True) -> DataFrame:
    """(id, line) of the lines of ``docs`` (id, text) that an earlier line is similar to."""
    spark = docs.sparkSession
    low = docs.select("id", F.lower("text").alias("low"))  # of numpy's form; the native one lower-cases lines
    which = ["id", "line", "key1"]
    made = _native_lines(docs, k, num, den, least_words, False) if native else low.mapInArrow(_lines(k, num, den, least_words, False), LINES)
    lines, lines_uri = written_at(made, "lines")
    # of equal sets, the first one's postings are compared
    # first id, then line: longs are aggregated in compiled code, a struct or decimal isn't
    same = lines.groupBy("key1", "key2").agg(F.count("*").alias("c"), F.min("id").alias("first_id"))
    same = written(same.where("c > 1").select("key1", "key2", "first_id"), "repeated")
    same = lines.join(_small(same, BROADCAST_WANTED), ["key1", "key2"]).where("id = first_id")
    same = written(same.groupBy("key1", "key2", "first_id").agg(F.min("line").alias("first_line")), "same")
    told = lines.join(_small(same, BROADCAST_WANTED), ["key1", "key2"], "left")
    later = F.col("first_id").isNotNull() & ((F.col("id") != F.col("first_id")) | (F.col("line") != F.col("first_line")))
    copies, own = written(told.where(later).select("id", "line"), "copies"), told.where(~later)

    # most prefix tokens occur once: only those of two lines or more are joined
    held = written(own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "held")
    postings = own.select(*which, "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "token")).join(_small(held, BROADCAST_TOKENS), "token", "left_semi")
    postings = postings.groupBy(*which, "n", "size").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("own"))
    postings = postings.select(*which, "n", (F.col("size") - F.size("own")).alias("before"), F.posexplode("own").alias("place", "o"))
    postings = written(postings.select(*which, "n", (F.col("before") + F.col("place")).alias("pos"), "o.at", "o.token"), "postings")
    drop(spark, lines_uri)
    x, y = postings.alias("x"), postings.alias("y")
    pair = (F.col("x.token") == F.col("y.token")) & _earlier("y", "x") & _may_reach("x", "y", num, den)
    later = written(x.join(y, pair, "left_semi").select("x.*"), "later")
    x = later.alias("x")
    partner = written(y.join(x, pair, "left_semi").select("y.*"), "partner")
    wanted = written(later.select(*which).union(partner.select(*which)).distinct(), "wanted")

    places = _small(wanted, BROADCAST_WANTED)
    texts = only_ids((docs if native else low).where("id is not null"), wanted.select("id").distinct(), "left_semi")
    again = _native_lines(texts, k, num, den, least_words, True, places.select("id", "line")) if native else texts.mapInArrow(_lines(k, num, den, least_words, True), LINES)
    sets = again.select(*which, F.col("tokens").alias("t")).join(places, which)
    t = written(sets.dropDuplicates(which), "sets")
    bits = written(_bitmaps(t, which), "bits")
    x, y = later.join(bits, which).alias("x"), partner.join(bits, which).alias("y")
    fits = pair & _bits_fit(num, den)
    x = written(x.join(y, fits, "left_semi").select("x.*"), "fitting").alias("x")
    y = written(y.join(x, fits, "left_semi").select("y.*"), "fitted")
    x, y = x.join(t, which).alias("x"), y.join(t, which).alias("y")
    near = x.join(y, fits & _alike(num, den), "left_semi").select("x.id", "x.line")
    return copies.unionByName(near).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, least_words: int = 5, native: bool = True) -> DataFrame:
    """``docs`` without lines similar to an earlier one, with n_lines and n_removed.

    Earlier is by id, then by place in the text; the similarity is that of the sets of ``k``-word shingles,
    num/den or more, and equal lines have it.  Lines under ``least_words`` words, and those without words, stay; lines of
    ``least_words`` to ``k`` - 1 words go if they repeat an earlier line's words.  A null text stays
    null with no lines; rows with a null id pass unchanged and aren't compared.  Rows that repeat an id
    are judged by their lines' places as one document.  ``native`` says how tokens are made, not which
    lines go.  Other columns pass, whatever their names; those called n_lines or n_removed are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the rows travel as one struct, so that no name of theirs meets one made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    value = F.col("row").getField(text_col)
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    gone = similar_lines(ids.where("id is not null"), k, num, den, least_words, native)
    gone = written(gone.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("gone")), "gone")
    few = (gone.agg(F.sum(F.size("gone") + 2)).first()[0] or 0) <= BROADCAST_LINES
    rows = rows.join(F.broadcast(gone) if few else gone, F.col("row").getField(id_col).cast("long") == F.col("id"), "left")
    # split once, so that lines are taken by place in time linear in them
    rows = rows.select("row", "gone", _once(F.split(value, "\n")).alias("lines"))
    n = F.when(value.isNotNull(), F.size("lines")).otherwise(0).cast("long")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), value).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    removed = F.when(F.col("gone").isNull() | value.isNull(), F.lit(0).cast("long")).otherwise(F.size("lines").cast("long") - F.size(kept))
    return rows.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in rest], n.alias("n_lines"), removed.alias("n_removed"))
