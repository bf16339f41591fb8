"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import releasing

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: N-grams that count at most in a score: longer texts don't make it surer.
FULL_SCORE = 60

_LETTER = np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(1 << 16)])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, two blanks behind each; all but letters are blanks; offsets."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("  ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(codes, 0xFFFF)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 2 for t in low])))
    return np.where(_LETTER[small] | (codes > 0xFFFF), codes, np.uint32(32)), offsets


def gram_ids(codes: np.ndarray):
    """For each order the hashed n-gram that begins at each position."""
    h = np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        nxt = codes[order - 1 :]
        h[: len(nxt)] = (h[: len(nxt)] ^ nxt) * np.uint32(0x9E3779B1)
        h[len(nxt) :] = (h[len(nxt) :] ^ np.uint32(32)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if order in ORDERS:
            yield (((h + np.uint32(order)) * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64)


def _text_pieces(texts: list, limit: int = 1 << 19):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= limit):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _counts(batches):
    """N-gram counts of each label, one row for each label and batch."""
    for batch in batches:
        label, texts = batch.column("label").to_pylist(), batch.column("text").to_pylist()
        total: dict[str, np.ndarray] = {}
        for i, j in _text_pieces(texts):
            for name, text in zip(label[i:j], texts[i:j]):
                codes, _ = _codes([text])
                own = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                for ids in gram_ids(codes):
                    own += np.bincount(ids, minlength=BUCKETS)
        rows = [(name, int(b), int(c)) for name, own in total.items() for b, c in zip(np.flatnonzero(own), own[own > 0])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["label", "bucket", "count"])


def sample_rows(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashed ids; only ids are sorted."""
    ids = rows.select(F.col(f"`{id_col}`").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    return rows.join(F.broadcast(ids), rows[id_col] == ids["id"], "left_semi")  # most ids bound the broadcast


class LanguageModel:
    """Labels and log-probabilities (label, bucket) of n-grams, with uniform priors."""

    def __init__(self, labels: list[str], logs: np.ndarray):
        self.labels, self.logs = labels, logs

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Label and score of each text; ``und`` with score 0 for null and for texts without a letter."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        told = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        if not told or not self.labels:
            return names, scores
        codes, offsets = _codes([texts[i] for i in told])
        total = np.zeros((len(told), len(self.labels)))
        for ids in gram_ids(codes):
            for k, row in enumerate(self.logs):
                total[:, k] += np.add.reduceat(row[ids], offsets[:-1], dtype=np.float64)
        grams = len(ORDERS) * np.diff(offsets)
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total * np.minimum(1, FULL_SCORE / grams)[:, None])
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        scores[told] = p[np.arange(len(told)), best]
        for i, k in zip(told, best.tolist()):
            names[i] = self.labels[k]
        return names, scores


def train_language_model(rows: DataFrame, id_col="doc_id", text_col="text", label_col="lang", most_rows: int = 6000, alpha: float = 0.5) -> LanguageModel:
    """Fit on at most ``most_rows`` rows (the bound of the sample); null texts and labels are left out.

    The counts that reach the driver are one number for each label and bucket.  No rows give a
    model without labels, which answers ``und``.
    """
    rows = rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = sample_rows(rows, id_col, most_rows).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_counts, "label string, bucket int, count long").groupBy("label", "bucket").agg(F.sum("count").alias("count")).toPandas()
    labels = sorted(set(found["label"]))
    counts = np.full((len(labels), BUCKETS), alpha)
    counts[found["label"].map({x: i for i, x in enumerate(labels)}).to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] += found["count"].to_numpy(np.float64)
    return LanguageModel(labels, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; every other column passes unchanged.

    Null texts and texts without a letter are ``und`` with score 0.  Columns of ``docs`` that
    are called lang_pred or score are replaced.  Whole texts count; ties go to the first label.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # labels x BUCKETS floats
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            names, scores = [], []
            for i, j in _text_pieces(texts):
                a, b = shared.value.predict(texts[i:j])
                names += a
                scores.append(b)
            scores = np.concatenate(scores) if scores else np.zeros(0)
            columns = [batch.column(c) for c in rest] + [pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "lang_pred", "score"])

    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*rest).mapInArrow(releasing(run), schema)
