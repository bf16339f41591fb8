"""Quality classifier: naive Bayes support vectors (NBSVM) over character n-gram indicators.

Indicators are scaled by the log ratio of their smoothed counts in both classes; a
linear model with hinge loss is fitted to them by dual coordinate descent, and its
margin turned into a probability by a logistic curve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import _text_pieces, sample_rows

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)


def indicators(texts: list) -> list[np.ndarray]:
    """Sorted distinct hashed n-grams (of the orders together, case kept) of each text; none of null or empty texts."""
    out = []
    flag = np.zeros(BUCKETS, bool)
    for text in texts:
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(codes), np.uint32)
        for order in ORDERS:
            h = (h[: len(codes) - order + 1] ^ codes[order - 1 :]) * np.uint32(0x9E3779B1) if len(codes) >= order else h[:0]
            h ^= h >> np.uint32(15)
            flag[((h + np.uint32(order)) * np.uint32(0x85EBCA6B)) >> np.uint32(16)] = True
        out.append(np.flatnonzero(flag))
        flag[out[-1]] = False
    return out


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 1) -> np.ndarray:
    """Weights of the linear model with hinge loss; the last weight is the bias."""
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * cost.max():
            break
    return w


def logistic_fit(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve over margins, by Newton steps, slightly ridged."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    up, n = label.sum(), len(label)
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (n - up + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (theta - [1, 0]))
        theta = theta - np.clip(step, -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


class QualityModel:
    """Weight of each indicator (ratio and hinge weight together), bias, curve."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, offset: float):
        self.weight, self.bias, self.slope, self.offset = weight, bias, slope, offset

    def margins(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weight[r].sum() / np.sqrt(max(1, len(r))) for r in found]) + self.bias

    def scores(self, texts: list) -> np.ndarray:
        z = self.slope * self.margins(indicators(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nbsvm(found: list[np.ndarray], label: np.ndarray, cost: float = 1.0, epochs: int = 30, folds: int = 4) -> QualityModel:
    """Rows are scaled to length by the root of their number of indicators.  One class only gives a constant score."""
    if len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 0.5
        share = min(max(share, 0.01), 0.99)
        return QualityModel(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))

    def fit(use: np.ndarray) -> tuple[np.ndarray, float]:
        up, down = np.ones(BUCKETS), np.ones(BUCKETS)
        for i in use.tolist():
            (up if label[i] else down)[found[i]] += 1
        n1 = label[use].sum()
        ratio = np.log(up / (n1 + 2)) - np.log(down / (len(use) - n1 + 2))
        rows = [found[i] for i in use.tolist()]
        values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
        balance = np.where(label[use] == 1, len(use) / (2 * max(n1, 1)), len(use) / (2 * max(len(use) - n1, 1)))
        w = dual_coordinate_descent(rows, values, label[use] * 2.0 - 1, cost * balance, epochs)
        return w[:-1] * ratio, float(w[-1])

    fold = np.random.default_rng(2).permutation(len(label)) % folds
    margin = np.zeros(len(label))
    for k in range(folds):  # margins of rows that the weights haven't seen
        weight, bias = fit(np.flatnonzero(fold != k))
        own = np.flatnonzero(fold == k)
        margin[own] = QualityModel(weight, bias, 1, 0).margins([found[i] for i in own.tolist()])
    weight, bias = fit(np.arange(len(label)))
    return QualityModel(weight.astype(np.float32), bias, *logistic_fit(margin, label))


def train_quality_model(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", most_rows: int = 4000, **how) -> QualityModel:
    """Fit on documents of at most ``most_rows`` labels (the bound of the sample), whose indicators alone go to the driver.

    Labels other than 0 and 1 and null ids are left out; of an id with several labels the highest holds.
    """
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    labels = sample_rows(labels, id_col, most_rows).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(labels), "id").select("id", "label", "text")

    def run(batches):
        for batch in batches:
            found = [r.astype(np.uint16).tobytes() for r in indicators(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(found, pa.binary())], names=["id", "label", "found"])

    got = sorted(tuple(r) for r in rows.mapInArrow(run, rows.select("id", "label").schema.add("found", "binary")).collect())
    return fit_nbsvm([np.frombuffer(bytes(r[2]), np.uint16).astype(np.int64) for r in got], np.array([r[1] for r in got], np.int64), **how)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted (1 from ``least``); other columns pass unchanged.

    Null and empty texts have no indicators and get the score of the bias.  Columns of ``docs``
    called score or predicted are replaced.  Whole texts count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    rest = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            s = shared.value.scores(texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(s), pa.array((s >= least).astype(np.int32))], names=[*rest, "score", "predicted"])

    schema = docs.select(*rest).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*rest).mapInArrow(run, schema)
