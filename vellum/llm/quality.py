"""Quality classifier: Naive Bayes support vectors.

Indicators of word 1- and 2-grams and byte 1- to 3-grams are scaled by their class log-count ratios;
a linear hinge-loss model is fitted on them by dual coordinate descent, with costs that weigh both
classes alike. A logistic curve over its margin gives a score; it is fitted on rows set apart, each
class weighed by its share of all labelled rows, so that 0.5 is where either label is as likely.

The model is fitted on at most PER_CLASS labelled texts of each class, chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, slices, table
from .grams import SPECTRUM, present_places, sample_per_class, spectrum

SLICE = 256  # texts scored together
PER_CLASS = 2000
WORD_BITS = 17
WIDTH = SPECTRUM + (1 << WORD_BITS)
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 30
CHUNK = 1 << 16  # words hashed together


def indicators(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Sorted places of the n-grams present in an A-Z lower-cased whole text; `seen` has SPECTRUM places at least."""
    low = text.lower()
    places = [spectrum(low, seen[:SPECTRUM])]
    words = low.split()
    for at in range(0, len(words), CHUNK):
        h = np.fromiter(map(crc32, words[at : at + CHUNK + 1]), np.uint32)
        both = h[:-1] * np.uint32(0x9E3779B1) ^ h[1:] * np.uint32(0x85EBCA6B)
        mixed = np.concatenate([h, both]) * np.uint32(0xC2B2AE35)
        places.append((mixed >> np.uint32(32 - WORD_BITS)).astype(np.int64) + SPECTRUM)
    return np.concatenate([places[0], np.unique(np.concatenate(places[1:]))]) if words else places[0]


@dataclass
class NBSVM:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, places: list[np.ndarray]) -> np.ndarray:
        """Of each row of present places, by one sum over all rows' weights."""
        size = np.array([len(p) for p in places], np.int64)
        row = np.repeat(np.arange(len(places)), size)
        margin = np.bincount(row, self.weights[np.concatenate([np.zeros(0, np.int64), *places])], len(places)) / np.sqrt(np.maximum(1, size)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model over sparse rows. rows[i]: its places; an entry at place p is values[p] / sqrt(len)."""
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(y))
    scaled = [values[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([x @ x + 1 for x in scaled])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * scaled[i]
                bias += step
                most = max(most, abs(step) / cost[i])
        if most < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps."""
    x, theta, t = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0]), (y + 1) / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (t - p)) - 1e-3 * theta)
        theta += step
        if abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(train: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", per_class: int = PER_CLASS) -> NBSVM:
    """Fit on rows labelled 0 or 1; other labels and null texts are left out. With fewer than two
    classes the model scores every text with the one class there is, or 0.5 without any, which
    predicts 1: a filter at 0.5 then keeps all. N-grams seen in one or two of the fitted texts have
    weight 0, as nothing can be told from them."""
    usable = train.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull())
    share = {str(r["label"]): r["count"] for r in usable.groupBy(F.col(label_col).cast("string").alias("label")).count().collect()}
    sample = sample_per_class(usable, label_col, per_class, id_col, text_col)
    labels, rows = present_places(sample, indicators, WIDTH)
    y = np.array([1.0 if x == "1" else -1.0 for x in labels])
    if len(set(labels)) < 2:
        return NBSVM(np.zeros(WIDTH, np.float32), 0.0, 1e-3, 0.0 if not labels else 4.0 * y[0])
    apart = np.arange(len(y)) % 5 == 4 if min((y > 0).sum(), (y < 0).sum()) >= 50 else np.zeros(len(y), bool)
    fitted = np.flatnonzero(~apart)
    counts = {k: np.full(WIDTH, SMOOTHING) for k in (1.0, -1.0)}
    for i in fitted:
        counts[y[i]][rows[i]] += 1
    n = {k: (y[fitted] == k).sum() for k in (1.0, -1.0)}
    ratio = np.log(counts[1.0] / n[1.0] / (counts[-1.0] / n[-1.0]))
    ratio[counts[1.0] + counts[-1.0] < 2 * SMOOTHING + 3] = 0  # seen in one or two texts: nothing to go by
    cost = np.array([COST * len(fitted) / 2 / n[y[i]] for i in fitted])
    w, bias = dual_coordinate_descent([rows[i] for i in fitted], ratio, y[fitted], cost)
    weights = (w * ratio).astype(np.float32)
    curve = np.flatnonzero(apart) if apart.any() else fitted
    margin = np.array([weights[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) for i in curve]) + bias
    each = np.where(y[curve] > 0, share["1"] / (y[curve] > 0).sum(), share["0"] / (y[curve] < 0).sum())
    return NBSVM(weights, bias, *logistic(margin, y[curve], each * len(curve) / each.sum()))


def predict(docs: DataFrame, model: NBSVM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row of `docs`, from the whole text and nothing else.

    Null and empty texts hold no n-gram and get the score of the bias. Repeated rows and ids each
    give their row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, np.zeros(WIDTH, bool)
        for b in batches:
            for part in slices(b, SLICE):
                score = m.score([indicators(x or b"", seen) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, score double")


def keep_good(docs: DataFrame, model: NBSVM, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that the model scores at `threshold` or more, in one pass, with all their columns."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, np.zeros(WIDTH, bool)
        for b in batches:
            for part in slices(b, SLICE):
                texts = part.column(names.index(text_col)).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array(m.score([indicators(x or b"", seen) for x in texts]) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: labelled documents whose id is not held out. Null ids join nothing."""
    rows = docs.select("doc_id", "text").where(id_remainder(F.col("doc_id"), 3) != 1)
    return rows.join(labels.select("doc_id", "quality").where("quality is not null"), "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    model = fit(labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    found = predict(table(spark, sf_dir, "documents"), model)
    return found.select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
