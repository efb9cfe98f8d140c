"""Language identification by a string kernel.

The kernel of two texts is the normalised number of byte 1-, 2- and 3-grams (a blended spectrum) that
both hold. Landmark texts give a Nyström feature map, on which one-versus-rest kernel ridge
regression is fitted. Since the kernel is a scalar product of presence vectors, landmarks, map and
regression fold into one weight matrix, and a batch is scored by a product with it.

The model is fitted on at most PER_LANGUAGE texts of each language, chosen by a hash of the id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, table
from .grams import SPECTRUM, present_places, sample_per_class, spectrum

PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-2
SHARPNESS = 4.0  # of the softmax that turns regression values into a score
BATCH = 64  # texts scored by one product
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class StringKernelModel:
    languages: list[str]
    weights: np.ndarray  # SPECTRUM x languages
    bias: np.ndarray

    def decide(self, presence: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Best language and score of each row of present places, by a product of the batch's presence
        matrix, as far as its columns hold anything, with their weights."""
        used, place = np.unique(np.concatenate(presence), return_inverse=True)
        size = np.array([len(p) for p in presence])
        there = np.zeros((len(presence), len(used)), np.float32)
        there[np.repeat(np.arange(len(size)), size), place] = np.repeat(1 / np.sqrt(size), size)
        value = SHARPNESS * (there @ self.weights[used] + self.bias)
        value = np.exp(value - value.max(axis=1, keepdims=True))
        return value.argmax(axis=1), (value.max(axis=1) / value.sum(axis=1)).astype(np.float64)


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> StringKernelModel:
    """Fit on rows with a language and text; rows without either are left out. No rows: no language."""
    usable = train.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    sample = sample_per_class(usable, lang_col, per_language, id_col, text_col)
    labels, places = present_places(sample, spectrum, SPECTRUM)
    languages = sorted(set(labels))
    if not languages:
        return StringKernelModel([], np.zeros((SPECTRUM, 0), np.float32), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])

    def unit(rows) -> np.ndarray:
        x = np.zeros((len(rows), SPECTRUM), np.float32)
        for i, r in enumerate(rows):
            x[i, places[r]] = 1 / np.sqrt(max(1, len(places[r])))
        return x

    marks = np.concatenate([np.flatnonzero(y == k)[:: max(1, (y == k).sum() // LANDMARKS_PER_LANGUAGE)][:LANDMARKS_PER_LANGUAGE] for k in range(len(languages))])
    landmarks = unit(marks)
    kernel = np.concatenate([unit(range(at, min(at + 128, len(y)))) @ landmarks.T for at in range(0, len(y), 128)]).astype(np.float64)
    value, vector = np.linalg.eigh(kernel[marks])
    good = value > value.max() * 1e-8
    nystrom = vector[:, good] / np.sqrt(value[good])
    phi = kernel @ nystrom
    target = 2.0 * (y[:, None] == np.arange(len(languages))) - 1
    share = np.array([(y == k).mean() for k in range(len(languages))])
    weight = (1 / share)[y][:, None] / len(languages)  # each language counts alike
    bias = (weight * target).sum(axis=0) / weight.sum()
    solved = np.linalg.solve(phi.T @ (weight * phi) + RIDGE * len(y) / 100 * np.eye(phi.shape[1]), phi.T @ (weight * (target - bias)))
    return StringKernelModel(languages, (landmarks.T @ (nystrom @ solved)).astype(np.float32), bias)


def predict(docs: DataFrame, model: StringKernelModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row of `docs`, from the whole text and nothing else.

    A null text, one without any letter, or a model without languages gives `und` with score 0.
    Repeated rows and ids each give their row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, np.zeros(SPECTRUM, bool)
        for b in batches:
            lang, score = np.full(b.num_rows, UNDETERMINED, object), np.zeros(b.num_rows)
            texts = b.column(1).to_pylist()
            known = [i for i, x in enumerate(texts) if has_letter(x)] if m.languages else []
            for at in range(0, len(known), BATCH):
                rows = known[at : at + BATCH]
                best, value = m.decide([spectrum(texts[i], seen) for i in rows])
                lang[rows], score[rows] = np.array(m.languages, object)[best], value
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    found = predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), 3) == 1).alias("held_out"), "lang_pred", "score")
