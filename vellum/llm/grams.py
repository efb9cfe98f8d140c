"""Hashed n-gram presence features shared by the text classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

TRIGRAM_BITS = 16
#: One place for each byte and byte pair; byte triples share 2**16 places.
SPECTRUM = 256 + (1 << 16) + (1 << TRIGRAM_BITS)
BROADCAST_IDS = 100_000
CHUNK = 1 << 20  # bytes looked at together, so that memory stays small on very long texts


def spectrum(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Sorted places of the byte 1-, 2- and 3-grams present in an A-Z lower-cased whole text.

    `seen` is a cleared bool array of SPECTRUM places; it is cleared again on return.
    """
    a = np.frombuffer(text.lower(), np.uint8)
    for at in range(0, len(a), CHUNK):
        x = a[at : at + CHUNK + 2].astype(np.uint32)
        seen[x] = True
        if len(x) > 1:
            pair = x[:-1] << np.uint32(8) | x[1:]
            seen[pair + np.uint32(256)] = True
            if len(x) > 2:
                mixed = (pair[:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
                seen[(mixed >> np.uint32(32 - TRIGRAM_BITS)) + np.uint32(256 + (1 << 16))] = True
    places = np.flatnonzero(seen)
    seen[places] = False
    return places


SLICES = 32  # a label's rows are ranked in so many slices before they meet


def _least(rows: DataFrame, per_class: int) -> DataFrame:
    """Of (label, order, ...) rows, the per_class least of each label: first of each slice of a label,
    so that one label's task sees SLICES * per_class rows at most."""
    for by in (("label", F.pmod(F.hash("order"), F.lit(SLICES))), ("label",)):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("order"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= per_class).drop("rank")
    return rows


def sample_per_class(rows: DataFrame, label: str, per_class: int, id_col: str, text: str) -> DataFrame:
    """(label, t): at most `per_class` rows of each label, by a hash of the id; t is the text in bytes.

    Ids are chosen first, without their texts, which only the chosen rows are then read for. Rows
    that share an id come together, so the bound is applied once more to what was read. Whatever
    else `rows` holds and however it is named is left out.
    """
    order = F.struct(F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)).alias("order")
    ids = _least(rows.select(F.col(label).alias("label"), order, F.col(id_col).alias("id")), per_class).select("id").distinct()
    ids = materialize(ids, "sample-ids")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = rows.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi")  # reaches the scan of the texts
    return _least(chosen.select(F.col(label).alias("label"), order, F.col(text).cast("binary").alias("t")), per_class).select("label", "t")


def present_places(rows: DataFrame, features, width: int) -> tuple[list[str], list[np.ndarray]]:
    """Labels and sorted present places of a bounded sample of (label, t) rows, computed on the executors.

    `features(text, seen)` gives the places. A row is sent as its places or, where smaller, as width
    bits, so it takes width / 8 bytes at most whatever its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width, bool)
        for b in batches:
            packed = []
            for text in b.column(1).to_pylist():
                places = features(text or b"", seen)
                if 32 * len(places) < width:
                    packed.append(b"p" + places.astype("<i4").tobytes())
                else:
                    row = np.zeros(width, bool)
                    row[places] = True
                    packed.append(b"b" + np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["label", "packed"])

    got = rows.select(F.col("label").cast("string"), "t").mapInArrow(run, "label string, packed binary").toArrow()
    both = sorted(zip(got["label"].to_pylist(), got["packed"].to_pylist()))  # whatever order tasks end in
    found = [np.frombuffer(x, "<i4", -1, 1) if x[:1] == b"p" else np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8, -1, 1), count=width)).astype(np.int32) for _, x in both]
    return [x for x, _ in both], found
