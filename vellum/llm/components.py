"""Connected components: spanning forests within tasks, star rounds across them, one task at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

IN_ONE_TASK = 1_000_000  # links, 16 bytes each, that one task joins; more go through star rounds first
CHUNK = 1 << 20  # links that a task joins before it passes their forest on


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> sorted distinct nodes and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            return nodes, nodes[label]
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> a link to the smallest node reached for every other node: the same components, a row a node."""
    nodes, root = roots_of(a, b)
    other = nodes != root
    return nodes[other], root[other]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) links -> links of the same components, fewer than there are nodes in each chunk."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        return star(*(np.concatenate(x) for x in zip(*held)))

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size > CHUNK:
            held = [fold()]
            size = len(held[0][0])
            if size > CHUNK // 2:
                yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["a", "b"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([*map(pa.array, fold())], ["a", "b"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        nodes, root = roots_of(*(np.concatenate(x) for x in zip(*got)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): every linked node with the smallest node it reaches.

    Each task first leaves a spanning forest of its links. While over IN_ONE_TASK remain, a round of
    large-star and small-star steps hangs neighbours onto the smallest node around them, so their number
    never grows and rounds are logarithmic in the length of the longest chain; then one task, whose input
    is so bounded, joins them. Only a count and a checksum per round reach the driver. Nulls and
    self-links are ignored; repeated links count once; no links give an empty table.
    """
    stars = materialize(links.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long"), "links")
    seen = _checksum(stars)
    while seen[0] > IN_ONE_TASK:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, stars = stars, materialize(joined.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        release(before)
        now = _checksum(stars)
        if now == seen:
            roots = stars.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
            return roots.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
    found = materialize(stars.coalesce(1).mapInArrow(_finish, "node long, root long"), "components")
    release(stars)
    return found


def _checksum(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]
