"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected onto a few random orthonormal directions, once for each curve, moved by
the curve's shift and placed on a grid; its key is its place along the Hilbert curve of that grid.
Rows are range-partitioned and sorted by (curve, key, id). A query's candidates are the rows within
a window of positions around its own on each curve; candidates of all curves are merged and ranked
by their distance on the original vectors.

The window is a share of the table. Vectors without structure (equal variance in all directions)
need a wide one: no ordering brings their neighbours together; see the README for measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .hilbert import hilbert_key
from .vectors import BLOCK, QUERY_BLOCK, Best, by_id, matrix, pack, probe, ranked, small_batches, unpack, usable

CURVES, DIMS, BITS, WINDOW = 12, 16, 3, 0.16
SEED = 5


def directions(dim: int, curves: int, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve a matrix of orthonormal columns and a shift of less than half a grid cube."""
    r = np.random.default_rng(SEED)
    return [(np.linalg.qr(r.normal(size=(dim, dim)))[0][:, : min(dims, dim)], r.random(min(dims, dim)) / 2) for _ in range(curves)]


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, window: float = WINDOW, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first, ties to the
    smaller id; score is the Euclidean distance. `is_query` is a condition on `id`.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids
    and lengths other than the most frequent one. Rows that repeat an id are one candidate, the
    nearest. A window of at least 2 k rows is looked at, so a small table is searched whole. An empty
    table gives an empty table.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vec_col, False)
    kind = rows.schema["v"].dataType.simpleString()  # floats travel as floats; all arithmetic is in doubles
    dtype, arrow = (np.float32, pa.float32()) if kind == "array<float>" else (np.float64, pa.float64())
    ways = directions(dim, curves, dims)
    mean = [F.avg(F.col("v")[i]) for i in range(dim)]
    spread = [F.stddev_pop(F.col("v")[i]) for i in range(dim)]
    n, *stats = rows.agg(F.count("*"), *mean, *spread).first()
    n = n or 0
    centre = np.array([x or 0.0 for x in stats[:dim]])
    width = 3.0 * np.sqrt(np.mean(np.square([x or 0.0 for x in stats[dim:]]))) or 1.0
    reach = max(2 * k, int(n * window / 2) + 1)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim) - centre
            for c, (way, shift) in enumerate(ways):
                grid = np.clip(((x @ way / width + 1) / 3 + shift * 2 / 3) * (1 << bits), 0, (1 << bits) - 1)
                at = hilbert_key(grid.astype(np.int64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int64)), pa.array(at), b.column(0), b.column(1)], ["run", "key", "id", "v"])

    keyed = rows.mapInArrow(key, f"run long, key long, id long, v {kind}")
    ordered = keyed.repartitionByRange("run", "key", "id").sortWithinPartitions("run", "key", "id")
    with small_batches(spark):
        blocks = materialize(pack(ordered.withColumn("at", F.col("key").cast("double")), dim, BLOCK, dtype), "curve-blocks")
        counts = blocks.groupBy("run", "part").agg(F.sum("n").alias("n")).collect()  # a row for each partition
        start, before = {}, {}
        for r in sorted(counts, key=lambda r: (r["run"], r["part"])):
            start[r["run"], r["part"]] = before.get(r["run"], 0)
            before[r["run"]] = before.get(r["run"], 0) + r["n"]
        starts = spark.createDataFrame([(a, b, x) for (a, b), x in start.items()] or [(-1, -1, 0)], "run long, part int, offset long")
        # Rows before the block in its partition and curve: blocks are full but for the last of a curve.
        from pyspark.sql.window import Window

        earlier = Window.partitionBy("run", "part").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
        shape = blocks.select("run", "part", "no", "n").withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        shape = shape.join(starts, ["run", "part"]).select("run", "part", "no", "n", (F.col("offset") + F.col("inside")).alias("start"))
        shape = materialize(shape, "positions")
        placed = blocks.join(shape.select("part", "no", "start"), ["part", "no"])

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The rows of blocks, with their positions."""
            for b in batches:
                for r in b.to_pylist():
                    ids, x = unpack(r["ids"], r["data"], dim, dtype)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["run"], np.int64)), pa.array(r["start"] + np.arange(len(ids))), pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(dtype)), dim).cast(pa.list_(arrow))], ["run", "at", "id", "v"])

        asked = placed.select("run", "start", "ids", "data").mapInArrow(pick, f"run long, at long, id long, v {kind}").where(is_query)
        asked = pack(asked.repartitionByRange("run", "at").sortWithinPartitions("run", "at"), dim, QUERY_BLOCK, dtype)
        asked = materialize(asked.withColumn("extra", F.lit(None).cast("binary")), "curve-queries")
        near = asked.select(F.col("part").alias("qpart"), F.col("no").alias("qno"), "run", F.col("first").alias("a"), F.col("last").alias("z"))
        pairs = near.join(shape, "run").where((F.col("start") <= F.col("z") + reach) & (F.col("start") + F.col("n") > F.col("a") - reach))
        pairs = pairs.select("qpart", "qno", "part", "no", (F.abs(F.col("start") - (F.col("a") + F.col("z")) / 2)).alias("gap"), "a")

        class Consumer:
            def __init__(self):
                self.best = {}

            def add(self, r):
                qids, q = unpack(r["qids"], r["qdata"], dim, dtype)
                ids, x = unpack(r["ids"], r["data"], dim, dtype)
                # A query block spans few positions, so its window is taken from its first to its last query.
                best = self.best.setdefault((r["qpart"], r["qno"]), Best(qids, k, np.full(len(qids), -np.inf)))
                square = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T)
                square[qids[:, None] == ids] = np.inf
                slack = 1e-12 * ((q * q).sum(1)[:, None] + (x * x).sum(1).max())
                least, own = by_id(-square, ids)
                if len(own) > k:
                    limit = -np.partition(least, -k, axis=1)[:, -k][:, None]
                else:
                    limit = np.full((len(qids), 1), np.inf)
                limit = np.minimum(limit, np.where(np.isinf(best.floor), np.inf, best.floor**2)[:, None])
                rows, cols = np.nonzero((square <= limit + 2 * slack) & (square < np.inf))
                value = np.full(square.shape, -np.inf)
                value[rows, cols] = -np.sqrt(np.square(q[rows] - x[cols]).sum(1))
                best.add(value, ids)

            def rows(self):
                return [x for b in self.best.values() for x in b.rows()]

        found = materialize(probe(pairs.drop("a"), asked, placed.select("part", "no", "start", "first", "last", "run", "ids", "data"), Consumer), "curve-found")
    return ranked(found, k).select("query_id", "rank", "vec_id", (-F.col("score")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
