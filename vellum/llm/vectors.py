"""Vectors in blocks: packing sorted runs of rows, and probing blocks with blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK = 512, 64
BATCH_ROWS = 64  # blocks handed to Python together


@contextmanager
def small_batches(spark: SparkSession):
    """While rows are blocks of vectors, hand few of them to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero_ok: bool) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, floats as floats and other numbers as doubles, and their dimension.

    Null ids, null vectors and those holding null or non-finite components are left out, as are
    all-zero ones unless `zero_ok`. The dimension is the one most rows have (the smaller of equals);
    vectors of another length can't be compared and are left out too.
    """
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    v = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    if not zero_ok:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = lengths[0]["d"] if lengths else 1
    return rows.where(F.size("v") == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of length `dim`."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


PACKED = "part int, no int, run long, first double, last double, n int, ids binary, data binary"


def pack(rows: DataFrame, dim: int, size: int, dtype=np.float64) -> DataFrame:
    """(run, at, id, v), sorted within partitions by run and at -> blocks of up to `size` rows of one
    run: partition, number within it, run, first and last `at`, rows, and their ids and vectors, these as `dtype`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, kept = TaskContext.get().partitionId(), 0, None

        def block(r, at, ids, v):
            return (part, no, int(r), float(at[0]), float(at[-1]), len(ids), ids.tobytes(), v.astype(dtype).tobytes())

        def emit(out):
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()])], ["part", "no", "run", "first", "last", "n", "ids", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3), dim)]
            kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
            out, at = [], 0
            cuts = [0, *(np.flatnonzero(np.diff(kept[0])) + 1).tolist(), len(kept[0])]
            for a, z in zip(cuts[:-1], cuts[1:]):
                for i in range(a, z, size):
                    j = min(z, i + size)
                    if j == len(kept[0]) and j - i < size:
                        break  # may go on in the next batch
                    out.append(block(kept[0][i], kept[1][i:j], kept[2][i:j], kept[3][i:j]))
                    no, at = no + 1, j
            kept = [x[at:] for x in kept]
            if out:
                yield emit(out)
        if kept is not None and len(kept[0]):
            yield emit([block(kept[0][0], kept[1], kept[2], kept[3])])

    return rows.select(F.col("run").cast("long"), F.col("at").cast("double"), "id", "v").mapInArrow(run, PACKED)


def unpack(ids: bytes, data: bytes, dim: int, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, dtype).reshape(-1, dim).astype(np.float64, copy=False)


def by_id(value: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """queries x rows and the rows' ids -> queries x ids, the best (largest) value of each id."""
    order = np.argsort(ids, kind="stable")
    distinct, first = np.unique(ids[order], return_index=True)
    if len(distinct) == len(ids):
        return value, ids
    return np.maximum.reduceat(value[:, order], first, axis=1), distinct


class Best:
    """The k best (value, id) found so far of each of a block's queries; larger values are better."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor.copy()
        self.found: list[dict[int, float]] = [{} for _ in ids]

    def add(self, value: np.ndarray, ids: np.ndarray) -> None:
        """value: queries x rows, -inf where a row is no candidate. Of rows that repeat an id the best counts."""
        value, ids = by_id(value, ids)
        rows, cols = np.nonzero((value >= self.floor[:, None]) & (value > -np.inf))
        for i in np.unique(rows):
            c = cols[rows == i]
            if len(c) > 4 * self.k:
                v = value[i, c]
                c = c[v >= np.partition(v, -self.k)[-self.k]]
            found = self.found[i]
            for j, v in zip(ids[c].tolist(), value[i, c].tolist()):
                if v > found.get(j, -np.inf):
                    found[j] = v
            if len(self.found[i]) > self.k:
                top = sorted(self.found[i].items(), key=lambda x: (-x[1], x[0]))[: self.k]
                self.found[i] = dict(top)
                self.floor[i] = max(self.floor[i], top[-1][1])

    def rows(self) -> list[tuple[int, int, float]]:
        return [(int(q), i, v) for q, found in zip(self.ids, self.found) for i, v in found.items()]


def ranked(partial: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score), larger better -> with rank, the k best ids of each query, each by its best score."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def probe(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, make: Callable) -> DataFrame:
    """Join (qpart, qno, part, no, gap) with both kinds of blocks and feed them to Python, each
    partition's blocks with the smallest gap first. `make()` gives a consumer with add(row dict) and
    rows(), called once a partition."""
    q = queries.select(F.col("part").alias("qpart"), F.col("no").alias("qno"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.col("extra"))
    b = blocks.select("part", "no", "start", F.col("first").alias("lo"), F.col("last").alias("hi"), "run", "ids", "data")
    joined = pairs.join(q, ["qpart", "qno"]).join(b, ["part", "no"]).sortWithinPartitions("gap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        consumer = make()
        for batch in batches:
            for row in batch.to_pylist():
                consumer.add(row)
        got = consumer.rows()
        cols = list(zip(*got)) if got else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return joined.mapInArrow(run, "query_id long, vec_id long, score double")
