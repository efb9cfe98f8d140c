"""Exact top-k inner products by a pivot-distance index.

Vectors of whole numbers get one more coordinate, sqrt(M - |x|^2) with M the largest squared norm, so
that the largest inner product with a query (whose extra coordinate is 0) is the smallest Euclidean
distance. Each vector is keyed by its nearest pivot and its distance to it; rows sorted by that key
form annuli. A query's best scores within its own annulus give it a reach; by the triangle
inequality only annuli that meet [d - reach, d + reach] around its distance d to their pivot can
hold anything as good. Those are expanded outwards, nearest first, and the reach shrinks meanwhile.

Pivots are at most MOST_PIVOTS rows chosen by a hash of the id; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import BLOCK, QUERY_BLOCK, Best, matrix, pack, probe, ranked, small_batches, unpack, usable

MOST_PIVOTS = 512
EXACT = float(1 << 53)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows; through Python's integers where doubles can't hold them."""
    if np.sqrt((q * q).sum(1).max(initial=0) * (x * x).sum(1).max(initial=0)) * 2 < EXACT:
        return q @ x.T
    whole = np.array([[int(c) for c in row] for row in q], object) @ np.array([[int(c) for c in row] for row in x], object).T
    return whole.astype(np.float64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products of floor(scale * x),
    ties to the smaller id; fewer where there are fewer candidates. `is_query` is a condition on `id`.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids and
    lengths other than the most frequent one. Rows that repeat an id are one candidate with their
    best score. Scores are exact up to 2**53. An empty table gives an empty table.
    """
    rows, dim = usable(vectors, id_col, vec_col, True)
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, top = rows.agg(F.count("*"), F.max(norm)).first()
    n, top = n or 0, top or 0.0
    wanted = min(MOST_PIVOTS, max(8, int(np.sqrt(n) / 2)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    lift = lambda x: np.sqrt(np.maximum(top - (x * x).sum(1), 0))
    base = np.array([r["v"] for r in chosen] or [[0.0] * dim])
    pivots = np.column_stack([base, lift(base)])
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def distances(x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        p = shared.value
        d2 = ((x * x).sum(1) + extra * extra)[:, None] + (p * p).sum(1) - 2 * (x @ p[:, :-1].T + np.outer(extra, p[:, -1]))
        return np.sqrt(np.maximum(d2, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            d = distances(x, lift(x))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int64)), pa.array(d[np.arange(len(x)), near]), b.column(0), b.column(1)], ["run", "at", "id", "v"])

    keyed = rows.mapInArrow(assign, "run long, at double, id long, v array<double>")
    keyed = materialize(keyed, "annulus-rows")
    ordered = keyed.repartitionByRange("run", "at", "id").sortWithinPartitions("run", "at", "id")
    with small_batches(spark):
        blocks = materialize(pack(ordered, dim, BLOCK).withColumn("start", F.lit(0).cast("long")), "annuli")
        asked = pack(keyed.where(is_query).repartitionByRange("run", "at", "id").sortWithinPartitions("run", "at", "id"), dim, QUERY_BLOCK)
        asked = materialize(asked.withColumn("extra", F.lit(None).cast("binary")), "queries")

        def consumer(reach: bool):
            class Consumer:
                def __init__(self):
                    self.best, self.away = {}, {}

                def add(self, r):
                    qids, q = unpack(r["qids"], r["qdata"], dim)
                    key = (r["qpart"], r["qno"])
                    if key not in self.best:
                        floor = np.frombuffer(r["extra"], np.float64) if r["extra"] else np.full(len(qids), -np.inf)
                        self.best[key], self.away[key] = Best(qids, k, floor), distances(q, np.zeros(len(q)))
                    best, d = self.best[key], self.away[key][:, r["run"]]
                    square = (q * q).sum(1) + top - 2 * np.where(np.isinf(best.floor), 0, best.floor)
                    far = np.where(np.isinf(best.floor), np.inf, np.sqrt(np.maximum(square, 0))) * (1 + 1e-9) + 1e-3
                    live = (np.maximum(r["lo"] - d, d - r["hi"]) <= far) if reach else np.ones(len(qids), bool)
                    if live.any():
                        ids, x = unpack(r["ids"], r["data"], dim)
                        value = np.full((len(qids), len(ids)), -np.inf)
                        value[live] = products(q[live], x)
                        value[qids[:, None] == ids] = -np.inf
                        best.add(value, ids)

                def rows(self):
                    return [x for b in self.best.values() for x in b.rows()]

            return Consumer

        shape = ["part", "no", "run", "first", "last"]
        cells = blocks.select(*shape)
        homes = asked.select(F.col("part").alias("qpart"), F.col("no").alias("qno"), "run", F.col("first").alias("a"), F.col("last").alias("z"))
        own = homes.join(cells, "run").where("first <= z and last >= a").select("qpart", "qno", "part", "no", F.lit(0.0).alias("gap"))
        first = materialize(probe(own, asked, blocks, consumer(False)), "own-annulus")
        # The k-th best score so far, for each query in the order of its block; -inf where there are fewer.
        kth = ranked(first, k).where(F.col("rank") == k).select("query_id", "score")

        def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    ids, q = unpack(r["ids"], r["data"], dim)
                    known = dict(zip(r["known"] or [], r["score"] or []))
                    floor = np.array([known.get(int(i), -np.inf) for i in ids])
                    square = (q * q).sum(1) + top - 2 * np.where(np.isinf(floor), 0, floor)
                    far = np.where(np.isinf(floor), np.inf, np.sqrt(np.maximum(square, 0))) * (1 + 1e-9) + 1e-3
                    d = distances(q, np.zeros(len(q)))
                    m = d.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array([v] * m, t) for v, t in ((r["part"], pa.int32()), (r["no"], pa.int32()), (floor.tobytes(), pa.binary()))] + [pa.array(np.arange(m)), pa.array((d - far[:, None]).min(0)), pa.array((d + far[:, None]).max(0)), pa.array(d.mean(0))], ["qpart", "qno", "floor", "run", "a", "z", "mid"])

        listed = _ids_of(asked).join(kth, "query_id").groupBy("part", "no").agg(F.collect_list("query_id").alias("known"), F.collect_list("score").alias("score"))
        spans = asked.join(listed, ["part", "no"], "left").select("part", "no", "ids", "data", "known", "score").mapInArrow(reaches, "qpart int, qno int, floor binary, run long, a double, z double, mid double")
        spans = materialize(spans, "reaches")
        gap = F.greatest(F.col("first") - F.col("mid"), F.col("mid") - F.col("last"))
        pairs = spans.select("qpart", "qno", "run", "a", "z", "mid").join(cells, "run").where("first <= z and last >= a").select("qpart", "qno", "part", "no", gap.alias("gap"))
        floored = spans.select(F.col("qpart").alias("part"), F.col("qno").alias("no"), "floor").dropDuplicates(["part", "no"])
        again = asked.drop("extra").join(floored, ["part", "no"]).withColumnRenamed("floor", "extra")
        second = materialize(probe(pairs, again, blocks, consumer(True)), "annuli-found")
    found = ranked(first.unionByName(second), k)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _ids_of(blocks: DataFrame) -> DataFrame:
    """(part, no, query_id) of each row of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["part"], np.int32)), pa.array(np.full(len(ids), r["no"], np.int32)), pa.array(ids)], ["part", "no", "query_id"])

    return blocks.select("part", "no", "ids").mapInArrow(run, "part int, no int, query_id long")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
