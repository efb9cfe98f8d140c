"""Retrieval metrics over ranked runs and relevance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KS = (1, 3, 5, 10, 20)


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(query_id, k, precision, recall, f1, ap, rr, ndcg, hit) of each query that `qrels` knows.

    run: (query_id, rank, id); qrels: (query_id, id). Precision divides by the results returned within
    k; average precision and reciprocal rank look at the whole list; gains are binary. A query known
    without relevant ids (a null id), or without any row in `run`, has zeros; one that `qrels` doesn't
    know is left out.
    """
    known = qrels.groupBy("query_id").agg(F.count_distinct("id").alias("relevant"))
    marks = qrels.where("id is not null").select("query_id", "id").distinct().withColumn("rel", F.lit(1))
    return measured(known.join(run, "query_id", "left").join(marks, ["query_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))), ks)


def per_labelled_query(run: DataFrame, queries: DataFrame, rows: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """per_query() where the relevant ids are the others that share a label with the query, without making those pairs.

    queries, rows: (id, label), the queries being some of the rows. An id may repeat with several labels. A query
    that shares its labels with no other id, or has none, is left out, as it would be of such pairs.
    """
    kinds = lambda df: df.where("label is not null").groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    own, asked = kinds(rows), kinds(queries).select(F.col("id").alias("query_id"), F.col("labels").alias("asked"))
    sizes = own.groupBy("labels").agg(F.count("*").alias("n")).withColumn("label", F.explode("labels"))
    shared = asked.select("asked").distinct().withColumn("label", F.explode("asked")).join(sizes, "label").select("asked", "labels", "n").distinct()
    known = asked.join(shared.groupBy("asked").agg((F.sum("n") - 1).alias("relevant")), "asked").where("relevant > 0")
    listed = known.join(run, "query_id", "left").join(own, "id", "left")
    return measured(listed.withColumn("rel", F.coalesce(F.arrays_overlap("asked", "labels"), F.lit(False)).cast("int")), ks)


def measured(rows: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """What per_query() returns, of (query_id, relevant, rank, rel): a row for each result, rank null where there is none."""
    hits = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("hits", hits)
    cut = []
    for k in ks:
        top = F.col("rank") <= k
        got, listed = F.sum(F.when(top, F.col("rel")).otherwise(0)), F.count_if(top)
        dcg = F.sum(F.when(top, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0))
        cut.append(F.struct(F.lit(k).alias("k"), got.alias("got"), listed.alias("listed"), dcg.alias("dcg")))
    folded = rows.groupBy("query_id", "relevant").agg(
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.array(*cut).alias("cuts"),
    )
    c = folded.select("query_id", "relevant", "ap", "first", F.explode("cuts").alias("c")).select("query_id", "relevant", "ap", "first", "c.*")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("relevant", "k"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("got"), F.col("listed")), safe(F.col("got"), F.col("relevant"))
    c = c.withColumn("precision", p).withColumn("recall", r)
    return c.select(
        "query_id", "k", "precision", "recall", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        safe(F.col("ap"), F.col("relevant")).alias("ap"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("relevant") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), (F.col("got") > 0).cast("double").alias("hit"),
    )


def macro(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(k, precision, recall, f1, map, mrr, ndcg, hit_rate): means over queries, zeros for an empty run."""
    return averaged(per_query(run, qrels, ks), ks)


def averaged(queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """macro() of what per_query() or per_labelled_query() returned for the same ks."""
    spark = queries.sparkSession
    each = queries.groupBy("k").agg(*[F.avg(a).alias(b) for a, b in (("precision", "precision"), ("recall", "recall"), ("f1", "f1"), ("ap", "map"), ("rr", "mrr"), ("ndcg", "ndcg"), ("hit", "hit_rate"))])
    wanted = spark.createDataFrame([(k,) for k in ks], "k int")
    return wanted.join(each, "k", "left").fillna(0.0)


def single(run: DataFrame, qrels: DataFrame, query_id, ks: tuple[int, ...] = KS) -> DataFrame:
    """per_query() of one query; a query that `qrels` doesn't know is an error."""
    if qrels.where(F.col("query_id") == F.lit(query_id)).isEmpty():
        raise ValueError(f"unknown query: {query_id}")
    mine = F.col("query_id") == F.lit(query_id)
    return per_query(run.where(mine), qrels.where(mine), ks)


def summary(macros: DataFrame) -> DataFrame:
    """The report table of macro(): K and each measure as text with four decimals."""
    names = {"precision": "Precision", "recall": "Recall", "f1": "F1", "map": "MAP", "mrr": "MRR", "ndcg": "NDCG", "hit_rate": "Hit Rate"}
    return macros.select(F.col("k").alias("K"), *[F.format_string("%.4f", c).alias(n) for c, n in names.items()])


def best_k(macros: DataFrame) -> DataFrame:
    """The k with the best F1 (the smallest of equals), and how precision changes from the least k to the largest."""
    best = F.max_by("k", F.struct("f1", -F.col("k")))
    change = F.max_by("precision", "k") - F.min_by("precision", "k")
    out = macros.agg(best.alias("best_k"), F.max("f1").alias("best_f1"), change.alias("change"))
    return out.withColumn("trend", F.when(F.col("change") > 0, "improving").when(F.col("change") < 0, "declining").otherwise("stable"))


def latency(times: DataFrame, column: str) -> DataFrame:
    """Mean and median of positive times, their total, and all results per second of it."""
    t = F.when(F.col(column) > 0, F.col(column))
    return times.agg(F.coalesce(F.avg(t), F.lit(0.0)).alias("mean_time"), F.coalesce(F.median(t), F.lit(0.0)).alias("median_time"), F.coalesce(F.sum(t), F.lit(0.0)).alias("total_time"), F.when(F.sum(t) > 0, F.count("*") / F.sum(t)).otherwise(0.0).alias("qps"))
