"""Aggregates over vectors, collections and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import vector as V


def norms(vectors: DataFrame) -> DataFrame:
    n = V.norm(F.col("v"))
    return vectors.agg(F.avg(n).alias("mean_norm"), F.stddev_pop(n).alias("std_norm"), F.min(n).alias("min_norm"), F.max(n).alias("max_norm"))


def elements(vectors: DataFrame) -> DataFrame:
    """Mean, deviation, least and most of all components."""
    x = vectors.select(F.explode("v").alias("x"))
    return x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def mean_vector(vectors: DataFrame) -> DataFrame:
    """The same of the element-wise mean vector."""
    by = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return by.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.min("m").alias("min"), F.max("m").alias("max"))


def collection(df: DataFrame, text: str, at: str | None = None) -> DataFrame:
    cols = [F.count("*").alias("documents"), F.avg(F.length(text)).alias("avg_length")]
    return df.agg(*cols, *([F.min(at).alias("first_at"), F.max(at).alias("last_at")] if at else []))


def json_distinct(df: DataFrame, column: str, path: str) -> DataFrame:
    return df.agg(F.count_distinct(F.get_json_object(column, path)).alias("values"))


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """The distinct keys of a JSON object column and how many rows hold each."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))


def best_rows(df: DataFrame, group: list[str], value: Column, ties: list[Column], largest: bool = True) -> DataFrame:
    """The row with the best value in each group; ties by `ties`, first wins."""
    order = value.desc_nulls_last() if largest else value.asc_nulls_last()
    by = Window.partitionBy(*group).orderBy(order, *ties)
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def mean_model(df: DataFrame, y: str) -> DataFrame:
    """The constant regressor: what it predicts and how it does."""
    p = df.agg(F.avg(y).alias("prediction"))
    return df.crossJoin(F.broadcast(p)).agg(F.first("prediction").alias("prediction"), F.avg(F.pow(F.col(y) - F.col("prediction"), 2)).alias("mse"), F.count("*").alias("rows"))


def mode_model(df: DataFrame, y: str) -> DataFrame:
    """The constant classifier: the most frequent class (the smallest of equals) and its share."""
    counts = df.groupBy(F.col(y).alias("prediction")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.orderBy(F.desc("n"), "prediction").limit(1).crossJoin(F.broadcast(total)).select("prediction", (F.col("n") / F.col("t")).alias("accuracy"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of each pair of columns, in one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("c"))
    return row.select(F.explode("c").alias("c")).select("c.*")


def speed(df: DataFrame, seconds: str, chunks: str, chars: str) -> DataFrame:
    """Chunks and characters a second, and seconds a chunk; 0 where there is nothing to divide by."""
    s, c, n = F.sum(seconds), F.sum(chunks), F.sum(chars)
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.agg(div(c, s).alias("chunks_per_second"), div(n, s).alias("chars_per_second"), div(s, c).alias("seconds_per_chunk"))


def memory(df: DataFrame, text: str, vector: str) -> DataFrame:
    """Characters and four bytes for each component; flat and graph index sizes."""
    dims = F.size(vector)
    return df.agg(F.sum(F.length(text)).alias("text_bytes"), F.sum(dims * 4).alias("vector_bytes"), F.sum(dims * 4 + 32 * 4).alias("graph_bytes"))


def outcomes(df: DataFrame, ok: Column) -> DataFrame:
    """Successes, failures and the rate in percent, to two places."""
    good = F.count_if(ok)
    return df.agg(good.alias("succeeded"), (F.count("*") - good).alias("failed"), F.when(F.count("*") > 0, F.bround(100 * good / F.count("*"), 2)).otherwise(0.0).alias("success_rate"))


def checked(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """`df` with `error`: the name of the first check that doesn't hold, or null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return df.withColumn("error", out)


def batch(df: DataFrame, checks: dict[str, Column], least: int = 1, most: int = 1000) -> DataFrame:
    """Outcomes of a batch whose rows number `least` to `most`; any other number is an error."""
    n = df.limit(most + 1).count()
    if not least <= n <= most:
        raise ValueError(f"a batch has {least} to {most} rows")
    return outcomes(checked(df, checks), F.col("error").isNull())


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns and nulls of a table."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), nulls.alias("nulls"))


def sampled_collection(df: DataFrame, order: str, text: str, json: str | None = None, vector: str | None = None, n: int = 10) -> DataFrame:
    """Of the first n rows: mean length to two places, and the metadata keys or the dimension there."""
    few = df.orderBy(order).limit(n)
    cols = [F.count("*").alias("sampled"), F.round(F.coalesce(F.avg(F.length(text)), F.lit(0.0)), 2).alias("avg_length")]
    cols += [F.max(F.size(vector)).alias("dimension")] if vector else []
    cols += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.json_object_keys(json))))).alias("keys")] if json else []
    return few.agg(*cols)


def column_best(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(metric, best, value): for each column the label of its largest value (the smallest label of equals)."""
    long = df.unpivot([label], columns, "metric", "value")
    return long.groupBy("metric").agg(F.min_by(label, F.struct(-F.col("value"), F.col(label))).alias("best"), F.max("value").alias("value"))


def rank_strategies(scores: DataFrame) -> DataFrame:
    """(strategy, seq, metric, value) -> with rank in each metric, largest first, ties in the order of seq."""
    by = Window.partitionBy("metric").orderBy(F.desc("value"), "seq")
    return scores.withColumn("rank", F.row_number().over(by))


def recommendation(scores: DataFrame, overall: str = "overall") -> DataFrame:
    """The strategy ranked first by the overall metric, and why."""
    best = rank_strategies(scores.where(F.col("metric") == overall)).where("rank = 1")
    return best.select(F.col("strategy").alias("best_strategy"), F.format_string("Highest overall score: %.3f", "value").alias("reason"))


def histogram(df: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Request counters by labels, with cumulative buckets, a sum and a count."""
    return df.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds], F.sum(value).alias("sum"), F.count(value).alias("count"))
