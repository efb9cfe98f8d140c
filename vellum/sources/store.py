"""Collections as Parquet tables: set-based inserts, upserts, deletes and pages.

A change gives the new state of the collection as a DataFrame; `save` writes it as a new version and
`load` reads the newest, so readers never see half a write and a failed one leaves the old version.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = "document_id"


def latest(changes: DataFrame, key: str = KEY, order: str = "seq") -> DataFrame:
    """The last change of each key."""
    by = Window.partitionBy(key).orderBy(F.desc(order))
    return changes.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def once(changes: DataFrame, key: str = KEY) -> DataFrame:
    """One row a key: of several the largest by the other columns in order, so reruns agree. Use latest()
    first where an order of changes is known. Rows without a key go."""
    others = [c for c in changes.columns if c != key]
    kept = changes.where(F.col(key).isNotNull())
    if not others:
        return kept.distinct()
    return kept.groupBy(key).agg(F.max(F.struct(*others)).alias("x")).select(key, "x.*").select(*changes.columns)


def upsert(state: DataFrame, changes: DataFrame, now: Column, key: str = KEY) -> DataFrame:
    """New keys are inserted; known ones get the changed columns and updated_at, and keep created_at.
    A key that is changed twice counts once, see once()."""
    changes = once(changes, key)
    s, c = state.alias("s"), changes.alias("c")
    both = s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"), "full_outer")
    given = F.col(f"c.{key}").isNotNull()
    out = []
    for name in state.columns:
        if name == "created_at":
            out.append(F.coalesce(F.col("s.created_at"), now).alias(name))
        elif name == "updated_at":
            out.append(F.when(given, now).otherwise(F.col("s.updated_at")).alias(name))
        elif name in changes.columns:
            out.append(F.when(given, F.col(f"c.{name}")).otherwise(F.col(f"s.{name}")).alias(name))
        else:
            out.append(F.col(f"s.{name}").alias(name))
    return both.select(*out)


def insert_absent(state: DataFrame, rows: DataFrame, key: str = KEY) -> DataFrame:
    """New keys are inserted, once each; known ones stay as they are."""
    return state.unionByName(once(rows, key).join(state.select(key), key, "left_anti"), allowMissingColumns=True)


def insert(state: DataFrame, rows: DataFrame, duplicate: str = "ignore", now: Column | None = None, key: str = KEY) -> DataFrame:
    """Insert with a rule for keys that are there: `ignore`, `replace`, or `error` (before anything is written)."""
    if duplicate == "ignore":
        return insert_absent(state, rows, key)
    if duplicate == "replace":
        return upsert(state, rows, now if now is not None else F.current_timestamp(), key)
    if duplicate != "error":
        raise ValueError(f"unknown rule: {duplicate}")
    if not rows.join(state.select(key), key, "left_semi").isEmpty() or not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a key is there already")
    return state.unionByName(rows, allowMissingColumns=True)


def inserted(state: DataFrame, rows: DataFrame, key: str = KEY) -> DataFrame:
    """Whether each asked key was new."""
    return rows.select(key).distinct().join(state.select(key).distinct().withColumn("there", F.lit(True)), key, "left").select(key, F.col("there").isNull().alias("inserted"))


def updated(state: DataFrame, changes: DataFrame, key: str = KEY) -> DataFrame:
    """Whether each asked key was there to be updated."""
    return inserted(state, changes, key).select(key, (~F.col("inserted")).alias("updated"))


def delete(state: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    return state.join(ids.select(key).distinct(), key, "left_anti")


def deleted(state: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    """Whether each asked id was there."""
    return ids.select(key).distinct().join(state.select(key).distinct().withColumn("deleted", F.lit(True)), key, "left").fillna(False, ["deleted"])


def page(state: DataFrame, limit: int = 100, offset: int = 0, key: str = KEY) -> DataFrame:
    return state.orderBy(key).offset(offset).limit(limit)


def get(state: DataFrame, value, key: str = KEY) -> DataFrame:
    """The row of a key (the filter reaches the Parquet scan), with its embedding's dimension if it has one."""
    row = state.where(F.col(key) == F.lit(value))
    return row.withColumn("dimension", F.size("embedding")) if "embedding" in state.columns else row


def missing(rows: DataFrame, cache: DataFrame, columns: list[str], model: str | None = None, dimension: int | None = None) -> DataFrame:
    """Rows whose content hash is not in the cache; given a model or dimension, an entry of another is no hit."""
    keyed = rows.withColumn("content_hash", F.md5(F.concat_ws("\x1f", *columns)))
    if model is not None:
        cache = cache.where(F.col("model") == model)
    if dimension is not None:
        cache = cache.where(F.col("dimension") == dimension)
    return keyed.join(cache.select("content_hash"), "content_hash", "left_anti")


def save(state: DataFrame, path: str) -> str:
    version = f"{path.rstrip('/')}/version={time.time_ns()}"
    state.write.parquet(version)
    return version


def load(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().toString() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not done:
        raise FileNotFoundError(path)
    return spark.read.parquet(max(done))


def create_table(spark: SparkSession, name: str, columns: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def get_or_create(spark: SparkSession, name: str, columns: str) -> DataFrame:
    """The table of a name, made empty if there is none."""
    if not spark.catalog.tableExists(name):
        create_table(spark, name, columns)
    return spark.table(name)


def catalog(spark: SparkSession) -> DataFrame:
    """(property, value): version, current database and number of tables and views."""
    rows = [("version", spark.version), ("database", spark.catalog.currentDatabase()), ("tables", str(len(spark.catalog.listTables())))]
    return spark.createDataFrame(rows, "property string, value string")


def _without(m: Column, k: str) -> Column:
    return F.map_filter(m, lambda key, value: key != k)


def manifest(df: DataFrame, vector: str = "embedding", **own) -> DataFrame:
    """(key, value): what goes beside saved vectors; the caller's keys replace ours."""
    facts = df.agg(F.count("*").alias("count"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dimension"))
    said = F.create_map(F.lit("count"), F.col("count").cast("string"), F.lit("dimension"), F.col("dimension").cast("string"))
    for k, v in own.items():
        said = F.map_concat(_without(said, k), F.create_map(F.lit(k), F.lit(str(v))))
    return facts.select(F.explode(said).alias("key", "value"))


def save_embeddings(df: DataFrame, path: str, vector: str = "embedding", **own) -> None:
    """Vectors as Parquet and their manifest as JSON beside them."""
    df.write.parquet(f"{path}/vectors")
    manifest(df, vector, **own).coalesce(1).write.json(f"{path}/manifest")
