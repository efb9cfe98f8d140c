"""Reading and writing tables, vectors, documents and benchmarks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from vellum.functions import vector as V
from vellum.sources import office

TEXT_SUFFIXES = ("txt", "md", "rst", "py", "js", "html", "xml")
OTHER_SUFFIXES = ("json", "csv", "docx", "pdf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v array<double>, label): cast once, so that both sides of any comparison are doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def csv_vectors(spark: SparkSession, path: str, schema: str, prefix: str = "dim_") -> DataFrame:
    """A CSV of wide vectors: the prefixed columns become one array, rows with a missing component go."""
    raw = spark.read.csv(path, header=True, schema=schema)
    dims = V.prefixed(raw, prefix)
    return raw.select(*[c for c in raw.columns if c not in dims], V.as_vector(*dims).alias("embedding")).where(V.complete(F.col("embedding")))


def vectors(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "json":
        return spark.read.json(path, schema="text string, embedding array<double>, metadata map<string,string>", multiLine=True)
    raise ValueError(f"unsupported format: {fmt}")


def export(df: DataFrame, path: str, fmt: str, vector: str = "embedding") -> None:
    """Chunks with embeddings. CSV has a column for each component; it and Parquet drop rows without a vector."""
    if fmt == "json":
        df.write.json(path)
        return
    rows = df.where(F.col(vector).isNotNull())
    if fmt == "parquet":
        rows.write.parquet(path)
    elif fmt == "csv":
        n = rows.select(F.max(F.size(vector))).first()[0] or 0
        flat = [c for c in df.columns if c != vector and not df.schema[c].dataType.typeName() in ("array", "map", "struct")]
        rows.select(*flat, *[F.get(vector, F.lit(i)).alias(f"embed_{i}") for i in range(n)]).write.csv(path, header=True)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def documents(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, suffix, size, modified, supported, text): files of a folder. A file that can't be read as
    what its suffix says has `ERROR: ...` for a text, as has a PDF where pypdf isn't installed. Spark's file
    sources skip files without a byte; these come from the listing, with a null for the time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.unionByName(_empty_files(spark, files))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select("path", suffix.alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    plain = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    of = lambda name, c: F.when(F.col("suffix") == name, c)  # noqa: E731  a reader sees its own files only
    text = F.when(F.col("suffix").isin(*TEXT_SUFFIXES), plain)
    for name, read, raw in (("json", pretty_json, plain), ("csv", csv_text, plain), ("docx", office.reader(office.docx_text), F.col("content")), ("pdf", office.reader(office.pdf_text), F.col("content"))):
        text = text.when(F.col("suffix") == name, read(of(name, raw)))
    text = text.otherwise(F.concat(F.lit("ERROR: unsupported format ."), F.col("suffix")))
    return rows.select("path", "suffix", "size", "modified", F.col("suffix").isin(*TEXT_SUFFIXES, *OTHER_SUFFIXES).alias("supported"), text.alias("text"))


def _empty_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The files that a binaryFile source lists and doesn't read, in its columns. The listing is in the
    driver's file index already; only paths meet here, never contents."""
    from urllib.parse import unquote

    listed = [(unquote("file:/" + p[8:] if p.startswith("file:///") else p),) for p in files.inputFiles()]
    absent = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    return absent.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


@F.pandas_udf(StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """JSON printed with two spaces; what doesn't parse is an ERROR text."""
    import json

    def one(t):
        if t is None:
            return None
        try:
            return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except ValueError as e:
            return f"ERROR: {e}"

    return texts.map(one)


@F.pandas_udf(StringType())
def csv_text(texts: pd.Series) -> pd.Series:
    """A CSV text, quoted fields and all, for reading: header names, the first 100 rows, and a line that
    says there are more. A text without rows is empty; one that doesn't parse is an ERROR text."""
    import csv
    import io
    import itertools

    csv.field_size_limit(1 << 31)

    def one(t):
        if t is None:
            return None
        try:
            rows = (r for r in csv.reader(io.StringIO(t)) if r)
            head = next(rows, None)
            if head is None:
                return ""
            shown = [" | ".join(r) for r in itertools.islice(rows, 100)]
            more = ["... and 100 more rows"] if next(rows, None) is not None else []
            return "\n".join(["Headers: " + ", ".join(head), "", *shown, *more])
        except csv.Error as e:
            return f"ERROR: {e}"

    return texts.map(one)


def fetch_all(urls: DataFrame, fetch, at_once: int = 10, per_host: int = 5, timeout: float = 30.0, shown: int = 200) -> DataFrame:
    """(url, ...) rows -> (seq, url, content, error) in the order of `seq`, a column of `urls`.

    fetch(url, timeout) gives a text. Each task asks for `at_once` pages together, `per_host` of them of one
    host; content beyond `shown` characters ends in "...". Whatever a fetch raises becomes its row's error.
    """

    def run(batches):
        import threading
        from concurrent.futures import ThreadPoolExecutor
        from urllib.parse import urlsplit

        hosts: dict[str, threading.Semaphore] = {}

        def one(url):
            try:
                with hosts.setdefault(urlsplit(url).netloc, threading.Semaphore(per_host)):
                    text = fetch(url, timeout)
                return (text[:shown] + "..." if len(text) > shown else text), None
            except Exception as e:  # noqa: BLE001  a row for each failure is what the source is for
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b["url"]))
                yield pd.DataFrame({"seq": b["seq"], "url": b["url"], "content": [g[0] for g in got], "error": [g[1] for g in got]})

    return urls.select(F.col("seq").cast("long"), "url").mapInPandas(run, "seq long, url string, content string, error string").orderBy("seq")


def file_facts(files: DataFrame) -> DataFrame:
    """Of documents(): name, suffix, size, time, whether its format is supported and its text readable."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "suffix", "size", "modified", "supported", (~F.startswith("text", F.lit("ERROR: "))).alias("readable"))


def clustered_vectors(spark: SparkSession, n: int, dim: int, clusters: int = 10, seed: int = 42) -> DataFrame:
    """(id, label, v): members 0.5 * N(0, 1) around centres 2 * N(0, 1), the same for a seed."""
    noise = F.array(*[F.randn(seed + 1 + i) for i in range(dim)])
    centre = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in _normal(clusters, dim, seed)])
    rows = spark.range(n).withColumn("label", (F.col("id") % clusters).cast("int"))
    return rows.select("id", "label", F.zip_with(F.get(centre, F.col("label")), noise, lambda c, x: 2 * c + 0.5 * x).alias("v"))


def unit_vectors(spark: SparkSession, n: int = 100, dim: int = 384, seed: int = 42) -> DataFrame:
    """(id, v): random directions, the same for a seed."""
    return spark.range(n).withColumn("x", F.array(*[F.randn(seed + i) for i in range(dim)])).select("id", V.unit(F.col("x")).alias("v"))


def _normal(rows: int, dim: int, seed: int):
    import numpy as np

    return np.random.default_rng(seed).normal(size=(rows, dim))


#: Two small benchmarks: (topic, what a document says, what a query asks).
SETS = {
    "passages": [(t, f"{t.capitalize()} {v}.", f"what {q}") for t, v, q in (
        ("photosynthesis", "turns light into sugar in leaves", "turns light into sugar"), ("evaporation", "lifts water from sea to air", "lifts water into the air"),
        ("erosion", "wears mountains down to sand", "wears mountains down"), ("magnetism", "turns a compass to the north", "turns a compass"),
        ("gravity", "keeps planets on their paths", "keeps planets on their paths"), ("fermentation", "makes bread rise and wine strong", "makes bread rise"),
        ("combustion", "needs fuel, air and heat", "needs fuel and air"), ("refraction", "bends light at a surface", "bends light"))],
    "topics": [(t, f"Reports on {t} and {v}.", f"reports on {v}") for t, v in (("harbours", "shipping"), ("orchards", "fruit"), ("railways", "freight"), ("glaciers", "ice"), ("markets", "prices"))],
}


def benchmark_set(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A built-in benchmark as documents, queries and (query_id, id) pairs; each query has one relevant document."""
    rows = [(f"{name}_d{i}", f"{name}_q{i}", t, d, q) for i, (t, d, q) in enumerate(SETS[name], 1)]
    docs = spark.createDataFrame([(d, text, t) for d, _, t, text, _ in rows], "id string, content string, topic string")
    queries = spark.createDataFrame([(q, text) for _, q, _, _, text in rows], "id string, text string")
    return docs, queries, spark.createDataFrame([(q, d) for d, q, *_ in rows], "query_id string, id string")


BENCHMARK = "documents array<struct<id:string,content:string,metadata:map<string,string>>>, queries array<struct<id:string,text:string,relevant_docs:array<string>,metadata:map<string,string>>>"


def benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A ground-truth JSON file as documents, queries and (query_id, id) pairs; a later id replaces an earlier one."""
    raw = spark.read.json(path, schema=BENCHMARK, multiLine=True)

    def last(column: str) -> DataFrame:
        rows = raw.select(F.posexplode(column).alias("n", "x"))
        return rows.groupBy(F.col("x.id").alias("key")).agg(F.max_by("x", "n").alias("x"))

    docs = last("documents").select("x.*")
    queries = last("queries").select("x.*")
    return docs, queries.drop("relevant_docs"), queries.select(F.col("id").alias("query_id"), F.explode_outer(F.array_distinct("relevant_docs")).alias("id"))


def sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """A parameterised query: {name} stands for a table given, :name for a value, which is never part of the text."""
    return spark.sql(text, args=args or None, **(tables or {}))


def hashing_encoder(dim: int = 384):
    """A Pandas UDF text -> array<float>: signed hashed words, normalised. Stands where no model is at hand;
    any function of the same type can take its place, see encoder_udf()."""
    import zlib

    import numpy as np

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.zeros(dim, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 16 & 1 else -1
            n = float(np.linalg.norm(v))
            return v / n if n else v

        return texts.map(one)

    return encode


def encoder_udf(encode, dim: int, batch: int = 32):
    """A Pandas UDF text -> array<float> around encode(list of texts) -> matrix, `batch` texts at a time. A
    batch that fails gives zero vectors, as do null and empty texts in it."""
    import numpy as np

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), batch):
            part = texts.iloc[at : at + batch].tolist()
            try:
                got = np.asarray(encode([t or "" for t in part]), np.float32).reshape(len(part), dim)
            except Exception:  # noqa: BLE001  the contract: zero vectors, not a failed job
                got = np.zeros((len(part), dim), np.float32)
            out += [v if t else np.zeros(dim, np.float32) for t, v in zip(part, got)]
        return pd.Series(out, index=texts.index, dtype=object)

    return run
