"""Readers, stores, reports, chunk facts, answers and SQL functions on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import blocks, chunk, ireval, rag, search, stats
from vellum.sources import readers, store
from vellum.streaming import monitor


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def known(spark):
    """Four queries, five results each, seven relevant pairs; the measures are published with four decimals."""
    lists = {"q1": [1, 2, 5, 3, 4], "q2": [2, 1, 6, 7, 4], "q3": [5, 6, 1, 7, 2], "q4": [3, 1, 2, 4, 5]}
    right = {"q1": [1, 5], "q2": [2], "q3": [5, 6, 7], "q4": [3]}
    run = spark.createDataFrame([(q, i + 1, d) for q, ds in lists.items() for i, d in enumerate(ds)], "query_id string, rank int, id long")
    return run, spark.createDataFrame([(q, d) for q, ds in right.items() for d in ds], "query_id string, id long")


def test_known_retrieval_measures(spark, known):
    got = {r["K"]: tuple(r)[1:] for r in ireval.summary(ireval.macro(*known, (1, 3, 5, 10))).collect()}
    assert got == {
        1: ("1.0000", "0.7083", "0.7917", "0.9375", "1.0000", "1.0000", "1.0000"),
        3: ("0.5000", "0.9167", "0.6167", "0.9375", "1.0000", "0.9213", "1.0000"),
        5: ("0.3500", "1.0000", "0.4970", "0.9375", "1.0000", "0.9718", "1.0000"),
        10: ("0.3500", "1.0000", "0.4970", "0.9375", "1.0000", "0.9718", "1.0000"),
    }
    best = ireval.best_k(ireval.macro(*known, (1, 3, 5))).first()
    assert best["best_k"] == 1 and best["trend"] == "declining"


def test_queries_without_results_count(spark, known):
    run, qrels = known
    fewer = run.where("query_id <> 'q2'")
    got = {r["query_id"]: r for r in ireval.per_query(fewer, qrels, (5,)).collect()}
    assert set(got) == {"q1", "q2", "q3", "q4"} and (got["q2"]["recall"], got["q2"]["precision"], got["q2"]["ap"], got["q2"]["hit"]) == (0, 0, 0, 0)
    assert ireval.single(run, qrels, "q1", (1,)).first()["precision"] == 1
    with pytest.raises(ValueError):
        ireval.single(run, qrels, "unknown")


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2", "inverse_l2", "inverse_squared_l2", "cosine_distance", "negative_inner"])
@pytest.mark.parametrize("elements", [4_000_000, 0])
def test_top_k_by_blocks_and_by_join_agree_with_numpy(spark, monkeypatch, metric, elements):
    monkeypatch.setattr(blocks, "QUERY_ELEMENTS", elements)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(60, 4)), 3)
    x[5], x[6] = x[4], 0
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(99, [1.0]), (98, None)], "id long, v array<double>").repartition(3)
    got = sorted((g["query_id"], g["rank"], g["id"], round(g["score"], 9)) for g in search.top_k(df.where("id <> 99"), df.where("id % 10 = 0"), 7, metric, exclude_self=True).collect())
    want = []
    n = lambda v: v / (np.linalg.norm(v) or 1)
    value = {"cosine": lambda a, b: n(a) @ n(b), "cosine_distance": lambda a, b: 1 - n(a) @ n(b), "dot": lambda a, b: a @ b, "negative_inner": lambda a, b: -(a @ b), "l2": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "inverse_l2": lambda a, b: 1 / (1 + np.sqrt(((a - b) ** 2).sum())), "inverse_squared_l2": lambda a, b: 1 / (1 + ((a - b) ** 2).sum())}[metric]
    sign = -1 if metric in ("cosine", "dot", "inverse_l2", "inverse_squared_l2") else 1
    for q in range(0, 60, 10):
        ranked = sorted((sign * round(value(x[q], x[i]), 12), i) for i in range(60) if i != q)[:7]
        want += [(q, k + 1, i, round(sign * s, 9) + 0.0) for k, (s, i) in enumerate(ranked)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-8)


def test_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 9)
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 3))
    x[7] = 2 * x[3]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(40) for j in range(i + 1, 40)]
    want = sorted(pairs, key=lambda p: (-round(u[p[0]] @ u[p[1]], 12), -p[0], -p[1]))[:5]
    assert [(p["i"], p["j"]) for p in search.top_pairs(df, 5).collect()] == want
    far = {p: np.linalg.norm(x[p[0]] - x[p[1]]) for p in pairs}
    got = search.scaled_euclidean(df, 4).collect()
    want = sorted(far, key=far.get)[:4]
    assert [(p["i"], p["j"]) for p in got] == want and [p["score"] for p in got] == pytest.approx([1 - far[p] / max(far.values()) for p in want])
    assert search.matrix(df).count() == 1600
    assert search.top_pairs(df.limit(0), 5).count() == 0


def test_index_is_saved_and_typed(spark, tmp_path):
    e = readers.clustered_vectors(spark, 300, 8).select("id", "v")
    index = search.create_index(e, "ivf", cells=5)
    index.save(str(tmp_path / "index"))
    again = search.InvertedFile.load(spark, str(tmp_path / "index"))
    q = e.where("id % 50 = 0")
    assert sorted(index.search(q, 3, 2).collect()) == sorted(again.search(q, 3, 2).collect())
    assert search.create_index(e, "hnsw", planes=1, tables=2)(q, 3).count() > 0
    with pytest.raises(ValueError):
        search.create_index(e, "tree")
    assert search.cluster_sweep(e.limit(0)).count() == 0
    assert search.cluster_sweep(e.limit(1)).first()["cell"] == 0


def test_sql_functions(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<double>")
    search.register_functions(spark, e, spark.createDataFrame([(1, "abcd", "s"), (2, "ab", "s")], "doc_id long, text string, source string"))
    got = spark.sql("SELECT * FROM search_similar(array(1D, 0D), 2)").collect()
    assert sorted((r["id"], round(r["distance"], 6)) for r in got) == [(0, 0.0), (1, round(1 - 2**-0.5, 6))]
    assert spark.sql("SELECT * FROM collection_stats()").first()["avg_length"] == 3
    assert spark.table("document_stats").first()["documents"] == 2


def test_search_columns_and_texts(spark):
    found = spark.createDataFrame([(0, 1, 7, 0.5)], "query_id long, rank int, id long, score double")
    texts = spark.createDataFrame([(7, "seven")], "doc_id long, text string")
    assert search.with_text(found, texts).first()["content"] == "seven"
    assert search.shown(search.with_text(found, texts), False, False).columns == ["id", "query_id", "rank"]


def test_store_rules(spark, tmp_path):
    state = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 0, 0)], "document_id long, content string, created_at int, updated_at int")
    rows = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e"), (3, "f"), (None, "g")], "document_id long, content string")
    ids = lambda df: sorted(map(tuple, df.select("document_id", "content").collect()))
    assert ids(store.upsert(state, rows, F.lit(5))) == [(1, "a"), (2, "d"), (3, "f")]
    assert ids(store.insert(state, rows)) == [(1, "a"), (2, "b"), (3, "f")]
    with pytest.raises(ValueError):
        store.insert(state, rows, "error")
    with pytest.raises(ValueError):
        store.insert(state, rows, "maybe")
    assert {r["document_id"]: r["inserted"] for r in store.inserted(state, rows.dropna()).collect()} == {2: False, 3: True}
    assert {r["document_id"]: r["updated"] for r in store.updated(state, rows.dropna()).collect()} == {2: True, 3: False}
    facts = {r["key"]: r["value"] for r in store.manifest(spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>"), count=9, model="m").collect()}
    assert facts == {"count": "9", "dimension": "2", "model": "m"}
    store.save_embeddings(spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e/manifest")).count() == 2
    cache = store.missing(rows, state.limit(0).select(F.lit("x").alias("content_hash")), ["content"])
    assert cache.count() == 5
    name = "vellum_made_here"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert store.get_or_create(spark, name, "id long").count() == 0 and store.get_or_create(spark, name, "id long").columns == ["id"]
    spark.sql(f"DROP TABLE {name}")
    assert {r["property"] for r in store.catalog(spark).collect()} == {"version", "database", "tables"}


def test_batches_and_checks(spark):
    df = spark.createDataFrame([("ok", "t"), ("!", "t"), ("ok", None)], "id string, text string")
    checks = {"id": T.valid_id(F.col("id")), "text": F.length("text") > 0}
    assert [r["error"] for r in stats.checked(df, checks).collect()] == [None, "id", "text"]
    assert tuple(stats.batch(df, checks).first()) == (1, 2, 33.33)
    with pytest.raises(ValueError):
        stats.batch(df, checks, most=2)
    assert tuple(stats.profile(df).first()) == (3, 2, 1)
    wide = spark.createDataFrame([("a", 1.0, 9.0), ("b", 3.0, 9.0)], "label string, x double, y double")
    assert {tuple(r) for r in stats.column_best(wide, "label", ["x", "y"]).collect()} == {("x", "b", 3.0), ("y", "a", 9.0)}
    scores = spark.createDataFrame([("s1", 0, "overall", 0.5), ("s2", 1, "overall", 0.5), ("s3", 2, "overall", 0.4)], "strategy string, seq int, metric string, value double")
    assert {r["strategy"]: r["rank"] for r in stats.rank_strategies(scores).collect()} == {"s1": 1, "s2": 2, "s3": 3}
    assert tuple(stats.recommendation(scores).first()) == ("s1", "Highest overall score: 0.500")


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,said\nx,"one, two"\n')
    (tmp_path / "b.docx").write_bytes(b"zip")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("plain")
    files = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.documents(spark, str(tmp_path), recursive=True).collect()}
    assert files["a.csv"] == "Headers: name, said\n\nx | one, two" and files["c.txt"] == "plain" and files["b.docx"].startswith("ERROR")
    facts = {r["name"]: (r["supported"], r["readable"]) for r in readers.file_facts(readers.documents(spark, str(tmp_path))).collect()}
    assert facts == {"a.csv": (True, True), "b.docx": (True, False)}
    long = "h\n" + "\n".join(map(str, range(101)))
    assert one(spark, readers.csv_text(F.lit(long))).endswith("99\n... and 100 more rows") and one(spark, readers.csv_text(F.lit(""))) == ""

    (tmp_path / "v.csv").write_text("vector_id,dim_0,dim_1\na,1,2\nb,,3\n")
    vectors = readers.csv_vectors(spark, str(tmp_path / "v.csv"), "vector_id string, dim_0 double, dim_1 double").collect()
    assert [(r["vector_id"], r["embedding"]) for r in vectors] == [("a", [1.0, 2.0])]
    bench = {"documents": [{"id": "d", "content": "x"}, {"id": "d", "content": "y"}], "queries": [{"id": "q", "text": "t", "relevant_docs": ["d", "d"]}, {"id": "r", "text": "u", "relevant_docs": []}]}
    (tmp_path / "b.json").write_text(json.dumps(bench))
    docs, queries, pairs = readers.benchmark(spark, str(tmp_path / "b.json"))
    assert docs.first()["content"] == "y" and queries.count() == 2 and sorted(map(tuple, pairs.collect())) == [("q", "d"), ("r", None)]
    for fmt in ("json", "csv", "parquet"):
        rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "text string, embedding array<double>")
        readers.export(rows, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["text", "embed_0", "embed_1"]
    assert readers.vectors(spark, str(tmp_path / "parquet"), "parquet").count() == 1
    with pytest.raises(ValueError):
        readers.export(rows, str(tmp_path / "x"), "xml")


def test_fetch_all(spark):
    def fetch(url, timeout):
        if "bad" in url:
            raise OSError("no")
        return url * 50

    urls = spark.createDataFrame([(i, f"http://h{i % 2}/{'bad' if i == 3 else 'page'}{i}") for i in range(8)], "seq long, url string").repartition(3)
    got = readers.fetch_all(urls, fetch, at_once=4, per_host=2).collect()
    assert [r["seq"] for r in got] == list(range(8)) and got[3]["error"] == "OSError: no" and got[3]["content"] is None
    assert len(got[0]["content"]) == 203 and got[0]["content"].endswith("...")


def test_encoders(spark):
    def encode(texts):
        if "fail" in texts:
            raise RuntimeError
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("ab",), (None,), ("fail",), ("abc",)], "t string").coalesce(1)
    got = [r["v"] for r in df.select(readers.encoder_udf(encode, 2, batch=2)("t").alias("v")).collect()]
    assert got == [[2.0, 1.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    v = one(spark, readers.hashing_encoder(16)(F.lit("one two two")))
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-6) and one(spark, readers.hashing_encoder(16)(F.lit(""))) == [0.0] * 16


def test_text_cleaning(spark):
    assert one(spark, T.clean(F.lit("﻿itâ€™s  ﬁne ...."))) == "it's fine..."
    assert one(spark, T.clean(F.lit("itâ€™s"), compat=True)) == one(spark, F.lit("itâ€TMs"))
    assert one(spark, T.clean(F.lit(None).cast("string"))) == ""
    assert one(spark, T.normalize_space(F.lit("a  b"), False)) == "a b"
    assert one(spark, T.drop_special(F.lit("a*b§c."))) == "abc."
    assert one(spark, T.truncated(F.lit("One. Two is long."), 10, "smart")) == "One."
    assert one(spark, T.truncated(F.lit("abcdefghijkl"), 9, "middle")) == "abc...jkl"
    with pytest.raises(ValueError):
        T.truncated(F.lit("x"), 3, "other")
    assert one(spark, T.verdict(F.lit(0.61), "overlap")) == "Good - Reasonable overlap"
    assert not one(spark, T.valid_request(F.lit("  "), F.lit(3))) and one(spark, T.valid_request(F.lit("x"), F.lit(50)))


def test_chunks(spark):
    assert chunk.sentences("One two three. Four five six! No. Seven eight nine") == ["One two three.", "Four five six!", "Seven eight nine"]
    text = "# A\nfirst\n## B\nsecond"
    assert chunk.header_windows("intro\n" + text) == [(0, "intro"), (6, "# A\nfirst"), (16, "## B\nsecond")]
    docs = spark.createDataFrame([(1, "The cat sat down. The cat sat down. Dogs bark loudly today."), (2, None), (3, " ")], "doc_id long, text string")
    groups = chunk.semantic(docs).orderBy("chunk_id").collect()
    assert [g["text"] for g in groups] == ["The cat sat down. The cat sat down.", "Dogs bark loudly today."]
    got = {r["id"]: r["status"] for r in chunk.process(docs).collect()}
    assert got == {1: "success", 2: "error", 3: "error"}
    rows = chunk.described(chunk.hybrid(spark.createDataFrame([(1, "Say so now.\n```py\nx = 1\n```\nmore words here")], "doc_id long, text string"))).collect()
    assert {r["sentence_count"] for r in rows if r["content_type"] == "code"} == {0} and all(r["end_char"] - r["start_char"] == len(r["text"]) for r in rows)
    named = chunk.ingest(docs.withColumn("lang", F.lit("en")), facts=("lang",)).collect()
    assert [(r["chunk"], r["lang"]) for r in named] == [("1_0", "en")]
    for name in ("adaptive", "semantic", "hybrid", "header", "token", "sentence", "char", "code", "paragraph", "fixed_token"):
        assert chunk.create(name)(docs).count() >= 0
    with pytest.raises(ValueError):
        chunk.create("other")


def test_quality_weights_and_report(spark):
    scores = spark.createDataFrame([(1, 0.9, 1.0, None, 0.5, 0.5)], "id long, size_score double, coverage_score double, overlap_score double, boundary_score double, coherence_score double")
    whole = scores.withColumn("overall", chunk.overall())
    assert whole.first()["overall"] == pytest.approx((0.18 + 0.3 + 0.1 + 0.05) / 0.8)
    assert "size: 0.900 - Excellent" in chunk.report(whole.fillna(0.0)).first()["report"]


def test_answers(spark):
    queries = spark.createDataFrame([(1, "what"), (2, "why")], "query_id long, text string")
    found = spark.createDataFrame([(1, 1, "alpha"), (1, 2, "beta")], "query_id long, rank int, content string")
    got = {r["query_id"]: r for r in rag.run(queries, found, generate=lambda p: F.upper(F.substring(p, 1, 6))).collect()}
    assert (got[1]["status"], got[1]["answer"], got[1]["documents"], got[2]["status"], got[2]["answer"]) == ("success", "ANSWER", 2, "no_documents_found", rag.APOLOGY)
    failed = rag.run(queries, found, generate=lambda p: F.lit(None).cast("string")).where("query_id = 1").first()
    assert failed["status"] == "error"
    assert {r["query_id"]: r["answer"] for r in rag.top_answer(queries, found).collect()} == {1: "Relevant info: alpha", 2: "No relevant document found."}
    assert {r["query_id"]: r["context"] for r in rag.context(found, queries).collect()}[2] == rag.NO_CONTEXT
    turns = spark.createDataFrame([(1, t, "user", str(t)) for t in range(9)], "conv_id long, turn int, role string, text string")
    assert [r["turn"] for r in rag.last_turns(turns).orderBy("turn").collect()] == [3, 4, 5, 6, 7, 8]


def test_history_is_appended(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "seq long, answer string")
    for _ in range(2):
        rag.append_history(rows, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2
    assert [r["seq"] for r in rag.recent(spark.range(30).withColumnRenamed("id", "seq"), 2).collect()] == [29, 28]


def test_held_runs(spark):
    rows = [(k, f"2024-01-01 0{h}:00:00", v) for k, h, v in [("a", 0, 9), ("a", 1, 9), ("a", 2, 9), ("a", 4, 9), ("b", 0, 9), ("b", 1, 0), ("b", 2, 9)]]
    df = spark.createDataFrame(rows, "k string, start string, n int").withColumn("start", F.to_timestamp("start"))
    assert [(r["k"], r["windows"]) for r in monitor.held(df, "n", 5, 2, 3600, ["k"]).collect()] == [("a", 3)]
    assert monitor.held(df.where("k = 'a'"), "n", 5, 3, 3600).first()["windows"] == 3


def test_benchmark_sets_and_vectors(spark):
    docs, queries, pairs = readers.benchmark_set(spark, "topics")
    assert (docs.count(), queries.count(), pairs.count()) == (5, 5, 5)
    assert sorted(map(tuple, readers.unit_vectors(spark, 5, 3).collect())) == sorted(map(tuple, readers.unit_vectors(spark, 5, 3).collect()))


def test_index_searches_in_blocks(spark, monkeypatch):
    """Queries in several passes, equal vectors, repeated ids, far values: the rows are those of all pairs, and no query is joined."""
    monkeypatch.setattr(blocks, "QUERY_ELEMENTS", 60)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 7)
    monkeypatch.setattr(search, "small", lambda *_: pytest.fail("queries are joined"))
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 4)).astype(np.float32).astype(float)
    x[40:90] = x[3]
    x[100], x[101] = 1e200, -1e-200
    ids = np.arange(300)
    ids[250] = 20
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)] + [(900, None), (920, [float("nan")] * 4)], "id long, v array<double>")
    q = df.where("id % 20 = 0")
    want = []
    with np.errstate(over="ignore"):
        for name in sorted(set(ids[ids % 20 == 0])):
            near = [(np.sqrt(((x[i] - x[j]) ** 2).sum()), int(ids[j])) for i in np.flatnonzero(ids == name) for j in range(300) if ids[j] != name]
            want += [(int(name), rank + 1, j, pytest.approx(d, abs=1e-12)) for rank, (d, j) in enumerate(sorted(near)[:6])]
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(search.InvertedFile(df.where("id <> 100"), 5).search(q.where("id <> 100"), 6, 5, exclude_self=True).collect()) == [w for w in want if w[0] != 100]
    # One plane's two buckets in many tables leave nobody alone.
    assert key(search.hyperplane_search(df, q, 6, 4, planes=1, tables=60).collect()) == want
    assert search.hyperplane_search(df.limit(0), q, 6, 4).count() == 0 == search.hyperplane_search(df, q.limit(0), 6, 4).count()


@pytest.mark.parametrize("metric", ["cosine", "dot", "cosine_distance", "negative_inner"])
def test_matrix_in_blocks(spark, monkeypatch, metric):
    """Several passes and batches give every ordered pair once; nothing is joined."""
    monkeypatch.setattr(blocks, "QUERY_ELEMENTS", 30)
    monkeypatch.setattr(blocks, "OUT_ROWS", 20)
    x = np.random.default_rng(8).normal(size=(25, 3))
    x[4] = 0
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(99, None)], "id int, v array<double>")
    want = {(r["query_id"], r["id"]): pytest.approx(r["score"], abs=1e-12) for r in search.scored(df, df, metric).collect()}
    monkeypatch.setattr(search, "scored", lambda *_: pytest.fail("pairs are joined"))
    got = search.matrix(df, metric).collect()
    assert len(got) == 625 and {(r["i"], r["j"]): r["score"] for r in got} == want
    assert search.matrix(df, metric).schema["i"].dataType.typeName() == "integer"


def test_matrix_rows_come_in_blocks(spark, monkeypatch):
    """No row of the matrix runs past a block of ids, so ids come back soon and compress; every pair is there once."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 4)
    x = np.random.default_rng(9).normal(size=(25, 3))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1)
    got = [(r["i"], r["j"]) for r in search.matrix(df).collect()]
    assert len(got) == 625 == len(set(got))
    starts = [0, *(p for p in range(1, 625) if got[p][0] != got[p - 1][0]), 625]
    assert max(np.diff(starts)) <= 4


def test_labelled_queries_are_measured_without_pairs(spark):
    """Labels give the measures of all relevant pairs; many rows of few labels make no row for each pair."""
    labels = [(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, None), (6, "c"), (7, "b"), (7, "a"), (8, "b")]
    rows = spark.createDataFrame(labels, "id long, label string")
    run = spark.createDataFrame([(q, k + 1, (q + 3 * k) % 8 + 1) for q in (1, 3, 5, 6, 7) for k in range(3)], "query_id long, rank int, id long")
    asked = rows.where("id in (1, 3, 5, 6, 7, 8)")
    qrels = asked.select(F.col("id").alias("query_id"), "label").join(rows, "label").where("id <> query_id").select("query_id", "id")
    key = lambda df: sorted(map(tuple, df.collect()))
    got = ireval.per_labelled_query(run, asked, rows, (1, 3))
    assert key(got) == key(ireval.per_query(run, qrels, (1, 3))) and {r["query_id"] for r in got.collect()} == {1, 3, 7, 8}
    assert key(ireval.averaged(got, (1, 3))) == key(ireval.macro(run, qrels, (1, 3)))
    # 2.5e9 pairs, were they made.
    many = spark.range(100_000).select("id", (F.col("id") % 2).alias("label"))
    far = ireval.per_labelled_query(run, many.where("id % 2 = 0"), many, (3,)).agg(F.count("*"), F.max("recall")).first()
    assert far[0] == 50_000 and far[1] == 1 / 49_999


def test_top_k_asks_in_passes(spark, monkeypatch):
    """More queries than are broadcast together are not joined; equal vectors, an early best and ties keep their order."""
    monkeypatch.setattr(blocks, "QUERY_ELEMENTS", 40)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 7)
    monkeypatch.setattr(search, "scored", lambda *_: pytest.fail("queries are joined"))
    x = np.random.default_rng(12).normal(size=(300, 4)).astype(np.float32).astype(float)
    x[40:90] = x[3]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = sorted(tuple(g)[:3] for g in search.top_k(df, df.where("id % 5 = 0"), 6, "l2", exclude_self=True, ties="high").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for q in range(0, 300, 5):
        near = sorted((np.square(x[q] - x[i]).sum(), -i) for i in range(300) if i != q)[:6]
        want += [(q, rank + 1, -i) for rank, (_, i) in enumerate(near)]
    assert got == want


def shuffled(df):
    """Stages of the plan that move rows by key."""
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")


def all_pairs(x, ids, metric):
    """The pairs i < j of different ids, by the sums that DuckDB makes."""
    i, j = np.triu_indices(len(x), 1)
    i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
    value = blocks.pair_scores(metric, x[i], x[j])
    return list(zip(np.minimum(ids[i], ids[j]).tolist(), np.maximum(ids[i], ids[j]).tolist(), value.tolist()))


def pair_rows(spark, monkeypatch):
    """Several parts and blocks; equal vectors, a doubled one, a zero one, a repeated id, far values, nulls."""
    monkeypatch.setattr(blocks, "QUERY_ELEMENTS", 200)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    x = np.random.default_rng(21).normal(size=(140, 4)).astype(np.float32).astype(float)
    x[30:60], x[61], x[62], x[100:104] = x[3], 2 * x[60], 0, x[99]
    ids = np.random.default_rng(22).permutation(140)
    ids[1] = ids[0]
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x)] + [(900, None), (901, [float("nan")] * 4)]
    return x, ids, spark.createDataFrame(rows, "id int, v array<double>").repartition(3)


@pytest.mark.parametrize("k", [1, 9, 600])
def test_scaled_distances_without_a_shuffle(spark, monkeypatch, k):
    x, ids, df = pair_rows(spark, monkeypatch)
    pairs = all_pairs(x, ids, "l2")
    most = max(p[2] for p in pairs)
    got = search.scaled_euclidean(df, k)
    assert shuffled(got) == 0 and got.schema["i"].dataType.typeName() == "integer"
    assert [tuple(r) for r in got.collect()] == [(i, j, 1 - d / most) for i, j, d in sorted(pairs, key=lambda p: (p[2], p[0], p[1]))[:k]]


def test_scaled_distances_beyond_floats(spark):
    """Squares that leave the range of a float."""
    x = [[1e18, 0.0], [1e18, 1e10], [0.0, 1e-20], [0.0, 0.0], [1e18, 3e18]]
    got = search.scaled_euclidean(spark.createDataFrame(list(enumerate(x)), "id long, v array<double>"), 2).collect()
    assert [(r["i"], r["j"], r["score"]) for r in got] == [(2, 3, 1.0), (0, 1, pytest.approx(1 - 1e10 / np.hypot(1e18, 3e18)))]


@pytest.mark.parametrize("k", [1, 9, 600])
def test_top_pairs_of_copies_tie(spark, monkeypatch, k):
    """Copies have a cosine of exactly 1, so ids decide between them; nothing is shuffled."""
    x, ids, df = pair_rows(spark, monkeypatch)
    want = sorted(all_pairs(x, ids, "cosine"), key=lambda p: (-p[2], -p[0], -p[1]))[:k]
    got = search.top_pairs(df, k)
    assert shuffled(got) == 0
    assert [tuple(r) for r in got.collect()] == want


@pytest.mark.parametrize("copies", [2, 5])
def test_best_pair_of_copies_has_the_smallest_ids(spark, monkeypatch, copies):
    """Every vector has copies in other parts: the first ids of all win, whatever the rounding of their norms."""
    monkeypatch.setattr(blocks, "QUERY_ELEMENTS", 400)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    x = np.random.default_rng(30).normal(size=(60, 5)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(1000 * c + i, [float(z) for z in v]) for c in range(copies) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = search.top_pairs(df, 1, ties="low")
    assert shuffled(got) == 0 and [tuple(r) for r in got.collect()] == [(0, 1000, 1.0)]
    high = [tuple(r) for r in search.top_pairs(df, 3).collect()]
    last = 1000 * (copies - 2)
    assert high == [(last + 59 - i, last + 1059 - i, 1.0) for i in range(3)]
