import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import vector as V
from vellum.operators import chunk, ireval, rag, search
from vellum.sources import readers, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_zero_vectors(spark):
    assert one(spark, V.cosine(arr(0, 0), arr(1, 2))) == 0.0
    assert one(spark, V.unit(arr(0, 0))) == [0.0, 0.0]
    assert one(spark, V.unit(arr(3, 4))) == [0.6, 0.8]


def test_top_k_ties_nulls_and_thresholds(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.0, 1.0])]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    q = e.where("id = 0")
    ids = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert ids(search.top_k(e, q, 3)) == [0, 1, 2]
    assert ids(search.top_k(e, q, 3, ties="high")) == [2, 1, 0]
    assert ids(search.top_k(e, q, 9, threshold=0.5, exclude_self=True)) == [1, 2]
    assert ids(search.top_k(e, q, 9, "cosine_distance", threshold=1.0)) == [0, 1, 2]
    assert search.top_k(e.limit(0), q, 3).count() == 0


@pytest.mark.parametrize("name", ["ann_ivf_topk", "ann_lsh_topk"])
def test_ann_recall_against_brute_force(spark, name):
    from vellum.plans import queries as plans

    d = "/root/testdata/sf0.1"
    e = readers.embeddings(spark, d).select("id", "v").toArrow()
    ids, x = np.array(e["id"].to_pylist()), np.array(e["v"].to_pylist())
    got = {}
    for r in plans.queries()[name](spark, d).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[asked].tolist())
    hits = 0
    for q in asked:
        dist = ((x - x[q]) ** 2).sum(1)
        dist[q] = np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, dist))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(asked)


def test_recall_asks_queries_of_the_whole_table(spark):
    from vellum.plans import queries as plans

    d = "/root/testdata/sf0.01"
    want = {r["id"] for r in readers.embeddings(spark, d).where("id % 20 = 0").collect()}
    got = plans.queries()["ann_recall"](spark, d).collect()
    assert {r["query_id"] for r in got} == want


def test_silhouette_in_blocks(spark):
    r = np.random.default_rng(2)
    x, cell = r.normal(size=(50, 4)), r.integers(0, 3, 50)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = []
    for i in range(50):
        mean = {c: d[i, (cell == c) & (np.arange(50) != i)].mean() for c in range(3)}
        own, near = mean[cell[i]], min(m for c, m in mean.items() if c != cell[i])
        want.append((near - own) / max(near, own))
    points = spark.createDataFrame([(i, int(c), [float(y) for y in v]) for i, (c, v) in enumerate(zip(cell, x))], "id long, cell int, v array<double>")
    for rows in (7, 1024):
        assert search.silhouette(points, rows).first()[0] == pytest.approx(np.mean(want))


def test_silhouette_copies_no_vector(spark, monkeypatch):
    """Blocks are broadcast: no table of copies is shuffled. Equal points are at distance 0."""
    monkeypatch.setattr(F, "explode", lambda *_: pytest.fail("points are copied"))
    x = [[0.1, 0.7]] * 6 + [[3.3, 0.2]] * 5 + [[9.0, 9.0]]
    cell = [0] * 6 + [1] * 5 + [2]
    points = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(zip(cell, x))], "id long, cell int, v array<double>")
    for rows in (4, 1024):
        assert search.silhouette(points, rows).first()[0] == pytest.approx(11 / 12, abs=1e-6)


def test_cluster_members_are_the_whole_table(spark, monkeypatch):
    from vellum.plans import queries as plans

    d, tried, plain = "/root/testdata/sf0.001", [], search.silhouette
    monkeypatch.setattr(search, "silhouette", lambda p: (tried.append(p.select("cell").distinct().count()), plain(p))[1])
    got = plans.queries()["cluster_members"](spark, d)
    assert {r["id"] for r in got.collect()} == {r["id"] for r in readers.embeddings(spark, d).where("v is not null").collect()}
    assert tried == [2, 3, 4, 5, 6, 7]


def test_ir_hand_values(spark):
    run = spark.createDataFrame([("a", 1, "d1"), ("a", 2, "d9"), ("a", 3, "d2"), ("b", 1, "x"), ("z", 1, "d1")], "query_id string, rank int, id string")
    qrels = spark.createDataFrame([("a", "d1"), ("a", "d2"), ("b", None)], "query_id string, id string")
    got = {(r["query_id"], r["k"]): r for r in ireval.per_query(run, qrels, (1, 5)).collect()}
    assert set(got) == {("a", 1), ("a", 5), ("b", 1), ("b", 5)}  # an unknown query is skipped
    a = got["a", 5]
    assert a["ap"] == pytest.approx((1 + 2 / 3) / 2) and a["rr"] == 1 and a["precision"] == pytest.approx(2 / 3) and a["recall"] == 1
    assert a["ndcg"] == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)))
    assert got["b", 5]["recall"] == 0 and got["b", 5]["rr"] == 0
    empty = ireval.macro(run.limit(0), qrels, (1, 5)).collect()
    assert [(r["precision"], r["map"]) for r in empty] == [(0.0, 0.0)] * 2


def test_chunkers():
    with pytest.raises(ValueError):
        chunk.token_windows("a b", 5, 5)
    assert chunk.char_windows("short") == [(0, "short")]
    text = ("x" * 600 + ". ") * 3
    w = chunk.char_windows(text)
    assert w[0] == (0, "x" * 600 + ".") and w[1][0] == 401
    words = " ".join(f"w{i}" for i in range(1000))
    t = chunk.token_windows(words, 100, 10, snap=False)
    assert len(t) == 11 and t[1][1].startswith("w90 ")
    s = "This is sentence one. " * 12
    assert [len(x[1]) > 0 for x in chunk.sentence_windows(s)] == [True] * 3
    assert chunk.last_sentence("I met Dr. Who then") == "I met Dr. Who then"
    assert chunk.code_blocks("a\n```py\nx\n```\nb")[1][1] == "```py\nx\n```"
    with pytest.raises(ValueError):
        chunk.create("nothing")


def test_headers_and_hybrid(spark):
    d = spark.createDataFrame([(1, "pre\n# A\nx\n## B\ny"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["start_char"], r["text"]) for r in chunk.header_sections(d).orderBy("id", "chunk_id").collect()] == [(0, "pre"), (4, "# A\nx"), (10, "## B\ny")]
    assert chunk.hybrid(d).where("id = 1").count() == 3
    assert chunk.walk(d, chunk.char_windows).count() == 1


def test_text_rules(spark):
    assert one(spark, T.clean(F.lit("I can't  go .Now\n\n\n\nok"))) == "I cannot go. Now\n\nok"
    assert one(spark, T.clean(F.lit(None).cast("string"))) == ""
    assert one(spark, T.content_type(F.lit("# title"))) == "header"
    assert one(spark, T.guess_language(F.lit("the cat and the dog or"))) == "en"
    assert not one(spark, T.valid_id(F.lit("_-"))) and one(spark, T.valid_id(F.lit("a_1"))) and not one(spark, T.valid_id(F.lit("a!")))
    doc = F.lit('{"a": {"b": 1}, "t": true}')
    assert one(spark, T.json_contains(doc, {"a": {"b": 1}})) and not one(spark, T.json_contains(doc, {"a": {"b": "1"}}))
    assert not one(spark, T.json_equals(doc, {"t": True}))


def test_prompts(spark):
    with pytest.raises(ValueError):
        rag.LIBRARY["basic_qa"].format(context="x")
    t = rag.Template("t", "{a}-{b}")
    assert t.format(a="1", b="2", c="3") == "1-2" and t.uses == 1
    p = spark.createDataFrame([(1, 1, "a" * 60), (1, 2, "b" * 900)], "query_id long, rank int, content string")
    text = rag.budgeted_context(p, 300).first()["context"]
    assert text.startswith("Document 1:\n" + "a" * 60) and text.endswith("...\n\n") and len(text) <= 300
    q = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, text string")
    assert [r["status"] for r in rag.answer(q, p).orderBy("query_id").collect()] == ["success", "no_documents_found"]


def test_store(spark, tmp_path):
    state = spark.createDataFrame([("a", "x", 1, 1), ("b", "y", 1, 1)], "document_id string, content string, created_at int, updated_at int")
    change = spark.createDataFrame([("b", "z"), ("c", "w")], "document_id string, content string")
    got = {r["document_id"]: tuple(r)[1:] for r in store.upsert(state, change, F.lit(9)).collect()}
    assert got == {"a": ("x", 1, 1), "b": ("z", 1, 9), "c": ("w", 9, 9)}
    assert store.page(state, 5, 10).count() == 0
    assert {r["document_id"]: r["deleted"] for r in store.deleted(state, change).collect()} == {"b": True, "c": False}
    store.save(state, str(tmp_path / "t"))
    store.save(store.delete(state, change), str(tmp_path / "t"))
    assert [r["document_id"] for r in store.load(spark, str(tmp_path / "t")).collect()] == ["a"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h,i\n" + "1,2\n" * 150)
    (tmp_path / "b.json").write_text('{"k": "é"}')
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "d.txt").write_bytes(b"ok\xff!")
    got = {r["suffix"]: r["text"] for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got["csv"].startswith("Headers: h, i\n\n1 | 2\n") and got["csv"].endswith("... and 100 more rows")
    assert got["json"] == '{\n  "k": "é"\n}' and got["bin"].startswith("ERROR") and got["txt"] == "ok!"
    with pytest.raises(ValueError):
        readers.vectors(spark, "x", "npz")


def test_stream_equals_batch(spark, tmp_path):
    from vellum.streaming import monitor

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    rows = monitor.counters(monitor.stream(spark, str(tmp_path / "in")), "1 hour")
    q = rows.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, monitor.counters(e.withColumn("ts", F.col("ts").cast("timestamp"))).collect()))


def test_every_query_has_a_schema(spark):
    import __spark_entry__ as entry
    from vellum.plans import queries as plans

    assert entry.entry(spark).count() == 10
    assert set(plans.oracle_sql()) <= set(plans.queries())
