"""More named queries: sources, stores, reports, answers and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import vector as V
from vellum.operators import chunk, ireval, rag, search, stats
from vellum.plans.queries import COS, DIST, IR, NW, VEC, WINDOWS, _content_sql, embeddings, first, passages, query, r6, sampled, self_retrieval, state, table, top_sql
from vellum.sources import readers, store
from vellum.streaming import monitor

BLANK = "[ \\t\\n\\x0B\\f\\r]"


@query("source_profile", "SELECT count(*) AS rows, 5 AS columns, (count(*) FILTER (doc_id IS NULL) + count(*) FILTER (text IS NULL) + count(*) FILTER (lang IS NULL) + count(*) FILTER (source IS NULL) + count(*) FILTER (n_chars IS NULL))::BIGINT AS nulls FROM documents")
def _(s, d):
    return stats.profile(table(s, d, "documents"))


@query("source_pages", "SELECT page_id, url, CASE WHEN length(html) > 200 THEN substr(html, 1, 200) || '...' ELSE html END AS content FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", "url", T.preview(F.col("html")).alias("content"))


@query("source_sets", "SELECT * FROM (VALUES ('passages', 8::BIGINT, 8::BIGINT, 8::BIGINT), ('topics', 5, 5, 5)) t(name, documents, queries, pairs)")
def _(s, d):
    rows = [(n, *(x.count() for x in readers.benchmark_set(s, n))) for n in readers.SETS]
    return s.createDataFrame(rows, "name string, documents long, queries long, pairs long")


@query("source_unit_vectors", "SELECT 100::BIGINT AS rows, 384 AS dimension, 1.0::DOUBLE AS least_norm, 1.0::DOUBLE AS largest_norm")
def _(s, d):
    n = V.norm(F.col("v"))
    return readers.unit_vectors(s).agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("dimension"), F.round(F.min(n), 9).alias("least_norm"), F.round(F.max(n), 9).alias("largest_norm"))


@query("source_clustered_vectors", "SELECT i::INTEGER AS label, 100::BIGINT AS rows, 1.0::DOUBLE AS own_nearest FROM range(10) g(i)")
def _(s, d):
    """Members of a cluster, and the share of them whose nearest cluster mean is its own."""
    rows = readers.clustered_vectors(s, 1000, 32)
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    near = search.top_k(means.select(F.col("label").cast("long").alias("id"), "v"), rows.select("id", "v"), 1, "l2")
    both = near.join(rows.select(F.col("id").alias("query_id"), "label"), "query_id")
    return both.groupBy("label").agg(F.count("*").alias("rows"), F.avg((F.col("id") == F.col("label")).cast("double")).alias("own_nearest"))


@query("source_sql_args", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 AND event_type <> 'error' GROUP BY event_type")
def _(s, d):
    return readers.sql(s, "SELECT event_type, count(*) AS n FROM {events} WHERE value > :least AND event_type <> :other GROUP BY event_type", {"events": table(s, d, "events")}, least=50, other="error")


@query("source_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(5)


@query("source_names", "SELECT DISTINCT source FROM documents")
def _(s, d):
    return table(s, d, "documents").select("source").distinct()


@query("store_manifest", "SELECT key, value FROM (SELECT 'count' AS key, count(*)::VARCHAR AS value FROM embeddings UNION ALL SELECT 'dimension', max(len(embedding))::VARCHAR FROM embeddings UNION ALL SELECT 'model', 'words')")
def _(s, d):
    return store.manifest(table(s, d, "embeddings"), model="words")


@query("store_cache_model", "SELECT doc_id, md5(text) AS content_hash FROM documents WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 AND lang = 'en')")
def _(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text", "lang")
    cache = docs.where("doc_id % 2 = 0").select(F.md5("text").alias("content_hash"), F.col("lang").alias("model"), F.lit(64).alias("dimension"))
    return store.missing(docs, cache, ["text"], "en", 64).select("doc_id", "content_hash")


@query("store_insert_result", "SELECT DISTINCT item_id AS document_id, item_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) AS inserted FROM benchmark")
def _(s, d):
    there = state(s, d).where("document_id % 2 = 0")
    return store.inserted(there, table(s, d, "benchmark").select(F.col("item_id").alias("document_id")))


@query("store_update_result", "SELECT DISTINCT doc_id AS document_id, doc_id % 2 = 0 AS updated FROM labels")
def _(s, d):
    there = state(s, d).where("document_id % 2 = 0")
    return store.updated(there, table(s, d, "labels").select(F.col("doc_id").alias("document_id"))).join(state(s, d).select("document_id"), "document_id", "left_semi")


@query("store_insert_replace", "SELECT doc_id AS document_id, md5(CASE WHEN doc_id % 5 = 0 THEN lang ELSE text END) AS content, 0 AS created_at, CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 0 END AS updated_at FROM documents")
def _(s, d):
    rows = table(s, d, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("document_id"), F.md5("lang").alias("content"))
    return store.insert(state(s, d), rows.unionByName(rows), "replace", F.lit(7))


CHECKS_SQL = """CASE WHEN source IS NULL OR NOT regexp_full_match(source, '[\\p{L}\\p{N}_-]+') OR NOT regexp_matches(source, '[\\p{L}\\p{N}]') OR length(source) > 100 THEN 'id'
  WHEN text IS NULL OR length(text) NOT BETWEEN 1 AND 10000 THEN 'text' END"""


def checks():
    return {"id": T.valid_id(F.col("source")), "text": F.length("text").between(1, 10000)}


@query("store_add_documents", f"SELECT doc_id, {CHECKS_SQL} AS error FROM documents")
def _(s, d):
    return stats.checked(table(s, d, "documents"), checks()).select("doc_id", "error")


@query("store_batch", "SELECT count(*) FILTER (length(text) BETWEEN 1 AND 300) AS succeeded, count(*) FILTER (length(text) NOT BETWEEN 1 AND 300) AS failed, round(100.0 * count(*) FILTER (length(text) BETWEEN 1 AND 300) / count(*), 2) AS success_rate FROM benchmark")
def _(s, d):
    return stats.batch(table(s, d, "benchmark"), {"text": F.length("text").between(1, 300)}, 1, 1_000_000)


@query("request_checks", f"SELECT doc_id, length(text) BETWEEN 1 AND 1000 AND regexp_matches(text, '\\S') AND doc_id BETWEEN 1 AND 50 AS request, regexp_full_match(source, '[\\p{{L}}\\p{{N}}_]+') AND length(source) <= 63 AS table_name FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def _(s, d):
    docs = table(s, d, "documents").where("text is not null and source is not null")
    return docs.select("doc_id", T.valid_request(F.col("text"), F.col("doc_id")).alias("request"), T.valid_table_name(F.col("source")).alias("table_name"))


@query("metadata_map_filter", "SELECT event_id FROM events WHERE props->>'$.k' = '7'")
def _(s, d):
    return table(s, d, "events").where(T.map_matches(F.from_json("props", "map<string,string>"), {"k": "7"})).select("event_id")


@query("coll_sampled", "SELECT count(*) AS sampled, round(avg(length(props)), 2) AS avg_length, list_sort(list_distinct(flatten(list(json_keys(props)))))[1] AS first_key FROM (SELECT * FROM events ORDER BY event_id LIMIT 10)")
def _(s, d):
    return stats.sampled_collection(table(s, d, "events"), "event_id", "props", "props").select("sampled", "avg_length", F.get("keys", F.lit(0)).alias("first_key"))


@query("vec_matrix", f"WITH {VEC} SELECT q.vec_id AS i, c.vec_id AS j, round({COS}, 6) + 0.0 AS score FROM v q, v c")
def _(s, d):
    return r6(search.matrix(embeddings(s, d)), "score")


@query("vec_topk_text", f"WITH t AS ({top_sql(COS, 'DESC', 10, 'q.vec_id % 20 = 0')}) SELECT t.query_id, t.rank, t.id, md5(text) AS hash FROM t LEFT JOIN documents ON doc_id = t.id")
def _(s, d):
    e = embeddings(s, d)
    found = search.with_text(search.top_k(e, sampled(e), 10), table(s, d, "documents"))
    return search.shown(found, distances=False).select("query_id", "rank", "id", F.md5("content").alias("hash"))


@query("vec_methods", f"SELECT 'cosine' AS method, query_id, rank, id FROM ({top_sql(COS, 'DESC', 5, 'q.vec_id % 20 = 0')}) UNION ALL SELECT 'l2', query_id, rank, id FROM ({top_sql(DIST, 'ASC', 5, 'q.vec_id % 20 = 0')})")
def _(s, d):
    e = embeddings(s, d)
    both = [search.top_k(e, sampled(e), 5, m).select(F.lit(m).alias("method"), "query_id", "rank", "id") for m in ("cosine", "l2")]
    return both[0].unionByName(both[1])


@query("vec_sql_function", top_sql(f"1 - {COS}", "ASC", 7, "q.vec_id = 0").replace("SELECT query_id, row_number", "SELECT row_number"))
def _(s, d):
    e = embeddings(s, d)
    search.register_functions(s, e, table(s, d, "documents"))
    rows = s.sql("SELECT f.id, f.distance FROM (SELECT v FROM vellum_vectors WHERE id = 0) q, LATERAL search_similar(q.v, 7, 3D) f")
    ranked = rows.selectExpr("row_number() OVER (ORDER BY distance, id) AS rank", "id", "distance AS score")  # seven rows
    return r6(ranked, "score")


@query("coll_stats_function", "SELECT count(*) AS documents, round(avg(length(text)), 6) AS avg_length, min(length(text))::INTEGER AS min_length, max(length(text))::INTEGER AS max_length FROM documents")
def _(s, d):
    search.register_functions(s, embeddings(s, d), table(s, d, "documents"))
    return r6(s.sql("SELECT * FROM collection_stats()"), "avg_length")


@query("document_stats_view", "SELECT source, count(*) AS documents, round(avg(length(text)), 6) AS avg_length FROM documents GROUP BY source")
def _(s, d):
    search.register_functions(s, embeddings(s, d), table(s, d, "documents"))
    return r6(s.table("document_stats"), "avg_length")


IR_MACRO = IR + ", z AS (SELECT k, avg(p) AS precision, avg(r) AS recall, avg(f1) AS f1, avg(ap) AS map, avg(rr) AS mrr, avg(ndcg) AS ndcg, avg(hit) AS hit_rate FROM f GROUP BY k) "


@query("ir_report", IR_MACRO + "SELECT k AS K, " + ", ".join(f"printf('%.4f', {c}) AS {n}" for c, n in (("precision", "Precision"), ("recall", "Recall"), ("f1", "F1"), ("map", "MAP"), ("mrr", "MRR"), ("ndcg", "NDCG"), ("hit_rate", '"Hit Rate"'))) + " FROM z")
def _(s, d):
    return ireval.summary(ireval.averaged(self_retrieval(s, d)))


@query("ir_best_k", IR_MACRO + "SELECT arg_max(k, (f1, -k)) AS best_k, round(max(f1), 6) AS best_f1, round(arg_max(precision, k) - arg_min(precision, k), 6) AS change, CASE WHEN arg_max(precision, k) > arg_min(precision, k) THEN 'improving' WHEN arg_max(precision, k) < arg_min(precision, k) THEN 'declining' ELSE 'stable' END AS trend FROM z")
def _(s, d):
    return r6(ireval.best_k(ireval.averaged(self_retrieval(s, d))), "best_f1", "change")


@query("metric_column_best", "WITH m AS (SELECT l_returnflag, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice, avg(l_discount) AS l_discount FROM lineitem GROUP BY 1), u AS (UNPIVOT m ON l_quantity, l_extendedprice, l_discount INTO NAME metric VALUE value) SELECT metric, arg_max(l_returnflag, value) AS best, round(max(value), 4) AS value FROM u GROUP BY metric")
def _(s, d):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    wide = table(s, d, "lineitem").groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in names])
    return stats.column_best(wide, "l_returnflag", names).withColumn("value", F.round("value", 4))


def strategy_scores(s, d):
    """Languages in the part of strategies: two measures and their mean for each."""
    docs = table(s, d, "documents").where("lang is not null and text is not null")
    wide = docs.groupBy(F.col("lang").alias("strategy")).agg(F.round(F.avg(F.least(F.length("text") / 5000, F.lit(1.0))), 6).alias("size"), F.round(F.avg(T.has_headers(F.col("text")).cast("double")), 6).alias("headers"))
    wide = wide.withColumn("overall", F.round((F.col("size") + F.col("headers")) / 2, 6))
    return wide.unpivot(["strategy"], ["size", "headers", "overall"], "metric", "value").withColumn("seq", F.col("strategy"))


STRATEGIES = """WITH m AS (SELECT lang AS strategy, round(avg(least(length(text) / 5000, 1.0)), 6) AS size, round(avg(regexp_matches(text, '(?m)^#{1,6}\\s')::INTEGER::DOUBLE), 6) AS headers FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY 1),
o AS (SELECT *, round((size + headers) / 2, 6) AS overall FROM m), u AS (UNPIVOT o ON size, headers, overall INTO NAME metric VALUE value)
"""


@query("strategy_ranking", STRATEGIES + "SELECT strategy, metric, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, strategy)::INTEGER AS rank FROM u")
def _(s, d):
    return stats.rank_strategies(strategy_scores(s, d)).select("strategy", "metric", "value", "rank")


@query("strategy_recommendation", STRATEGIES + "SELECT strategy AS best_strategy, 'Highest overall score: ' || printf('%.3f', value) AS reason FROM u WHERE metric = 'overall' ORDER BY value DESC, strategy LIMIT 1")
def _(s, d):
    return stats.recommendation(strategy_scores(s, d))


@query("text_structure", f"""SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS total_lines, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '\\S')))::INTEGER AS empty_lines,
  round(list_sum(list_transform(string_split(text, chr(10)), lambda x: length(x))) / len(string_split(text, chr(10))), 6) AS avg_line_length, contains(text, '```') AS has_code_blocks,
  regexp_matches(text, '(?m)^#{{1,6}}\\s+') AS has_headers, regexp_matches(text, '(?m)^\\s*[-*+\\d]+[.)\\s]') AS has_lists,
  len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S')))::INTEGER AS paragraphs, {_content_sql()} AS content_type FROM documents""")
def _(s, d):
    return r6(table(s, d, "documents").select("doc_id", *T.structure(F.col("text"))), "avg_line_length")


@query("text_special", "SELECT doc_id, md5(regexp_replace(text, '[^A-Za-z0-9\\s.,!?;:()\\[\\]{}\"''/-]', '', 'g')) AS hash FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.drop_special(F.col("text"))).alias("hash"))


@query("text_truncated", "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 297) || '...' END AS head, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 149) || '...' || right(text, 148) END AS ends FROM documents")
def _(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", T.truncated(t, 300).alias("head"), T.truncated(t, 300, "middle").alias("ends"))


@query("text_verdicts", "SELECT doc_id, CASE WHEN x >= 0.9 THEN 'A+' WHEN x >= 0.8 THEN 'A' WHEN x >= 0.7 THEN 'B+' WHEN x >= 0.6 THEN 'B' WHEN x >= 0.5 THEN 'C+' WHEN x >= 0.4 THEN 'C' WHEN x >= 0.3 THEN 'D' ELSE 'F' END AS grade, CASE WHEN x >= 0.95 THEN 'Excellent - Complete coverage of original content' WHEN x >= 0.85 THEN 'Good - Most content preserved' WHEN x >= 0.7 THEN 'Fair - Some content may be missing' ELSE 'Poor - Significant content loss' END AS coverage FROM (SELECT doc_id, (doc_id % 101) / 100 AS x FROM documents)")
def _(s, d):
    x = (F.col("doc_id") % 101) / 100
    return table(s, d, "documents").select("doc_id", T.grade(x).alias("grade"), T.verdict(x, "coverage").alias("coverage"))


STRATEGY_SQL = f"""SELECT doc_id, CASE WHEN content_type IN ('code', 'table', 'list') OR regexp_matches(text, '(?m)^#{{1,6}}\\s') THEN 'structure'
  WHEN list_sum(list_transform(string_split(text, chr(10)), lambda x: length(x))) / len(string_split(text, chr(10))) > 100 THEN 'token'
  WHEN len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S'))) < 3 THEN 'sentence' ELSE 'paragraph' END AS strategy, content_type
  FROM (SELECT doc_id, text, {_content_sql()} AS content_type FROM documents)"""


@query("chunk_strategy", STRATEGY_SQL)
def _(s, d):
    return table(s, d, "documents").select("doc_id", chunk.strategy(F.col("text"), "paragraph").alias("strategy"), T.content_type(F.col("text")).alias("content_type"))


@query("chunk_histograms", f"WITH t AS ({STRATEGY_SQL}) SELECT 'strategy' AS kind, strategy AS value, count(*) AS chunks FROM t GROUP BY strategy UNION ALL SELECT 'content_type', content_type, count(*) FROM t GROUP BY content_type")
def _(s, d):
    docs = table(s, d, "documents")
    return chunk.histograms(docs.select(chunk.strategy(F.col("text"), "paragraph").alias("strategy"), T.content_type(F.col("text")).alias("content_type")))


@query("chunk_ingest", WINDOWS + "SELECT id || '_' || chunk_id AS chunk, id, chunk_id, source, md5(w.text) AS hash FROM w JOIN documents ON doc_id = id")
def _(s, d):
    found = chunk.ingest(table(s, d, "documents"), facts=("source",))
    return found.select("chunk", "id", "chunk_id", "source", F.md5("text").alias("hash"))


@query("chunk_semantic")
def _(s, d):
    return chunk.semantic(table(s, d, "documents"))


@query("chunk_described")
def _(s, d):
    return chunk.described(chunk.hybrid(table(s, d, "documents")))


@query("chunk_report")
def _(s, d):
    docs = table(s, d, "documents")
    return chunk.report(chunk.quality(chunk.walk(docs, chunk.sentence_windows), docs))


@query("doc_process")
def _(s, d):
    return chunk.process(table(s, d, "documents"))


@query("embed_text")
def _(s, d):
    return table(s, d, "documents").select("doc_id", readers.hashing_encoder()(F.col("text")).alias("embedding"))


HISTORY = "WITH q AS (SELECT DISTINCT conv_id FROM conversations), p AS (SELECT conv_id, string_agg('Document ' || n || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS context, count(*) AS documents FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant' AND text IS NOT NULL) GROUP BY conv_id)"


def asked(s, d):
    c = table(s, d, "conversations")
    queries = c.select(F.col("conv_id").alias("query_id")).distinct().withColumn("text", F.concat(F.lit("conversation "), F.col("query_id").cast("string")))
    found = c.where("role = 'assistant' and text is not null").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("text").alias("content"))
    return queries, found


@query("rag_run", HISTORY + f""", r AS (SELECT q.conv_id, context, documents, 'Answer from the context only.' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: conversation ' || q.conv_id || chr(10) || chr(10) || 'Answer:' AS prompt FROM q LEFT JOIN p USING (conv_id))
SELECT conv_id AS query_id, md5(prompt) AS prompt, coalesce(documents, 0) AS documents, coalesce(length(context), 0)::INTEGER AS context_length, CASE WHEN documents IS NULL THEN 'no_documents_found' ELSE 'success' END AS status,
  CASE WHEN documents IS NULL THEN '{rag.APOLOGY}' WHEN contains(lower(prompt), 'machine learning') OR contains(lower(prompt), 'ml') THEN 'machine_learning' WHEN contains(lower(prompt), 'deep learning') OR contains(lower(prompt), 'neural') THEN 'deep_learning' WHEN contains(lower(prompt), 'artificial intelligence') OR contains(lower(prompt), 'ai') THEN 'artificial_intelligence' ELSE 'generic' END AS answer FROM r""")
def _(s, d):
    return rag.run(*asked(s, d)).select("query_id", F.md5("prompt").alias("prompt"), "documents", "context_length", "status", "answer")


@query("rag_top_answer", "SELECT q.conv_id AS query_id, CASE WHEN content IS NULL THEN 'No relevant document found.' ELSE 'Relevant info: ' || content END AS answer FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS content FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id) p USING (conv_id)")
def _(s, d):
    return rag.top_answer(*asked(s, d))


@query("rag_context_all", HISTORY + f" SELECT q.conv_id AS query_id, md5(coalesce(context, '{rag.NO_CONTEXT}')) AS hash FROM q LEFT JOIN p USING (conv_id)")
def _(s, d):
    queries, found = asked(s, d)
    return rag.context(found, queries).select("query_id", F.md5("context").alias("hash"))


@query("rag_recent", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def _(s, d):
    return rag.recent(table(s, d, "events"), order="event_id").select("event_id", "event_type")


@query("rag_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def _(s, d):
    return rag.last_turns(table(s, d, "conversations")).select("conv_id", "turn", "role")


@query("mon_held", """WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, epoch(start)::BIGINT // 3600 - row_number() OVER (PARTITION BY event_type ORDER BY start) AS run FROM w WHERE n > 2)
SELECT event_type, min(start) AS "from", max(start) AS "to", count(*) AS windows FROM r GROUP BY event_type, run HAVING count(*) >= 3""")
def _(s, d):
    return monitor.held(monitor.counters(table(s, d, "events")), "n", 2, 3, 3600, ["event_type"])
