"""Prompts, contexts and extractive answers from retrieved passages."""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NO_CONTEXT = "No context found."
APOLOGY = "I could not find any relevant documents to answer the question."


@dataclass
class Template:
    """A named text with {variables}. Missing variables are an error, extra ones are not."""

    name: str
    text: str
    uses: int = field(default=0)

    @property
    def variables(self) -> list[str]:
        return [v for _, v, _, _ in string.Formatter().parse(self.text) if v]

    def format(self, **values: str) -> str:
        if missing := set(self.variables) - set(values):
            raise ValueError(f"missing variables: {sorted(missing)}")
        self.uses += 1
        return self.text.format(**values)

    def column(self, **values: Column) -> Column:
        if missing := set(self.variables) - set(values):
            raise ValueError(f"missing variables: {sorted(missing)}")
        parts = []
        for literal, variable, _, _ in string.Formatter().parse(self.text):
            parts += [F.lit(literal)] if literal else []
            parts += [values[variable]] if variable else []
        return F.concat(*parts)


LIBRARY = {
    t.name: t
    for t in (
        Template("basic_qa", "Answer from the context only.\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:"),
        Template("detailed_analysis", "Study the context and give a thorough analysis.\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnalysis:"),
    )
}


def context(passages: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, content) -> (query_id, context): numbered documents, blank lines between. Given
    `queries`, those without a passage have a row that says so."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "content")))
    text = F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(": "), x["content"])), "\n\n")
    found = passages.where("content is not null").groupBy("query_id").agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_CONTEXT)).alias("context"))
    if queries is None:
        return found
    return queries.select("query_id").distinct().join(found, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def budgeted_context(passages: DataFrame, budget: int = 2000) -> DataFrame:
    """The same within `budget` characters: the first document that doesn't fit is cut to what is
    left less 50, with "...", if that is anything; nothing comes after it."""
    by = Window.partitionBy("query_id").orderBy("rank")
    block = F.concat(F.lit("Document "), F.row_number().over(by).cast("string"), F.lit(":\n"), F.col("content"), F.lit("\n\n"))
    rows = passages.withColumn("block", block).withColumn("used", F.coalesce(F.sum(F.length("block")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fits = F.col("used") + F.length("block") <= budget
    rows = rows.withColumn("over", F.sum((~fits).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    left = budget - F.col("used") - 50
    cut = F.concat(F.lit("Document "), F.row_number().over(by).cast("string"), F.lit(":\n"), F.substring("content", F.lit(1), left), F.lit("...\n\n"))
    rows = rows.withColumn("piece", F.when(F.col("over") == 0, F.col("block")).when((F.col("over") == 1) & ~fits & (left > 0), cut).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("rank", "piece")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("context"))


def answer(queries: DataFrame, passages: DataFrame, most: int = 2000) -> DataFrame:
    """(query_id, text) with (query_id, rank, content) -> extractive answers; a fixed apology without any."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "content")))
    joined = passages.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("all"), F.count("*").alias("n"))
    rows = queries.join(joined, "query_id", "left")
    body = F.when(F.length("all") > most, F.concat(F.substring("all", 1, most), F.lit("..."))).otherwise(F.col("all"))
    text = F.when(F.col("n").isNull(), F.lit(APOLOGY)).otherwise(F.concat(F.lit("From "), F.col("n").cast("string"), F.lit(" passages on: "), F.col("text"), F.lit("\n\n"), body))
    return rows.select("query_id", text.alias("answer"), F.coalesce("n", F.lit(0)).alias("documents"), F.when(F.col("n").isNull(), "no_documents_found").otherwise("success").alias("status"))


def run(queries: DataFrame, passages: DataFrame, template: str = "basic_qa", budget: int | None = None, generate=None) -> DataFrame:
    """Retrieved passages to answers: (query_id, question, prompt, answer, documents, context_length, status).

    queries: (query_id, text); passages: (query_id, rank, content). The context, all of it or within
    `budget` characters, and the question fill the template. `generate`, a function Column -> Column of
    the prompt, answers; without one the topic by key words does (route_answer). A query without passages
    has the fixed apology and status no_documents_found; one whose answer is null, as a generator gives
    where it fails, has status error.
    """
    from vellum.functions import text as T

    built = budgeted_context(passages, budget) if budget else context(passages)
    counts = passages.groupBy("query_id").agg(F.count("*").alias("documents"))
    rows = queries.join(built, "query_id", "left").join(counts, "query_id", "left")
    prompt = LIBRARY[template].column(context=F.col("context"), question=F.col("text"))
    answered = rows.withColumn("prompt", prompt).withColumn("answer", (generate or T.route_answer)(F.col("prompt")))
    none, failed = F.col("documents").isNull(), F.col("answer").isNull()
    return answered.select(
        "query_id", F.col("text").alias("question"), "prompt",
        F.when(none, F.lit(APOLOGY)).when(failed, F.lit("The question could not be processed.")).otherwise(F.col("answer")).alias("answer"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.length("context"), F.lit(0)).alias("context_length"),
        F.when(none, "no_documents_found").when(failed, "error").otherwise("success").alias("status"),
    )


def top_answer(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, answer): the best passage, or that there is none."""
    best = passages.groupBy("query_id").agg(F.min_by("content", "rank").alias("content"))
    text = F.when(F.col("content").isNull(), "No relevant document found.").otherwise(F.concat(F.lit("Relevant info: "), F.col("content")))
    return queries.join(best, "query_id", "left").select("query_id", text.alias("answer"))


def recent(history: DataFrame, n: int = 10, order: str = "seq") -> DataFrame:
    """The last n entries of a history, newest first."""
    return history.orderBy(F.desc(order)).limit(n)


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """(conv_id, turn, role, text): the last n turns of each conversation."""
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(by)).where(F.col("back") <= n).drop("back")


def append_history(answers: DataFrame, path: str) -> None:
    """Add answered queries to a history as JSON lines."""
    answers.write.mode("append").json(path)


def pipeline_stats(history: DataFrame) -> DataFrame:
    """Totals of a query history (status, processing_time); zeros when it is empty."""
    good = F.count_if(F.col("status") == "success")
    return history.agg(F.count("*").alias("queries"), good.alias("succeeded"), F.coalesce(F.avg("processing_time"), F.lit(0.0)).alias("avg_time"), F.when(F.count("*") > 0, good / F.count("*")).otherwise(0.0).alias("success_rate"))
