"""Splitting documents into chunks: (id, chunk_id, start_char, text) rows.

Windows on fixed grids are DataFrame expressions. Where a window's start depends on what the one
before it found, a document is walked in an Arrow batch function.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = {"dr", "mr", "mrs", "ms", "vs", "etc", "inc", "ltd"}
_TOKEN = re.compile(r"\w+|[^\w\s]")


def char_windows(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[int, str]]:
    """Windows of `size` characters; one that ends inside the text is shortened to its last full stop
    if that lies, as a place within the window, beyond the absolute middle. Whole text if it fits."""
    if overlap * 2 >= size:
        raise ValueError("overlap must be under half the size")
    n = len(text)
    starts, ends = [0], []
    while n > size and starts[-1] < n or not ends:
        s = starts[-1]
        length = size
        if n > s + size:
            stop = text.rfind(".", s, s + size) - s
            length = stop + 1 if stop > s + size // 2 else size
        ends.append(s + length)
        starts.append(s + length - overlap)
    return [(0, text)] if n <= size else [(s, text[s:e].strip()) for s, e in zip(starts, ends)]


def last_sentence(text: str) -> str:
    """Up to the last mark that ends a sentence; all of it if none does."""
    for m in reversed(list(re.finditer(r"[.!?]", text))):
        i = m.start()
        if i == len(text) - 1 or text[i] != ".":
            return text[: i + 1].strip()
        word = re.search(r"[^\W\d_]*$", text[:i])[0].lower()
        if not (i and text[i - 1].isupper()) and word not in ABBREVIATIONS:
            return text[: i + 1].strip()
    return text


def token_windows(text: str, size: int = 500, overlap: int = 50, snap: bool = True, compat: bool = False) -> list[tuple[int, str]]:
    """Windows of `size` tokens, cut back to a sentence's end. The next one starts `overlap` tokens
    before the shortened end, so that no text is lost; with `compat`, before the unshortened one."""
    if overlap >= size:
        raise ValueError("overlap must be under the size")
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return []
    if len(spans) <= size:
        return [(0, text)]
    ends, out, at = [e for _, e in spans], [], 0
    while at < len(spans):
        stop = min(at + size, len(spans))
        piece = text[spans[at][0] : spans[stop - 1][1]]
        if snap and stop < len(spans):
            cut = last_sentence(piece)
            if not compat and cut:
                stop = max(at + overlap + 1, int(np.searchsorted(ends, spans[at][0] + len(cut), "right")))
                piece = text[spans[at][0] : spans[stop - 1][1]]
            else:
                piece = cut
        out.append((spans[at][0], piece))
        if stop >= len(spans):
            break
        at = stop - overlap
    return out


def sentences(text: str, least: int = 10) -> list[str]:
    """Pieces between white space after a mark and before a capital, joined until they end in a mark or
    hold a paragraph break; those shorter than `least` are dropped."""
    out, held = [], ""
    for piece in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text):
        held = f"{held} {piece.strip()}" if held else piece.strip()
        if held and (held[-1] in ".!?" or "\n\n" in held):
            out.append(held)
            held = ""
    return [x for x in [*out, held] if len(x) >= least]


def sentence_windows(text: str, most: int = 5, words: int = 500, overlap: int = 1) -> list[tuple[int, str]]:
    """Up to `most` sentences and `words` words (the first always fits); whole text if all fit."""
    found = sentences(text)
    if not found:
        return []
    sizes = [len(s.split()) for s in found]
    if len(found) <= most and sum(sizes) <= words:
        return [(0, text)]
    out, at = [], 0
    while at < len(found):
        stop, total = at + 1, sizes[at]
        while stop < len(found) and stop - at < most and total + sizes[stop] <= words:
            total += sizes[stop]
            stop += 1
        out.append((text.find(found[at]), " ".join(found[at:stop])))
        if stop >= len(found):
            break
        at = max(at + 1, stop - overlap)
    return out


def semantic_groups(text: str, encode: Callable[[list[str]], np.ndarray], least: float = 0.7, most: int = 5) -> list[tuple[int, str]]:
    """Each unused sentence in order takes up to most - 1 later unused ones similar to it."""
    found = sentences(text)
    if not found:
        return []
    v = encode(found)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    near, used, out = v @ v.T >= least, np.zeros(len(found), bool), []
    for i in range(len(found)):
        if not used[i]:
            group = [i, *[j for j in np.flatnonzero(near[i] & ~used) if j > i][: most - 1]]
            used[group] = True
            out.append((text.find(found[i]), " ".join(found[j] for j in group)))
    return out


def code_blocks(text: str) -> list[tuple[int, str]]:
    """Fenced blocks each, and the trimmed text between them; start is that of the untrimmed part."""
    out, at = [], 0
    for m in re.finditer(r"```\w*\n[\s\S]*?```", text):
        out += [(at, text[at : m.start()].strip()), (m.start(), m[0])]
        at = m.end()
    return [x for x in [*out, (at, text[at:].strip())] if x[1]]


def walk(docs: DataFrame, split: Callable[..., list[tuple[int, str]]], id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """Apply a Python splitter to each text, in Arrow batches. Blank and null texts have no chunks.
    Columns in `by` are passed to it after the text and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows, no, start, text = [], [], [], []
                given = [part.column(2 + i).to_pylist() for i in range(len(by))]
                for i, t in enumerate(part.column(1).to_pylist()):
                    for k, (s, piece) in enumerate(split(t, *(g[i] for g in given)) if t and t.strip() else []):
                        rows.append(i)
                        no.append(k)
                        start.append(s)
                        text.append(piece)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(text, pa.string()), *(part.column(2 + i).take(pa.array(rows, pa.int64())) for i in range(len(by)))], ["id", "chunk_id", "start_char", "text", *by])

    kind = docs.schema[id_col].dataType.simpleString()
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in by)
    return docs.select(F.col(id_col).alias("id"), text_col, *by).mapInArrow(run, f"id {kind}, chunk_id int, start_char long, text string{kept}")


def fixed_tokens(docs: DataFrame, size: int = 100, overlap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, token_count, text): windows on a fixed token grid, tokens joined by spaces."""
    if overlap >= size:
        raise ValueError("overlap must be under the size")
    t = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - overlap - 1), F.lit(size - overlap))
    rows = t.select("id", "w", F.posexplode(starts).alias("chunk_id", "at"))
    piece = F.slice("w", F.col("at") + 1, F.lit(size))
    return rows.select("id", "chunk_id", F.size(piece).alias("token_count"), F.array_join(piece, " ").alias("text"))


def paragraph_windows(docs: DataFrame, each: int = 3, least: int = 50, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, paragraphs, text): `each` paragraphs of `least` characters or more to a chunk."""
    trimmed = F.transform(F.split(text_col, "\n\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    t = docs.select(F.col(id_col).alias("id"), F.filter(trimmed, lambda x: F.length(x) >= least).alias("p")).where(F.size("p") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("p") - overlap - 1), F.lit(each - overlap))
    rows = t.select("id", "p", F.posexplode(starts).alias("chunk_id", "at"))
    piece = F.slice("p", F.col("at") + 1, F.lit(each))
    return rows.select("id", "chunk_id", F.size(piece).alias("paragraphs"), F.array_join(piece, "\n\n").alias("text"))


_HEADER = re.compile(r"(?m)^#{1,6}[ \t\x0b\f\r]+[^\n]+$")
_BLANK = " \t\n\x0b\f\r"


def header_windows(text: str) -> list[tuple[int, str]]:
    """A section starts at each header line; a preamble stays. Blank sections are dropped."""
    cuts = sorted({0, *(m.start() for m in _HEADER.finditer(text))})
    parts = [(s, text[s:e].strip(_BLANK)) for s, e in zip(cuts, [*cuts[1:], len(text)])]
    return [x for x in parts if x[1]]


def header_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, start_char, text) by header_windows()."""
    return walk(docs, header_windows, id_col, text_col)


def adaptive_size(t: Column, most: int = 1000, least: int = 200) -> Column:
    """Token window by complexity: harder texts get smaller ones."""
    c = T.complexity(t)
    return F.when(c > 0.8, F.greatest(F.lit(least), F.floor(F.lit(most * 0.7)).cast("int"))).when(c > 0.5, F.floor(F.lit(most * 0.85)).cast("int")).otherwise(most)


def strategy(t: Column, primary: str = "sentence") -> Column:
    """Which chunker suits a text: structure, token, sentence or the primary one."""
    lines = F.split(t, "\n")
    average = F.aggregate(F.transform(lines, F.length), F.lit(0), lambda s, x: s + x) / F.size(lines)
    return F.when(T.content_type(t).isin("code", "table", "list") | T.has_headers(t), "structure").when(average > 100, "token").when(F.size(T.paragraphs(t)) < 3, "sentence").otherwise(primary)


def adaptive(docs: DataFrame, most: int = 1000, least: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, start_char, text, size): token windows of the size that suits each text, in one walk."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), adaptive_size(F.col(text_col), most, least).alias("size"))
    return walk(sized, lambda t, n: token_windows(t, n, n // 10), "id", by=("size",))


def semantic(docs: DataFrame, encode: Callable[[list[str]], np.ndarray] | None = None, least: float = 0.7, most: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, start_char, text): groups of a text's similar sentences, see semantic_groups().
    `encode` gives a row for each sentence; without one, signed hashed words do."""
    return walk(docs, lambda t: semantic_groups(t, encode or hashed_words, least, most), id_col, text_col)


def hashed_words(texts: list[str], dim: int = 384) -> np.ndarray:
    """Signed hashed words of each text."""
    from zlib import crc32

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = crc32(w.encode())
            out[i, h % dim] += 1 if h >> 16 & 1 else -1
    return out


def hybrid(docs: DataFrame, tokens: int = 1000, most: int = 5, primary: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, start_char, text, strategy, content_type): each document by its own strategy, in one
    walk, short chunks of plain text merged into the one before."""
    t = F.col(text_col)
    raw = docs.select(F.col(id_col).alias("id"), T.normalize_space(t).alias("text"), strategy(t, primary).alias("strategy"), T.content_type(t).alias("content_type"))

    def split(text: str, how: str, kind: str) -> list[tuple[int, str]]:
        if how == "token":
            found = token_windows(text, tokens, tokens // 10)
        elif how == "sentence":
            found = sentence_windows(text, most)
        elif kind == "code":
            found = code_blocks(text)
        elif re.search(r"(?m)^#{1,6}\s", text):
            found = header_windows(text)
        else:
            found = [(0, text)]
        return [x for x in found if x[1].strip()]

    return merge_short(walk(raw, split, "id", by=("strategy", "content_type")))


def described(chunks: DataFrame, source: str = "hybrid") -> DataFrame:
    """Hybrid chunks with the facts of a chunk row: name, end, counts of tokens, words and sentences (none
    in code), kind and both strategies."""
    text, code = F.col("text"), F.col("content_type") == "code"
    count = F.size(F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: F.length(F.trim(x)) >= 10))
    return chunks.select(
        "id", F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string")).alias("chunk"), "start_char", (F.col("start_char") + F.length(text)).alias("end_char"),
        F.size(T.tokens(text)).alias("token_count"), F.when(code, 0).otherwise(count).alias("sentence_count"), T.word_count(text).alias("word_count"),
        F.lit(source).alias("chunk_type"), F.col("strategy").alias("primary_strategy"), F.when(code, "token").otherwise("sentence").alias("secondary_strategy"), "content_type", "text",
    )


def ingest(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text", facts: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, id, chunk_id, start_char, text, facts...): character windows named `<document>_<number>`, each
    with the document's facts."""
    found = walk(docs, lambda t, *_: char_windows(t, size, overlap), id_col, text_col, by=facts)
    return found.select(F.concat_ws("_", F.col("id").cast("string"), F.col("chunk_id").cast("string")).alias("chunk"), *found.columns)


def process(docs: DataFrame, chunker: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunks, tokens, avg_chars, status): clean, chunk and measure each document. A null or blank one
    has status `error`, as has one that gives no chunk; the others go on."""
    cleaned = docs.select(F.col(id_col).alias("id"), T.clean(F.col(text_col)).alias("text"))
    chunks = create(chunker)(cleaned, id_col="id", text_col="text")
    counts = chunks.groupBy("id").agg(F.count("*").alias("chunks"), F.sum(F.size(T.tokens(F.col("text")))).alias("tokens"), F.avg(F.length("text")).alias("avg_chars"))
    rows = docs.select(F.col(id_col).alias("id")).join(counts, "id", "left")
    return rows.select("id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "avg_chars", F.when(F.col("chunks").isNull(), "error").otherwise("success").alias("status"))


def histograms(chunks: DataFrame) -> DataFrame:
    """(kind, value, chunks): how many chunks each strategy and each content type has."""
    both = F.explode(F.array(F.struct(F.lit("strategy").alias("kind"), F.col("strategy").alias("value")), F.struct(F.lit("content_type").alias("kind"), F.col("content_type").alias("value"))))
    return chunks.select(both.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("chunks"))


def merge_short(chunks: DataFrame, least: int = 50) -> DataFrame:
    """Chunks of plain text under `least` characters join the last longer one before them."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("id").orderBy("chunk_id")
    starts = (F.col("content_type") != "text") | (F.length("text") >= least) | (F.row_number().over(by) == 1)
    islands = chunks.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(by) - 1)
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    rows = islands.groupBy("id", "island").agg(F.min_by("start_char", "chunk_id").alias("start_char"), parts.alias("parts"), F.first("strategy").alias("strategy"), F.first("content_type").alias("content_type"))
    return rows.select("id", F.col("island").cast("int").alias("chunk_id"), "start_char", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"), "strategy", "content_type")


CHUNKERS = {"char": char_windows, "token": token_windows, "sentence": sentence_windows, "code": code_blocks, "header": header_windows}


def create(name: str, **options) -> Callable[[DataFrame], DataFrame]:
    """A chunker by name; unknown names are an error."""
    native = {"fixed_token": fixed_tokens, "paragraph": paragraph_windows, "adaptive": adaptive, "semantic": semantic, "hybrid": hybrid}
    if name in native:
        return lambda docs, **cols: native[name](docs, **options, **cols)
    if name in CHUNKERS:
        return lambda docs, **cols: walk(docs, lambda t: CHUNKERS[name](t, **options), **cols)
    raise ValueError(f"unknown chunker: {name}")


def statistics(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and sizes of chunks by `keys`; no chunks give no row. Sentences are estimated as a fifteenth
    of a chunk's words, 1 at least."""
    estimate = F.greatest(F.lit(1), F.floor(T.word_count(F.col("text")) / 15))
    tokens, chars = F.size(T.tokens(F.col("text"))), F.length("text")
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("chunks"), F.sum(tokens).alias("tokens"), F.avg(tokens).alias("avg_tokens"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"),
        F.avg(chars).alias("avg_chars"), F.sum(chars).alias("chars"), F.stddev_pop(chars).alias("std_chars"), F.median(chars).alias("median_chars"), F.sum(estimate).alias("sentences"),
    )


def quality(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size_score, coverage_score, overlap_score, boundary_score, coherence_score, overall) per document."""
    from pyspark.sql.window import Window

    text = F.col("text")
    by = Window.partitionBy("id").orderBy("chunk_id")
    w, nxt = T.words(text), F.col("next_words")
    reach = F.least(F.size("words"), F.size(nxt)).cast("int")
    half = F.floor(reach / 2).cast("int")
    shared = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(half, F.lit(1))), lambda j: (j <= half) & (F.slice("words", F.size("words") - j + 1, j) == F.slice(nxt, F.lit(1), j)))), F.lit(0))
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    up = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    low = lambda c: (F.lower(c) == c) & (F.upper(c) != c)
    boundary = 0.3 * up(first).cast("int") + 0.3 * last.isin(".", "!", "?").cast("int") + 0.2 * (~last.isin(",", ";", ":")).cast("int") + 0.2 * (~(low(first) & (F.length(text) > 1))).cast("int")
    sentence_count = F.size(F.filter(F.split(text, r"[.!?]+"), lambda x: F.trim(x) != ""))
    lower = F.transform(F.regexp_extract_all(F.lower(text), F.lit(T.WORD), F.lit(0)), lambda x: x)
    distinct = F.size(F.array_distinct(lower))
    again = lambda x, i: (i > 0) & (x == F.get(F.col("sorted"), i - 1))
    often = F.size(F.array_distinct(F.filter(F.col("sorted"), again)))
    coherence = F.when(sentence_count <= 1, 1.0).when(distinct == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * often / distinct))
    rows = chunks.withColumn("words", w).withColumn("sorted", F.array_sort(lower)).withColumn("next_words", F.lead(w).over(by)).withColumn("size", F.length("text")).withColumn("b", boundary).withColumn("c", coherence)
    rows = rows.withColumn("ratio", F.when(nxt.isNotNull(), F.when(reach > 0, shared / reach).otherwise(0.0)))
    per = rows.groupBy("id").agg(
        F.count("*").alias("n"), F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.stddev_pop("size"), F.avg("size")), F.lit(0.0))).alias("size_score"),
        F.sum("size").alias("chars"), F.array_distinct(F.flatten(F.collect_list(F.transform("words", F.lower)))).alias("seen"),
        F.avg("ratio").alias("overlap"), F.avg("b").alias("boundary_score"), F.avg("c").alias("coherence_score"),
    )
    whole = docs.select(F.col(id_col).alias("id"), F.length(text_col).alias("len"), F.array_distinct(F.transform(T.words(F.col(text_col)), F.lower)).alias("vocabulary"))
    both = per.join(whole, "id")
    coverage = F.least(F.when(F.col("len") > 0, F.col("chars") / F.col("len")).otherwise(0.0), F.when(F.size("vocabulary") > 0, F.size(F.array_intersect("seen", "vocabulary")) / F.size("vocabulary")).otherwise(0.0))
    overlap = F.when(F.coalesce("overlap", F.lit(0.0)) > 0.8, 0.7).when((F.coalesce("overlap", F.lit(0.0)) < 0.2) & (F.col("n") > 1), 0.6).otherwise(1.0)
    out = both.select("id", "size_score", coverage.alias("coverage_score"), overlap.alias("overlap_score"), "boundary_score", "coherence_score")
    return out.withColumn("overall", overall())


# The weight of each measure in the overall score.
WEIGHTS = {"size_score": 0.2, "coverage_score": 0.3, "overlap_score": 0.2, "boundary_score": 0.2, "coherence_score": 0.1}


def overall(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the measures that are there (not null); 0 if none is."""
    there = sum(F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items())
    total = sum(F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items())
    return F.when(there > 0, total / there).otherwise(0.0)


def report(scores: DataFrame) -> DataFrame:
    """(id, report): each measure with its verdict, and the overall score with its grade, as text."""
    names = {"size_score": "size", "coverage_score": "coverage", "overlap_score": "overlap", "boundary_score": "boundary", "coherence_score": "coherence", "overall": "overall"}
    lines = [F.concat(F.lit(f"{m}: "), F.format_string("%.3f", c), F.lit(" - "), T.verdict(F.col(c), m)) for c, m in names.items()]
    return scores.select("id", F.concat_ws("\n", *lines, F.concat(F.lit("grade: "), T.grade(F.col("overall")))).alias("report"))
