"""LM scoring with a probabilistic suffix tree.

A text is the stream of its A-Z lower-cased words, each followed by a space, but for the last space,
which is a line end: the text's end. (Words hold neither.) Symbols are the stream's bytes; contexts
are the up to DEPTH bytes before a symbol, with line ends before the start. Every context counted
LEAST_COUNT times has a distribution, interpolated with its parent's (that of the context without its
oldest byte) by the number of distinct next symbols, down to a uniform one, so every stream has a
probability. The tree keeps a context if its distribution tells enough from its parent's (the likelihood
gain over the parent must exceed GAIN nats for each of its next symbols), and with it all its suffixes.
A symbol is scored by its longest kept context.

Counts of all training texts are gathered per context and symbol by a shuffle, after each task has
summed its own. Bytes of a context are laid out latest first, so contexts of one parent sort together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, materialize, table

DEPTH = 5
LEAST_COUNT = 16
GAIN = 2.0
ALPHABET = 256
TASK_GRAMS = 1 << 21  # distinct grams a task holds before it passes them on
BATCH_BYTES = 1 << 21
SHARD_ENTRIES = 3_000_000  # of the tree, broadcast at once (12 bytes each)
FREQUENT = 1 << 17  # words whose counts are broadcast; others' are joined
END = b"\n"


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def stream(text: bytes | None) -> tuple[bytes, list[list[bytes]]]:
    """A text's stream, and its words in lists; of a long text each is of about BATCH_BYTES, and nothing
    else holds all its words."""
    runs, joined, at = [], [], 0
    while text and at < len(text):
        cut = _SPACE.search(text, at + BATCH_BYTES)
        end = cut.end() if cut else len(text)
        if words := text[at:end].lower().split():
            joined.append(b" ".join(words))
            runs.append(words if end - at == len(text) else Words(words))
        at = end
    return b" ".join(joined) + END, runs


class Words:
    """A long text's run of words: as bytes until it is looked at."""

    def __init__(self, words: list[bytes]):
        self.n, self.joined = len(words), b" ".join(words)

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[bytes]:
        return iter(self.joined.split())


def padded(s: bytes) -> list[bytes]:
    """A stream in pieces of up to BATCH_BYTES symbols, each after the DEPTH bytes before it."""
    whole = END * DEPTH + s
    return [whole[at : at + BATCH_BYTES + DEPTH] for at in range(0, len(s), BATCH_BYTES)]


def grams(pieces: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """A code for each symbol of the pieces but their first `depth` bytes: its context's bytes, latest
    first, then the symbol."""
    a = np.frombuffer(b"".join(pieces), np.uint8)
    code = np.zeros(len(a) - depth, np.uint64)
    for back in range(1, depth + 1):
        code = code << np.uint64(8) | a[depth - back : len(a) - back]
    code = code << np.uint64(8) | a[depth:]
    if len(pieces) == 1:
        return code
    keep = np.ones(len(code), bool)
    after = np.cumsum([len(x) for x in pieces[:-1]]) - depth
    keep[(after[:, None] + np.arange(depth)).ravel()] = False
    return code[keep]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def count_corpus(docs: DataFrame, train: Column, text_col: str) -> DataFrame:
    """(kind, code, n): gram counts ('g') and, by hash, word counts ('w') of training rows, summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held, pending, size = [], [], 0

        def out(kind, codes, counts):
            for at in range(0, len(codes), 1 << 18):
                c, n = codes[at : at + (1 << 18)], counts[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), pa.array(c.view(np.int64)), pa.array(n)], ["kind", "code", "n"])

        def word_rows():
            codes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            yield from out(1, codes, np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        def fold():
            nonlocal held, pending, size
            if pending:
                codes = np.sort(grams(pending))
                first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                held.append((codes[first], np.diff(np.append(first, len(codes)))))
                held = [_merge(held)] if len(held) > 7 else held
                pending, size = [], 0

        for b in batches:
            for text in b.column(0).to_pylist():
                s, runs = stream(text)
                for w in runs:
                    words.update(w)
                for piece in padded(s):
                    pending.append(piece)
                    size += len(piece)
                    if size >= BATCH_BYTES:
                        fold()
                if not pending:
                    if sum(len(h[0]) for h in held) > TASK_GRAMS:
                        held = [_merge(held)]
                        if len(held[0][0]) > TASK_GRAMS:
                            yield from out(0, *held[0])
                            held = []
                    if len(words) > TASK_GRAMS:
                        yield from word_rows()
        fold()
        if held:
            yield from out(0, *_merge(held))
        yield from word_rows()

    rows = docs.where(train).select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "kind int, code long, n long")
    return rows.groupBy("kind", "code").agg(F.sum("n").alias("n"))


def tree(counts: DataFrame, depth: int = DEPTH, least: int = LEAST_COUNT, gain: float = GAIN) -> DataFrame:
    """Gram counts (code, n) -> (depth, context, symbol, logp) of the kept contexts' seen symbols, and
    with symbol -1 the log10 weight that a symbol unseen there gives to the parent's probability."""
    at = {depth: counts}
    for d in range(depth - 1, -1, -1):
        shorter = F.expr(f"shiftleft(shiftright(code, 16), 8) | (code & 255)")
        at[d] = materialize(at[d + 1].select(shorter.alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n")), f"grams-{d}")
    root = at[0].select(F.lit(0).cast("long").alias("context"), F.col("code").alias("symbol"), "n")
    total = root.agg(F.sum("n").alias("c"), F.count("*").alias("k"))
    c, k = (x or 0 for x in total.first())
    p0 = root.withColumn("p", (F.col("n") + k / ALPHABET) / (c + k)) if c else root.withColumn("p", F.lit(1.0 / ALPHABET))
    unseen = (k / ALPHABET) / (c + k) if c else 1.0 / ALPHABET
    spark = counts.sparkSession
    out = [p0.select(F.lit(0).alias("depth"), "context", "symbol", F.log10("p").alias("logp")), spark.createDataFrame([(0, 0, -1, float(np.log10(unseen)))], "depth int, context long, symbol long, logp double")]
    levels, told, above = [], [], p0
    for d in range(1, depth + 1):
        rows = at[d].select(F.expr("shiftright(code, 8)").alias("context"), F.expr("code & 255").alias("symbol"), "n")
        sums = rows.groupBy("context").agg(F.sum("n").alias("c"), F.count("*").alias("k")).where(F.col("c") >= least)
        up = above.select(F.col("context").alias("parent"), "symbol", F.col("p").alias("q"))
        met = rows.join(sums, "context").withColumn("parent", F.expr("shiftright(context, 8)")).join(up, ["parent", "symbol"])
        met = met.withColumn("p", (F.col("n") + F.col("k") * F.col("q")) / (F.col("c") + F.col("k")))
        above = materialize(met, f"level-{d}")
        levels.append(above)
        tells = above.groupBy("context").agg((F.sum(F.col("n") * F.log(F.col("p") / F.col("q"))) - gain * F.count("*")).alias("g")).where("g > 0")
        told.append(tells.select("context"))
    below = None
    for d in range(depth, 0, -1):
        retained = told[d - 1] if below is None else told[d - 1].unionByName(below.select(F.expr("shiftright(context, 8)").alias("context"))).distinct()
        below = materialize(retained, f"retained-{d}")
        kept = levels[d - 1].join(below, "context", "left_semi")
        out.append(kept.select(F.lit(d).alias("depth"), "context", "symbol", F.log10("p").alias("logp")))
        rest = kept.groupBy("context").agg(F.first("c").alias("c"), F.first("k").alias("k"))
        out.append(rest.select(F.lit(d).alias("depth"), "context", F.lit(-1).cast("long").alias("symbol"), F.log10(F.col("k") / (F.col("c") + F.col("k"))).alias("logp")))
    whole = out[0]
    for rows in out[1:]:
        whole = whole.unionByName(rows)
    return materialize(whole, "tree")


class SuffixTree:
    """A part of the tree, as sorted arrays: contexts whose two latest bytes, as a number, are in the
    range `latest` (None: all)."""

    def __init__(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], latest: tuple[int, int] | None):
        depth, context, symbol, logp = rows
        self.latest, self.depth = latest, int(depth.max(initial=0))
        self.contexts, self.weights, self.entries, self.values = [], [], [], []
        for d in range(self.depth + 1):
            w, e = (depth == d) & (symbol < 0), (depth == d) & (symbol >= 0)
            order = np.argsort(context[w])
            self.contexts.append(context[w][order])
            self.weights.append(logp[w][order])
            code = context[e] << 8 | symbol[e].astype(np.int64)
            order = np.argsort(code)
            self.entries.append(code[order])
            self.values.append(logp[e][order])

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each gram (sorted int64 codes of DEPTH context bytes and the symbol)."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for d in range(self.depth, -1, -1):
            c = codes[open_]
            context, symbol = c >> (8 * (DEPTH - d + 1)), c & 255
            if not d:
                context = np.zeros_like(context)
            at = np.searchsorted(self.contexts[d], context)
            at[at == len(self.contexts[d])] = 0
            here = self.contexts[d][at] == context if len(self.contexts[d]) else np.zeros(len(c), bool)
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            code = context[rows] << 8 | symbol[rows]
            found = np.searchsorted(self.entries[d], code)
            found[found == len(self.entries[d])] = 0
            hit = self.entries[d][found] == code
            out[open_[rows]] += np.where(hit, self.values[d][found], self.weights[d][at[rows]])
            done = np.zeros(len(c), bool)
            done[rows[hit]] = True
            open_ = open_[~done]
        return out

    def score(self, pieces: list[bytes]) -> np.ndarray:
        """Sum over each padded piece's symbols, of those whose latest context bytes are this part's."""
        codes = grams(pieces).view(np.int64)
        order = np.argsort(codes)
        ranked = codes[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        value = np.empty(len(codes))
        distinct = ranked[new]
        p = self.logp(distinct)
        if self.latest is not None:
            pair = distinct >> (8 * (DEPTH - 1))
            p = np.where((pair >= self.latest[0]) & (pair < self.latest[1]), p, 0.0)
        value[order] = p[np.cumsum(new) - 1]
        ends = np.cumsum([len(s) - DEPTH for s in pieces])
        return np.add.reduceat(value, np.concatenate([[0], ends[:-1]]))

    def score_streams(self, streams: list[bytes]) -> np.ndarray:
        """Sum over each stream's symbols; long streams a piece at a time."""
        out, held, rows, size = np.zeros(len(streams)), [], [], 0
        for i, s in enumerate(streams):
            for piece in padded(s):
                held.append(piece)
                rows.append(i)
                size += len(piece)
                if size >= BATCH_BYTES:
                    np.add.at(out, rows, self.score(held))
                    held, rows, size = [], [], 0
        if held:
            np.add.at(out, rows, self.score(held))
        return out


def tree_parts(rows: DataFrame, most: int | None = None) -> list[tuple[int, int] | None]:
    """Ranges of the two latest context bytes whose entries number `most` at most together, or hold one
    pair only (None: all at once). Contexts of one byte belong to each range that has it first."""
    most = most or SHARD_ENTRIES
    pair = F.expr("CASE WHEN depth = 0 THEN -1 WHEN depth = 1 THEN shiftleft(context, 8) ELSE shiftright(context, 8 * (depth - 2)) END")
    by = {r["b"]: r["count"] for r in rows.groupBy(pair.alias("b")).count().collect()}  # 2**16 + 1 rows at most
    root = by.pop(-1, 0)
    if root + sum(by.values()) <= most:
        return [None]
    parts, start, size = [], 0, root
    for b in sorted(by):
        if size + by[b] > most and size > root:
            parts.append((start, b))
            start, size = b, root
        size += by[b]
    return [*parts, (start, 1 << 16)]


def part_rows(rows: DataFrame, latest: tuple[int, int] | None) -> DataFrame:
    """The tree's entries that a range of tree_parts() needs."""
    if latest is None:
        return rows
    low, high = latest
    one = (F.col("depth") == 1) & F.col("context").between(low >> 8, (high - 1) >> 8)
    more = (F.col("depth") > 1) & F.expr("shiftright(context, 8 * (depth - 2))").between(low, high - 1)
    return rows.where((F.col("depth") == 0) | one | more)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) per row of `docs`, learning from the
    rows where `train` holds.

    base_score: the unigram model's log10 probability with add-one smoothing, (count + 1) / (N + V + 1)
    for N training tokens of V kinds and one unknown kind; score: the suffix tree's. A null, empty or blank text is its end token alone. Rows that repeat an id are scored
    each. Other columns are ignored; an empty table gives an empty table; without any training row
    all counts are zero. Words are told apart by a 64-bit hash.
    """
    spark = docs.sparkSession
    counts = materialize(count_corpus(docs, train, text_col), "counts")
    model = tree(counts.where("kind = 0").select("code", "n"))
    ends = docs.where(train).count()
    words = counts.where("kind = 1").select(F.col("code").alias("word"), "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = total + ends, distinct + (1 if ends else 0)
    floor = float(np.log10(n + v + 1))
    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    top = [c.to_numpy() for c in top.sort_by("word").columns]
    frequent = spark.sparkContext.broadcast((top[0], top[1]))
    end_value = float(np.log10(ends + 1)) - floor

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    parts, done = tree_parts(model), None
    if len(parts) > 1:
        keyed = materialize(keyed, "numbered")  # the passes join by row number: it is given once
    for i, latest in enumerate(parts):
        columns = part_rows(model, latest).select(F.col("depth").cast("tinyint"), "context", F.col("symbol").cast("smallint"), F.col("logp").cast("float")).toArrow().columns
        piece = spark.sparkContext.broadcast(SuffixTree(tuple(c.to_numpy() for c in columns), latest))
        del columns

        def run(batches: Iterator[pa.RecordBatch], first=not i, piece=piece) -> Iterator[pa.RecordBatch]:
            common, common_n = frequent.value
            for b in batches:
                texts = b.column(2).to_pylist()
                at = 0
                while at < len(texts):
                    streams, size, start, rows = [], 0, at, []
                    while at < len(texts) and size < BATCH_BYTES:
                        s, runs = stream(texts[at])
                        streams.append(s)
                        size += len(s)
                        at += 1
                        if not first:
                            continue
                        own: Counter = Counter()
                        for w in runs:
                            own.update(w)
                        h = np.fromiter((xxhash.xxh64_intdigest(x) for x in own), np.uint64, len(own)).view(np.int64)
                        rows.append((sum(map(len, runs)) + 1, h, np.fromiter(own.values(), np.int64, len(own))))
                    value = piece.value.score_streams(streams)
                    columns = [b.column(0).slice(start, at - start), b.column(1).slice(start, at - start), pa.array(value)]
                    if first:
                        sizes = np.array([len(r[1]) for r in rows])
                        h, own_n = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
                        place = np.searchsorted(common, h)
                        place[place == len(common)] = 0
                        hit = common[place] == h if len(common) else np.zeros(len(h), bool)
                        doc = np.repeat(np.arange(len(rows)), sizes)
                        base = np.where(hit, (np.log10(common_n[place] + 1) if len(common) else 0.0) - floor, 0.0) * own_n
                        rare, bounds = ~hit, np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=len(rows)))])
                        columns += [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.bincount(doc, base, len(rows)) + end_value), pa.array(np.bincount(doc, own_n * hit, len(rows)).astype(np.int64) + (1 if ends else 0))]
                        columns += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x[rare])) for x in (h, own_n)]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "id", "score", "n_tokens", "base", "known", "rare", "rare_n"][: len(columns)])

        fields = f"row long, id {kind}, score double" + (", n_tokens long, base double, known long, rare array<long>, rare_n array<long>" if not i else "")
        scored = materialize(keyed.mapInArrow(run, fields), "scored")
        piece.unpersist()
        done = scored if done is None else done.join(scored.select("row", F.col("score").alias("more")), "row").withColumn("score", F.col("score") + F.col("more")).drop("more")

    tail = done.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("m"))
    rest = tail.join(words, "word", "left").groupBy("row").agg(F.sum(F.col("m") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - floor)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("also"))
    both = done.drop("rare", "rare_n").join(rest, "row", "left")
    return both.select("id", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, id_remainder(F.col("doc_id"), 7) != 2)
    return found.select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
