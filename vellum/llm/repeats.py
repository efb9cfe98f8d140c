"""Exact removal of long repeats by prefix-free parsing.

Triggers: a position is a trigger if the hash of the 8 bytes there is the least within some run of
TRIGGER_RUN positions (the leftmost of equals). Every 200-byte string holds the trigger of its first
run, found from its own bytes alone, so equal strings hold equal triggers at equal places and a
phrase is never longer than a run. The strings of a document that share a trigger lie next to each
other; together they span a phrase: the bytes from the first one's start to the last one's end. All
hold the CORE bytes after the trigger.

The dictionary: phrases are grouped by core and ordered, so that equal phrases meet. Where a phrase
occurs again, all its strings do. A core that occurs once holds no repeat. Only where a core has
several different phrases does the text decide: one of each goes to the core's group, and ranks of
all suffixes of the group's phrases, by prefix doubling up to 200 bytes (their suffix array, as far as
it matters), tell which strings are equal. Offsets of all these strings, back in their documents,
give the bytes to remove.

A line that very many documents hold has one core. So phrases that meet their like within a batch are
settled there, and only one of each goes to its core's task; the others are dealt at random. And a
core with over CROWDED different phrases is no group: its strings part by their 128-bit hashes.

Cores and phrases are told apart by 64-bit hashes, phrases only within a core; the strings of
different phrases are compared byte by byte, but for those of crowded cores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, table

LENGTH = 200
TRIGGER_RUN = 120
CORE = LENGTH - TRIGGER_RUN + 1
CHUNK = 1 << 19  # positions looked at together
GROUP_BYTES = 1 << 19  # phrases ranked together, at the end of a core's group
CROWDED = 2048  # different phrases of a core that are ranked together at most
SLICE = 256  # texts held as Python objects together
PENDING = 1 << 19  # phrases, or strings, settled together


def triggers(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that share a trigger: first start, number of strings, trigger."""
    strings = len(text) - LENGTH + 1
    if strings <= 0:
        return (np.zeros(0, np.int64),) * 3
    found = []
    for at in range(0, strings, CHUNK):
        n = min(CHUNK, strings - at)
        code = np.ndarray((n + TRIGGER_RUN - 1,), "<u8", text, at, (1,))
        h = code * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        low = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= TRIGGER_RUN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = TRIGGER_RUN - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        place = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((first + at, np.diff(np.append(first, n)), place[first] + at))
    return tuple(np.concatenate(x) for x in zip(*found))


def _first_of_each(key: np.ndarray, at: np.ndarray, major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows equal where (major, minor) are: what deals them out, major for the first of equals and
    a hash of (key, at) for the others, and whether a row has an equal one."""
    order = np.lexsort((minor, major))
    same = np.concatenate([[False], (major[order][1:] == major[order][:-1]) & (minor[order][1:] == minor[order][:-1])])
    later, sure = np.empty(len(order), bool), np.empty(len(order), bool)
    later[order], sure[order] = same, same | np.concatenate([same[1:], [False]])
    h = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return np.where(later, (h ^ (h >> np.uint64(32))).view(np.int64), major), sure


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, start, n, core, phrase, sure) of each run of strings that share a trigger.
    sure: an equal phrase of the core is in the same batch; all but one of them have a random core."""
    digest = xxhash.xxh64_intdigest
    out: list[list] = [[], [], [], [], []]

    def settle() -> pa.RecordBatch:
        key, start, n, core, phrase = map(np.concatenate, out)
        core, sure = _first_of_each(key, start, core, phrase)
        for c in out:
            c.clear()
        return pa.RecordBatch.from_arrays([*map(pa.array, (key, start, n, core, phrase, sure))], ["key", "start", "n", "core", "phrase", "sure"])

    size = 0
    for b in batches:
        for part in slices(b, SLICE):
            for key, text in zip(*(c.to_pylist() for c in part.columns)):
                if text is None or len(text) < LENGTH:
                    continue
                start, n, trigger = triggers(text)
                s, t, e = start.tolist(), trigger.tolist(), (start + n + (LENGTH - 1)).tolist()
                out[0].append(np.full(len(s), key, np.int64))
                out[1].append(start)
                out[2].append(n)
                out[3].append(np.array([digest(text[i : i + CORE]) for i in t], np.uint64).view(np.int64))
                out[4].append(np.array([digest(text[i:j], k - i) for i, j, k in zip(s, e, t)], np.uint64).view(np.int64))
                size += len(s)
                if size >= PENDING:
                    yield settle()
                    size = 0
    if size:
        yield settle()


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (core, phrase) -> those whose phrase occurs again (again), and the first row of
    each phrase of a core that has several (differs). Keeps two rows of a group that goes on."""
    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)] + [np.zeros(b.num_rows, bool) for _ in range(3)]
        key, start, n, core, phrase, sure, told, named, other = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
        same_core = np.concatenate([[False], core[1:] == core[:-1]])
        same = same_core & np.concatenate([[False], phrase[1:] == phrase[:-1]])
        again = sure | same | np.concatenate([same[1:], [False]])
        group = np.cumsum(~same_core) - 1
        several = (np.bincount(group, ~same) > 1) | (np.bincount(group, other) > 0)
        differs = ~same & several[group]
        say_again, say_differs = again & ~told, differs & ~named
        rows = np.flatnonzero(say_again | say_differs)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (key, start, n, core, say_again, say_differs)], ["key", "start", "n", "core", "again", "differs"])
        last = np.flatnonzero(~same)[-1]
        hold = np.unique([last, len(core) - 1])
        kept = [x[hold] for x in (key, start, n, core, phrase, sure, told | again, named | differs, np.full(len(core), several[-1]))]


def equal_strings(phrases: list[bytes]) -> list[np.ndarray]:
    """For each phrase, whether each of its LENGTH-byte strings also starts elsewhere in `phrases`.

    Prefix doubling: ranks of all suffixes by their first 8, 16, ... 128 bytes, then of those that
    start a string by 200, as two overlapping runs of 128.
    """
    text = b"".join(phrases) + bytes(LENGTH)
    rank, width = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,)).copy(), 8

    def dense(code: np.ndarray) -> np.ndarray:
        order = np.argsort(code)
        ranked = code[order]
        out = np.empty(len(code), np.uint64)
        out[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        return out

    rank = dense(rank)
    while 2 * width <= LENGTH:
        rank = dense(rank[:-width] << np.uint64(32) | rank[width:])
        width *= 2
    sizes = np.array([len(p) for p in phrases])
    n = sizes - LENGTH + 1
    begin = np.cumsum(sizes) - sizes
    starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    whole = rank[starts] << np.uint64(32) | rank[starts + (LENGTH - width)]
    order = np.argsort(whole)
    ranked = whole[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    found = np.empty(len(whole), bool)
    found[order] = same | np.concatenate([same[1:], [False]])
    return np.split(found, np.cumsum(n)[:-1])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, runs) -> (core, key, start, phrase, sure). A run of a crowded core becomes a row for
    each string: core and phrase are the halves of its hash; of equal ones in a batch, which are sure,
    all but one have a random core."""
    names, types = ["core", "key", "start", "phrase", "sure"], (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    whole, strings = [], []

    def settle() -> Iterator[pa.RecordBatch]:
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*whole), types)], names)
        if strings:
            key, start = (np.array([r[i] for r in strings], np.int64) for i in (0, 1))
            digests = b"".join(r[2] for r in strings)
            major, minor = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            core, sure = _first_of_each(key, start, major, minor)
            yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(key), pa.array(start), pa.array([digests[i + 8 : i + 16] for i in range(0, len(digests), 16)], pa.binary()), pa.array(sure)], names)
        whole.clear()
        strings.clear()

    for b in batches:
        for part in slices(b, SLICE):
            for key, text, runs in zip(*(c.to_pylist() for c in part.columns)):
                for r in runs:
                    at, n = r["start"], r["n"]
                    if r["crowded"]:
                        strings += [(key, i, xxhash.xxh3_128_digest(text[i : i + LENGTH])) for i in range(at, at + n)]
                    else:
                        whole.append((r["core"], key, at, text[at : at + n + LENGTH - 1], False))
            if len(whole) * LENGTH > GROUP_BYTES or len(strings) > PENDING // 4:
                yield from settle()
    yield from settle()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _fetch gives, sorted by (core, phrase) -> (key, start, n) of the strings that occur again."""
    held: list[tuple] = []
    size, before = 0, None

    def settle(rows):
        out = [[], [], []]
        for (_, key, start, _), flags in zip(rows, equal_strings([r[3] for r in rows])):
            a, n = _runs(flags)
            out[0].append(np.full(len(a), key, np.int64))
            out[1].append(a + start)
            out[2].append(n)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["key", "start", "n"])

    for b in batches:
        hashed = pc.less(pc.binary_length(b.column(3)), LENGTH)
        part = b.filter(hashed)
        if part.num_rows:
            new = [part.column(i).to_numpy() for i in range(3)] + [np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64), part.column(4).to_numpy(zero_copy_only=False), np.zeros(part.num_rows, bool)]
            core, key, start, minor, sure, told = new if before is None else [np.concatenate(x) for x in zip(before, new)]
            same = np.concatenate([[False], (core[1:] == core[:-1]) & (minor[1:] == minor[:-1])])
            again = sure | same | np.concatenate([same[1:], [False]])
            rows = again & ~told
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(start[rows]), pa.array(np.ones(rows.sum(), np.int64))], ["key", "start", "n"])
            before = [x[-1:] for x in (core, key, start, minor, sure, told | again)]
        for row in zip(*(c.to_pylist() for c in b.filter(pc.invert(hashed)).columns[:4])):
            if size >= GROUP_BYTES and row[0] != held[-1][0]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield settle(held)


def repeated_strings(docs: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """(key, runs): for each key with any, the (start, n) runs of 200-byte strings that occur again."""
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).cast("binary").alias("t"))
    parsed = texts.mapInArrow(_phrases, "key long, start long, n long, core long, phrase long, sure boolean")
    ordered = parsed.repartition("core").sortWithinPartitions("core", "phrase", "key", "start")
    marks = materialize(ordered.mapInArrow(_dictionary, "key long, start long, n long, core long, again boolean, differs boolean"), "dictionary")
    differs = marks.where("differs").select("key", "start", "n", "core")
    crowded = differs.groupBy("core").count().where(F.col("count") > CROWDED).select("core", F.lit(True).alias("crowded"))
    asked = differs.join(materialize(crowded, "crowded"), "core", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    asked = asked.groupBy("key").agg(F.collect_set(F.struct("start", "n", "core", "crowded")).alias("runs"))
    phrases = texts.join(asked, "key").select("key", "t", "runs").mapInArrow(_fetch, "core long, key long, start long, phrase binary, sure boolean")
    compared = phrases.repartition("core").sortWithinPartitions("core", "phrase").mapInArrow(_compare, "key long, start long, n long")
    compared = materialize(compared, "compared")
    every = marks.where("again").select("key", "start", "n").unionByName(compared)
    return every.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def cut(text: bytes, runs: list) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that no run's strings cover, and the (start, length) spans of the others."""
    if not runs:
        return text, []
    change = np.zeros(len(text) + 1, np.int32)
    start, n = np.array([(r["start"], r["n"]) for r in runs], np.int64).T
    np.add.at(change, start, 1)
    np.add.at(change, start + n + LENGTH - 1, -1)
    covered = np.cumsum(change[:-1]) > 0
    a, size = _runs(covered)
    return np.frombuffer(text, np.uint8)[~covered].tobytes(), list(zip(a.tolist(), size.tolist()))


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, row): the rows of `docs`, stored once with a number each; whatever their columns are
    called, they meet no column of ours."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "numbered")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) per row of `docs`: spans are the maximal (start, length) byte runs
    covered by 200-byte strings that also start elsewhere in `docs`; kept is what remains.

    Null texts are empty; texts under 200 bytes have no spans. Repeated rows are repeats of each
    other. Strings are judged on the input. Other columns are ignored; an empty table gives an empty
    table.
    """
    keyed = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")))
    runs = repeated_strings(keyed.select("key", "row.t"), "t", "key")
    rows = keyed.join(runs, "key", "left").select("row.id", F.col("row.t").cast("binary").alias("t"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, SLICE):
                texts = [t or b"" for t in part.column(1).to_pylist()]
                done = [cut(t, r) for t, r in zip(texts, part.column(2).to_pylist())]
                spans = pa.array([[{"start": s, "length": n} for s, n in d[1]] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), spans, pa.array([d[0] for d in done], pa.binary())], ["id", "n_bytes", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all columns, with the repeated spans cut from the text. Bytes of a character cut in
    two go with it. Null texts stay null; other rows are as in find_repeats."""
    names = docs.columns
    keyed = _keyed(docs)
    text = F.col("row").getField(text_col)
    runs = repeated_strings(keyed.select("key", text.alias("t")), "t", "key")
    rows = keyed.join(runs, "key", "left").select("row", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            for part in slices(b, SLICE):
                columns = part.column(0).flatten()
                texts = columns[at].cast(pa.binary()).to_pylist()
                kept = [t if t is None else cut(t, r)[0].decode("utf-8", "ignore") for t, r in zip(texts, part.column(1).to_pylist())]
                columns[at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
