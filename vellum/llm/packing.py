"""Best-fit packing of token sequences by length-histogram planning.

Documents are tokenized, ended by token 0, and cut into pieces only where longer than a sequence.
The plan is made from the histogram of piece lengths alone, which has at most `capacity` entries
whatever the corpus: best-fit decreasing over counts, where all pieces of a length that meet the same
room are placed at once. Pieces then take the planned slots by joining on their rank within their
length. A plan row holds all copies of a length that a group of sequences has. Each length opens or
splits three groups at most, and a group has at most sqrt(2 * capacity) different lengths, so the plan
has 3 * capacity * sqrt(2 * capacity) rows at most whatever the corpus (393,216 at 2048 tokens; some
thousands on real histograms), and may be broadcast.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}


def encoder(vocabulary: str = VOCABULARY):
    """The public vocabulary as an encoder. The .tiktoken file holds the ranks of the .json of the
    same name; its encoder gives the same ids several times faster (tests compare the two)."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def cut(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens and, last, n: whole sequences but for the first piece."""
    first = n % capacity or capacity
    return [0, *range(first, n + 1, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's tokens and end. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            rows, out = [], [[], [], [], []]
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all"), END).astype("<u4")
                at = cut(len(ids), capacity)
                for no, (s, e) in enumerate(zip(at[:-1], at[1:])):
                    rows.append(i)
                    for column, x in zip(out, (no, s, e - s, crc32(ids[s:e].tobytes()))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *[pa.array(x, pa.int64()) for x in out[1:]]], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank from, rank to, first sequence, offset, each).

    Pieces of `length` with a rank r in [from, to) go to sequence first + (r - from) // each, at
    offset + (r - from) % each * length.
    """
    rooms: list[int] = []  # sorted; rooms that some open sequences have
    bins: dict[int, list[tuple[tuple, int]]] = {}  # room -> ((length, copies) so far, sequences)
    full: list[tuple[tuple, int]] = []

    def store(held: tuple, room: int, n: int) -> None:
        if not room:
            full.append((held, n))
        elif room in bins:
            bins[room].append((held, n))
        else:
            bins[room] = [(held, n)]
            insort(rooms, room)

    def take(room: int) -> tuple[tuple, int]:
        got = bins[room].pop()
        if not bins[room]:
            del bins[room]
            rooms.pop(bisect_left(rooms, room))
        return got

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            held, n = take(room) if at < len(rooms) else ((), left)
            each = min(room // length, left)  # the tightest sequence stays the tightest until no more fit
            filled = min(n, left // each)
            store((*held, (length, each)), room - length * each, filled)
            if held and n > filled:
                store(held, room, n - filled)
            left -= filled * each
    rows, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for held, n in [*full, *(x for room in rooms for x in bins[room])]:
        offset = 0
        for length, each in held:
            rows.append((length, rank[length], rank[length] + n * each, sequence, offset, each))
            rank[length] += n * each
            offset += length * each
        sequence += n
    return rows


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with a `length` -> also sequence_id and offset. Ranks within a length are counted in
    slices of the input, so a length that most pieces have is ranked by many tasks."""
    spark = pieces.sparkSession
    sliced = materialize(pieces.withColumn("_slice", F.spark_partition_id()), "pieces")
    counts = materialize(sliced.groupBy("length", "_slice").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = plan(histogram, capacity) or [(0, 0, 0, 0, 0, 1)]
    slots = spark.createDataFrame(rows, "length long, lo long, hi long, sequence long, offset long, each long")
    earlier = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("ids_crc32", "id", "piece")) - 1
    # A row for each length and slice grows with the input: never broadcast. Both sides are placed alike already.
    ranked = sliced.withColumn("_rank", rank).join(before.hint("merge"), ["length", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    slot = F.broadcast(slots.withColumnRenamed("length", "_l"))
    met = ranked.join(slot, (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    nth = F.col("_rank") - F.col("lo")
    return met.select(*pieces.columns, (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("offset") + nth % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece of `docs`.

    A null or empty text is its end token alone. Rows that repeat an id are packed each. Other
    columns are ignored; an empty table gives an empty table.
    """
    return place(pieces(docs, capacity, vocabulary, id_col, text_col), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
