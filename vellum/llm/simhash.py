"""SimHash near-duplicate grouping with BK-trees.

64-bit SimHash fingerprints of word shingles; two texts are linked when their fingerprints differ in
at most `radius` bits. Equal fingerprints collapse first, so copies cost one tree entry. Fingerprints
are cut into `blocks` bit blocks: two that differ in at most `radius` bits agree on some choice of
`blocks - radius` whole blocks, so each fingerprint goes to one shard per choice, keyed by its bits
there. A shard's BK-tree has children keyed by the integer Hamming distance to their parent, and a
search follows only the edges within `radius` of its own distance. A key with more than
SHARD_ROWS fingerprints is dealt to several shard trees: each fingerprint meets its own, and then
those outside the key's largest component so far visit the others. A shard emits only links that
join two components, so output, and the work on a connected group, is linear in its size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .components import connected_components
from .shards import group_links, whole_groups

SEED = 42
SHARD_ROWS = 2048
BROADCAST_IDS = 200_000
CHUNK = 1 << 16  # shingles whose bits are counted at once


def shingle_hashes(text: bytes | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the `words`-word shingles of an A-Z lower-cased text, repeats included, in chunks.

    Fewer words make one shingle; no word (null, empty, blank) makes none.
    """
    w = text.lower().split() if text else []  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
    if not w:
        return
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(size) - 1
    starts = ends + 1 - size
    n = max(1, len(w) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])], np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    """Of each of the 64 bits, the number of hashes that have it set."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as unsigned 64 bits; 0 if there are none."""
    ones = sum((_ones(hashes[at : at + CHUNK]) for at in range(0, len(hashes), CHUNK)), np.zeros(64, np.int64))
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprint(text: bytes | None, words: int) -> int:
    """SimHash of the shingles of a text, as unsigned 64 bits; 0 if it has no word."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, words):
        n += len(h)
        ones += _ones(h)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One (id, fp) row per document, fp a signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, words) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


class BKTree:
    """Nodes are [fingerprint, component, {distance: child}]."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def search(self, fp: int) -> list[list]:
        found, r = [], self.radius
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = (node[0] ^ fp).bit_count()
            if d <= r:
                found.append(node)
            todo.extend(child for edge, child in node[2].items() if d - r <= edge <= d + r)
        return found

    def insert(self, fp: int, component: int) -> None:
        node, new = self.root, [fp, component, {}]
        if node is None:
            self.root = new
            return
        while True:
            d = (node[0] ^ fp).bit_count()
            if d not in node[2]:
                node[2][d] = new
                return
            node = node[2][d]


def shard_links(home: list[int], visitors: list[int], roots: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that span the components among `home`, and tie each visitor to those it is near. `roots`
    names the component that each of home + visitors is known to be in; those need no link."""
    tree, out = BKTree(radius), []
    names: dict[int, int] = {}
    parent = [names.setdefault(r, i) for i, r in enumerate(roots)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, fp in enumerate(home + visitors):
        for node in tree.search(fp):
            a, b = find(i), find(node[1])
            if a != b:
                parent[a] = b
                out.append((fp, node[0]))
        if i < len(home):
            tree.insert(fp, i)
    return out


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks, as signed longs, of every choice of blocks - radius blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    masks = [sum(c) for c in itertools.combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def default_blocks(n: int, radius: int) -> int:
    """Fewest blocks whose chosen bits outnumber n, so that chance company in a shard stays small."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if (1 << (64 * (blocks - radius) // blocks)) >= 4 * n:
            return blocks
    return 2 * radius + 1


def links(fps: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b) links whose components are those of all pairs in reach."""
    blocks = blocks or default_blocks(fps.count(), radius)
    routed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(radius, blocks)])).alias("c", "v"))
    members = routed.select(F.xxhash64("c", "v").alias("key"), F.col("fp").alias("node"))  # keys that collide share trees, which lose nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, CHUNK):
            home, node, root = (t.column(i).to_numpy() for i in (2, 3, 4))
            out: list[tuple[int, int]] = []
            for start, end in zip(bounds[:-1], bounds[1:]):
                if end - start > 1:
                    at, fp, own = home[start:end] == 1, node[start:end].view(np.uint64), root[start:end]
                    out += shard_links(fp[at].tolist(), fp[~at].tolist(), [*own[at].tolist(), *own[~at].tolist()], radius)
            pair = np.array(sorted(set(out)), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return group_links(members, F.ceil(F.count("*") / SHARD_ROWS), lambda rows: rows.select("key", "shard", "home", "node", "root"), run)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of `docs` as (id, fp, component): component is the smallest id it reaches over links.

    Null, empty and blank texts have fingerprint 0 and link like any other. Equal texts, repeated
    rows and ids share a fingerprint. A null id keeps its row; it names a component only if no
    member has an id. Other columns of `docs` are ignored. An empty table gives an empty table.
    """
    fps = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    each = fps.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected_components(links(each.select("fp"), radius, blocks))
    named = each.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "roots")
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    return fps.join(named.select("fp", "root").join(lows, "root").select("fp", "component"), "fp")


def drop_near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one document of each near-duplicate group: that of the smallest id.

    Rows that share an id are one document and leave one row. Rows without an id can't be told
    apart and all stay. Columns are those of `docs`.
    """
    return keep_lowest(docs, near_duplicates(docs, words, radius, None, id_col, text_col), id_col)


def keep_lowest(docs: DataFrame, grouped: DataFrame, id_col: str) -> DataFrame:
    """The rows of `docs` whose id names its component in `grouped` (id, component), one for each id, and those without id."""
    row = F.col("id") == F.col("component")
    ids = grouped.where("id is not null").groupBy(F.col("id").alias(id_col)).agg(F.max(row).alias("stays"), F.count("*").alias("rows"))
    ids = materialize(ids.where("not stays or rows > 1"), "ids-to-drop")  # those that stay as they are, most, needn't meet the texts
    n = ids.count()
    if n <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    kept = docs.join(ids, id_col, "left_anti")
    often = ids.where("stays")
    return kept if not n or often.isEmpty() else kept.unionByName(docs.join(often, id_col, "left_semi").dropDuplicates([id_col]))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
