"""Near-duplicate texts at a stated Jaccard similarity of word shingles, by SimHash and BK-trees.

SimHash makes the first candidates: fingerprints within RADIUS bits meet in the BK-trees of simhash.py,
and what they join is compared exactly. No bound on those bits holds for all pairs that are
`similarity` alike, so steps 2 and 3 look for the pairs that fingerprints leave apart, and only for those:
members that SimHash has joined are known to be in one group. A link is always an exact comparison of
two shingle sets, and no pair that could be alike goes unexamined.

1. Fingerprints. Those that differ in RADIUS bits or fewer make groups of candidates.
2. Keys. In one order of all shingles, two sets that are `similarity` alike share one of the first
   n - ceil(similarity * n) + 1 of each (n its size). The order puts shingles of crowded hash buckets
   last, so that common lines and passages rarely are keys.
3. Candidates. The sets that share a key meet in its shards with a sketch: the parity, for each of
   512 (of large sets 4096) hash buckets, of the shingles in it. The parities of two sets differ in no
   more places than the sets have different shingles, so a pair that differs in too many can't be
   alike; the others are candidates. A task passes on only links that span their components.
4. Links. The sets of a component of candidates, mostly a few, meet in one task. Each first looks for
   its nearest ones in a BK-tree of the SimHash fingerprints and is compared with those; then every
   set outside the largest component is compared with all others by an inverted list of their
   shingles, until each pair of different components has been. Only links that span are passed on.

Both kinds of group are dealt to several shards where they are large. First a member meets its own
shard; then the members outside the group's largest component visit all the others. Output stays linear
in the members, and the work of a group of copies is linear in it too; what is compared pair by pair
are sets that pass the sketch and still are not alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, release
from .components import connected_components, star
from .shards import group_links, whole_groups

BUCKET_BITS = 20  # shingles are counted in 2**20 hash buckets: one byte of each reaches every task
RADIUS = 4  # bits in which the fingerprints of candidates may differ
CROWD, LEAST = 4, 64  # a bucket is crowded at CROWD times the mean count, LEAST at least
PENDING = 1 << 21  # shingles held before they are counted
PARITY, WIDE = 512, 4096  # places of a sketch, and of that of a set of more than PARITY shingles
KEY_ROWS = 8192  # members of a key's shard
SET_ROWS, SET_SHINGLES = 2048, 1 << 22  # members of a candidate group's shard, and their shingles
CHUNK_ROWS = 1 << 16  # rows of whole groups looked at together
FEW = 16  # members of a group whose pairs are all looked at, many groups at once
PIVOTS = 64  # members compared with all others at once
NEAR_BITS, NEAREST = 14, 4  # SimHash radius in which a BK-tree is searched, and sets compared there


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *simhash.shingle_hashes(text, words)]))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed longs, that stand for a set."""
    d = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def parity(shingles: np.ndarray) -> bytes:
    """Of each of PARITY or WIDE hash buckets, whether it holds an odd number of the shingles."""
    wide = WIDE if len(shingles) > PARITY else PARITY
    odd = np.bincount((shingles & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes) -> np.ndarray:
    """A sketch as PARITY places: those of a wide one that agree modulo PARITY together."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, PARITY // 64), axis=0)


def most_different(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles in which two alike sets of together so many may differ."""
    return sizes * ((1 - similarity) / (1 + similarity)) + 1e-6


def crowding(texts: DataFrame, words: int) -> np.ndarray:
    """A byte for each hash bucket: 0, or more the more crowded it is. Every shingle is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, size = np.zeros(1 << BUCKET_BITS, np.int64), [], 0

        def flush() -> None:
            if held:
                np.add(count, np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS), out=count)
                held.clear()

        for b in batches:
            for text in b.column(1).to_pylist():
                for h in simhash.shingle_hashes(text, words):
                    held.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
                    size += len(h)
                if size > PENDING:
                    flush()
                    size = 0
        flush()
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], ["bucket", "n"])

    summed = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = materialize(summed, "buckets")  # 2**BUCKET_BITS rows at most
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << BUCKET_BITS)
    bar = max(LEAST, CROWD * mean)
    crowded = counts.where(F.col("n") > bar).toArrow()  # 2**BUCKET_BITS / CROWD rows at most
    release(counts)
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    out[crowded["bucket"].to_numpy()] = 1 + np.log2(crowded["n"].to_numpy() / bar).astype(np.uint8)
    return out


def first_shingles(shingles: np.ndarray, crowd: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles, first in the common order, of which two alike sets share one."""
    n = len(shingles)
    level = crowd[(shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    ordered = shingles[np.lexsort((shingles, level))] if level.any() else shingles
    return ordered[: n - math.ceil(similarity * n - 1e-9) + 1] if n else ordered


def sketches(texts: DataFrame, words: int, similarity: float, crowd: np.ndarray) -> DataFrame:
    """(id, t) rows as (id, digest d1 and d2, size, SimHash, sketch, keys) of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, prints, bits, keys = [], [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), words)
                names.append(digest(s))
                sizes.append(len(s))
                prints.append(simhash.majority(s))
                bits.append(parity(s))
                keys.append(first_shingles(s, crowd, similarity).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            d1, d2 = np.array(names, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d1), pa.array(d2), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), lists], ["id", "d1", "d2", "size", "fp", "bits", "keys"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, d1 long, d2 long, size long, fp long, bits binary, keys array<long>")


def spanning(label: np.ndarray, homes: int, compare: Callable[[np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (member, home) that join the components of `label` wherever compare() finds a pair.

    Members 0 to homes - 1 are at home, the others visit. compare(members) gives a row of booleans over
    the homes for each. Every visitor, and every home outside the homes' largest component, is compared,
    so all pairs of different components of which one is at home are looked at.
    """
    label, out = label.copy(), []
    done = np.zeros(len(label), bool)
    some = 1
    while homes:
        kinds, count = np.unique(label[:homes], return_counts=True)
        todo = ~done & (label != kinds[count.argmax()])
        if len(kinds) > 1:
            todo[homes:] = ~done[homes:]
        todo = np.flatnonzero(todo)[:some]
        if not len(todo):
            break
        some = min(PIVOTS, 2 * some)
        done[todo] = True
        for i, row in zip(todo, compare(todo)):
            near = np.flatnonzero(row & (label[:homes] != label[i]))
            if len(near):
                near = near[np.unique(label[near], return_index=True)[1]]
                out += [(int(i), int(j)) for j in near]
                label[np.isin(label, label[near])] = label[i]
    return out


def candidate_links(similarity: float):
    """(key, shard, home, node, root, size, bits), sorted by (key, shard, node) -> (a, b) links that span
    the components of the pairs of a shard that may be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64))  # a row for each node linked so far

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, held)], ["a", "b"])

        for t, bounds in whole_groups(batches, CHUNK_ROWS):
            home, node, root, size = (t.column(i).to_numpy() for i in range(2, 6))
            raw = t.column(6).to_pylist()
            bits = np.stack([folded(x) for x in raw])
            at_wide = np.cumsum([len(x) > PARITY // 8 for x in raw]) - 1
            is_wide = np.array([len(x) > PARITY // 8 for x in raw])
            wide = np.array([np.frombuffer(x, np.uint64) for x in raw if len(x) > PARITY // 8], np.uint64).reshape(-1, WIDE // 64)

            def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                """Whether the rows i and j, which broadcast, may be alike."""
                a, b = size[i], size[j]
                allowed = most_different(a + b, similarity)
                good = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6
                good &= np.bitwise_count(bits[i] ^ bits[j]).sum(axis=-1, dtype=np.int32) <= allowed
                both = np.nonzero(good & is_wide[i] & is_wide[j])
                for at in range(0, len(both[0]), CHUNK_ROWS):
                    far = tuple(z[at : at + CHUNK_ROWS] for z in both)
                    x, y = (np.broadcast_to(z, good.shape)[far] for z in (i, j))
                    good[far] = np.bitwise_count(wide[at_wide[x]] ^ wide[at_wide[y]]).sum(axis=-1, dtype=np.int32) <= allowed[far]
                return good

            known = root != node
            found, first, count = [held, (node[known], root[known])], bounds[:-1], np.diff(bounds)
            for m in range(2, FEW + 1):
                starts = first[count == m]
                i, j = np.triu_indices(m, 1)
                step = max(1, (CHUNK_ROWS * FEW) // len(i))
                for at in range(0, len(starts), step):
                    x, y = ((starts[at : at + step, None] + z).ravel() for z in (i, j))
                    meet = (root[x] != root[y]) & ((home[x] == 1) | (home[y] == 1))
                    x, y = x[meet], y[meet]
                    order = np.lexsort((node[y], node[x]))  # a pair shares many keys: it is looked at once
                    x, y = x[order], y[order]
                    new = np.concatenate([np.ones(min(1, len(x)), bool), (node[x][1:] != node[x][:-1]) | (node[y][1:] != node[y][:-1])])
                    x, y = x[new], y[new]
                    good = fits(x, y)
                    found.append((node[x[good]], node[y[good]]))
            held = star(*(np.concatenate(z) for z in zip(*found)))
            for start, m in zip(first[count > FEW].tolist(), count[count > FEW].tolist()):
                place = start + np.argsort(home[start : start + m] != 1, kind="stable")
                name, homes = node[place], int((home[place] == 1).sum())
                at = np.minimum(np.searchsorted(held[0], name), max(0, len(held[0]) - 1))
                label = np.where(held[0][at] == name, held[1][at], name) if len(held[0]) else name
                links = spanning(label, homes, lambda some: fits(place[some][:, None], place[:homes][None, :]))
                if links:
                    a, b = np.array(links).T
                    held = star(np.concatenate([held[0], name[a]]), np.concatenate([held[1], name[b]]))
            if len(held[0]) > PENDING:
                yield out()
                held = (np.empty(0, np.int64), np.empty(0, np.int64))
        yield out()

    return run


def set_links(sets: list[np.ndarray], homes: int, label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of places in `sets` that join the components of `label` where two sets are alike, one of
    them among the first `homes`."""
    size = np.array([len(s) for s in sets])
    label, out = label.copy(), []

    def alike(i: int, j: int) -> bool:
        if min(size[i], size[j]) < similarity * max(size[i], size[j]) - 1e-9:
            return False
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both >= similarity * (size[i] + size[j] - both) - 1e-9

    tree = simhash.BKTree(NEAR_BITS)
    for i, s in enumerate(sets):
        fp = simhash.majority(s)
        near = sorted(((other ^ fp).bit_count(), j) for other, j, _ in tree.search(fp) if label[j] != label[i])
        for j in [j for _, j in near[:NEAREST]]:
            if label[j] != label[i] and alike(i, j):
                out.append((i, j))
                label[label == label[i]] = label[j]
        if i < homes:
            tree.insert(fp, i)
    if len(sets) == 2:
        return out or ([(1, 0)] if label[0] != label[1] and alike(1, 0) else [])
    if not homes or (label == label[0]).all():
        return out
    of = np.repeat(np.arange(homes), size[:homes])
    flat = np.concatenate(sets[:homes])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]

    def compare(some: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(some), homes), bool)
        for r, i in enumerate(some):
            lo, hi = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], "right")
            n = hi - lo
            met = of[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            both = np.bincount(met, minlength=homes)
            rows[r] = both >= similarity * (size[:homes] + size[i] - both) - 1e-9
        return rows

    return out + spanning(label, homes, compare)


def exact_links(similarity: float):
    """(key, shard, home, node, root, s), sorted by (key, shard, node) -> (a, b) links that span the
    components of the alike sets of a shard. Rows that repeat a node count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, 1):
            home, node, root = (t.column(i).to_numpy() for i in (2, 3, 4))
            column = t.column(5).combine_chunks()
            found: list[tuple[int, int]] = []
            for start, end in zip(bounds[:-1], bounds[1:]):
                once = start + np.flatnonzero(np.concatenate([[True], node[start + 1 : end] != node[start : end - 1]]))
                if len(once) < 2:
                    continue
                place = once[np.argsort(home[once] != 1, kind="stable")]
                sets = [np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in place]
                links = set_links(sets, int((home[place] == 1).sum()), root[place], similarity)
                found += [(int(node[place[i]]), int(node[place[j]])) for i, j in links]
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], ["a", "b"])

    return run


def shingle_sets(asked: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(id, d1, d2, node) -> (node, s): the set of each node, from a text of its id and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2 = (b.column(i).to_pylist() for i in (1, 2))
            for i, text in enumerate(b.column(3)):  # a row at a time: sets of long texts are large
                s = shingle_set(text.as_py(), words)
                if digest(s) == (d1[i], d2[i]):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([s.tobytes()], pa.binary())], ["node", "s"])

    if asked.limit(simhash.BROADCAST_IDS + 1).count() <= simhash.BROADCAST_IDS:
        asked = F.broadcast(asked)
    return texts.join(asked, "id").select("node", "d1", "d2", "t").mapInArrow(run, "node long, s binary")


def fingerprint_groups(named: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, fp) -> (node, root): the nodes that links of fingerprints within `radius` bits join to others,
    each with the smallest node it reaches."""
    roots = connected_components(simhash.links(named.select("fp").distinct(), radius))
    joined = named.select("node", "fp").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = materialize(joined.select("node", "root"), "fingerprint-roots")
    lows = joined.groupBy("root").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    return materialize(joined.join(lows, "root").select("node", F.col("low").alias("root")), "fingerprint-groups")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of `docs` that has an id as (id, node, component): the smallest id it reaches over links.

    Two texts are linked if the Jaccard similarity of their shingle sets is `similarity` or more, all
    of them and no others. Texts without words (null, empty, blank) are equal to one another. Equal
    sets, repeated rows and ids share a node. Rows without an id take no part; other columns are
    ignored. An empty table gives an empty table. Shingles are told apart by 64-bit hashes, sets by
    128-bit ones; ids that aren't integers name their nodes by a 64-bit hash.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    sketched = materialize(sketches(texts, words, similarity, crowding(texts, words)), "sketches")
    node = F.col("id").cast("long") if texts.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(F.col("id").cast("string"))
    # Several texts of one id would share its name: the digest then tells the nodes apart.
    classes = sketched.groupBy("d1", "d2").agg(F.min("id").alias("id"), *[F.first(x).alias(x) for x in ("size", "fp", "bits", "keys")])
    classes = materialize(classes, "classes")
    twice = materialize(classes.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("twice")), "named-twice")
    named = classes.withColumn("node", node) if twice.isEmpty() else classes.join(twice, "id", "left").withColumn("node", F.when(F.col("twice"), F.xxhash64("d1", "d2")).otherwise(node)).drop("twice")

    known = fingerprint_groups(named)
    posts = named.select(F.explode("keys").alias("key"), "node")
    sketch = named.select("node", "size", "bits")
    shards = F.ceil(F.count("*") / KEY_ROWS)
    candidates = group_links(posts, shards, lambda rows: rows.join(sketch, "node").select("key", "shard", "home", "node", "root", "size", "bits"), candidate_links(similarity), known)
    groups = connected_components(candidates).withColumnRenamed("root", "key")
    members = materialize(groups.join(named.select("node", "id", "d1", "d2", "size"), "node"), "candidates")
    sets = materialize(shingle_sets(members.select("id", "d1", "d2", "node"), texts, words), "shingle-sets")
    shards = F.ceil(F.greatest(F.count("*") / SET_ROWS, F.sum("size") / SET_SHINGLES))
    links = group_links(members.select("key", "node", "size"), shards, lambda rows: rows.join(sets, "node").select("key", "shard", "home", "node", "root", "s"), exact_links(similarity))
    release(sets)

    roots = connected_components(links)
    linked = named.select("d1", "d2", "id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = linked.groupBy("root").agg(F.min("id").alias("component"))
    final = materialize(linked.join(lows, "root").select("d1", "d2", "node", "component"), "roots")
    return sketched.select("id", "d1", "d2").join(final, ["d1", "d2"]).select("id", "node", "component")


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one document of each group of similar ones: that of the smallest id.

    Rows that share an id are one document and leave one row. Rows without an id can't be told
    apart and all stay. Columns are those of `docs`.
    """
    return simhash.keep_lowest(docs, similar_documents(docs, words, similarity, id_col, text_col), id_col)
