"""Operators against brute force on small fixtures, with nulls, empty tables, ties and repeats."""

import bisect
import hashlib
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import ann, langid, lm, mixing, packing, quality, repeats, sharding, similar, simhash, topk
from vellum.llm.hilbert import hilbert_key
from vellum.llm.vectors import Best

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, component string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 6))) for _ in range(200)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [make(r.randint(1, 120)) for _ in range(60)]
    passage = make(80)
    texts += [make(40) + " " + passage + " " + make(40) for _ in range(4)]
    texts += [texts[0]] * 5 + ["", None, "   ", "a" * 900, "ab" * 450, "é" * 300, make(4000)]
    texts += [texts[60].replace("a", "A", 3)]
    out = [(i, t, r.choice(["x", "y", None]), r.choice(["s", "s", "s", "t", None]), None, 1, 2, "c") for i, t in enumerate(texts)]
    return out + [out[0], out[0], (None, "no id here at all", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_simhash(spark, docs, rows):
    def brute(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [brute(r[1]) for r in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    want = Counter((r[0], fps[i], low.get(find(i))) for i, r in enumerate(rows))
    got = Counter((r["id"], r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.drop_near_duplicates(docs, 4, 4)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*set(low.values()), None])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def copies(seed, groups, size, n_words=90):
    """Texts of which each group shares a base, with none to many words changed."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(n_words)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(n_words)] = r.choice(vocabulary)
            out.append(" ".join(w))
    return out


def similar_groups(ids, texts, words, similarity):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(ids)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return Counter((x, low[find(i)]) for i, x in enumerate(ids))


def test_similar_documents(spark, docs, rows):
    there = [r for r in rows if r[0] is not None]
    got = Counter((r["id"], r["component"]) for r in similar.similar_documents(docs).collect())
    assert got == similar_groups([r[0] for r in there], [r[1] for r in there], 5, 0.8)
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*{c for _, c in got}, None])
    assert similar.similar_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("key_rows, set_rows, few, crowd", [(8192, 2048, 16, 64), (8, 8, 2, 4)])
def test_similar_pairs_and_groups(spark, monkeypatch, key_rows, set_rows, few, crowd):
    for name, value in (("KEY_ROWS", key_rows), ("SET_ROWS", set_rows), ("FEW", few), ("LEAST", crowd)):
        monkeypatch.setattr(similar, name, value)
    texts = copies(5, 60, 2) + copies(6, 2, 40) + ["the same line of licence text " * 3 + t for t in copies(7, 40, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r["id"], r["component"]) for r in similar.similar_documents(df).collect())
    assert got == similar_groups(range(len(texts)), texts, 5, 0.8)


def test_simhash_makes_candidates(spark, monkeypatch):
    """Without any key, what fingerprints join is still found; fingerprints alone link nothing."""
    monkeypatch.setattr(similar, "first_shingles", lambda shingles, crowd, similarity: shingles[:0])
    r = random.Random(12)
    texts = []
    for k in range(12):
        w = [f"w{k}x{r.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(w), " ".join(w[:200] + ["other"] + w[201:]), " ".join(w)]
    texts.append(" ".join(texts[0].split()[:100]))  # shares words, but isn't alike
    fps = [simhash.majority(similar.shingle_set(t.encode(), 5)) for t in texts]
    near = [k for k in range(12) if (fps[3 * k] ^ fps[3 * k + 1]).bit_count() <= similar.RADIUS]
    assert len(near) > 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in similar.similar_documents(df).collect()}
    assert got == {i: 3 * (i // 3) if i < 36 and (i % 3 != 1 or i // 3 in near) else i for i in range(len(texts))}
    monkeypatch.setattr(similar, "RADIUS", 64)
    monkeypatch.setattr(similar, "fingerprint_groups", lambda named: named.select("node", F.lit(0).cast("long").alias("root")))
    got = {r["id"]: r["component"] for r in similar.similar_documents(df).collect()}
    assert got == {i: 3 * (i // 3) if i < 36 else i for i in range(len(texts))}


def around(seed, size, changes, n_words=120):
    """Texts that each change `changes` words of one base: their similarity depends on the number."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(n_words)]
    out = []
    for k in range(size):
        w = list(base)
        for i in r.sample(range(n_words), r.choice(changes)):
            w[i] = f"c{k}x{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("key_rows, set_rows", [(8192, 2048), (100, 100)])
def test_large_group_around_the_similarity(spark, monkeypatch, key_rows, set_rows):
    """600 texts about 0.8 alike to one another, some just under and some just over: no link lost or added."""
    monkeypatch.setattr(similar, "KEY_ROWS", key_rows)
    monkeypatch.setattr(similar, "SET_ROWS", set_rows)
    texts = around(1, 500, [1, 2, 3]) + around(2, 100, [4]) + copies(3, 200, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r["id"], r["component"]) for r in similar.similar_documents(df).collect())
    assert got == similar_groups(range(len(texts)), texts, 5, 0.8)


def test_similar_short_texts(spark):
    r = random.Random(9)
    texts = []
    for _ in range(400):
        w = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(9)]
        texts += [" ".join(w[:8]), " ".join(w)]  # 4 and 5 shingles, 0.8 alike
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = sum(x["id"] != x["component"] for x in similar.similar_documents(df).collect())
    assert linked == 400


def test_sketches_never_exceed_the_difference():
    r = np.random.default_rng(2)
    for n in (1, 40, 511, 512, 513, 6000):
        pool = r.integers(0, 1 << 63, n + 500, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[r.integers(0, 500) :][:n])
        far = len(np.setxor1d(a, b))
        x, y = similar.parity(a), similar.parity(b)
        assert np.bitwise_count(similar.folded(x) ^ similar.folded(y)).sum() <= far
        if len(x) == len(y):
            assert np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum() <= far


@pytest.mark.parametrize("bound", [1_000_000, 10])
def test_components(spark, monkeypatch, bound):
    from vellum.llm import components

    monkeypatch.setattr(components, "IN_ONE_TASK", bound)
    links = [(i, i + 7) for i in range(0, 400, 2)] + [(1000 + i, 1000) for i in range(50)] + [(5, 5), (2000, 2001), (2000, 2001), (-5, 2001)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bk_tree_shards():
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = list({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(15)})
    tree = simhash.BKTree(4)
    for f in fps:
        tree.insert(f, 0)
    for f in fps[:50]:
        assert sorted(n[0] for n in tree.search(f)) == sorted(x for x in fps if (x ^ f).bit_count() <= 4)
    masks = simhash.block_masks(4, 6)
    for _ in range(200):
        a, b = r.getrandbits(64), 0
        b = a
        for _ in range(4):
            b ^= 1 << r.randrange(64)
        assert any((a & (m % (1 << 64))) == (b & (m % (1 << 64))) for m in masks)


def test_hot_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 16)
    fps = [(1 << i) | (1 << j) for i in range(20) for j in range(i)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    from vellum.llm.components import connected_components

    roots = {r["root"] for r in connected_components(simhash.links(df, 4, 6)).collect()}
    assert roots == {min(fps)}


@pytest.mark.parametrize("crowded", [repeats.CROWDED, 1])
def test_repeats(spark, docs, rows, crowded, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = Counter()
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[r[0], len(t), hashlib.sha256(kept).hexdigest(), int(gone.sum())] += 1
    found = repeats.find_repeats(docs).collect()
    assert Counter((r["id"], r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest(), sum(s["length"] for s in r["spans"])) for r in found) == want
    assert repeats.remove_repeats(docs).columns == docs.columns
    assert repeats.find_repeats(docs.limit(0)).count() == 0


def test_packing(spark, docs, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, 256).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        at = packing.cut(len(ids), 256)
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            want[r[0], k, a, b - a, crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 256 and len(used) <= sum(used.values()) / 256 * 1.1 + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_plan_places_every_piece():
    for h in ({1: 5, 700: 9, 1400: 3, 2048: 2, 30: 50}, {1: 20_000, 3: 77, 5: 13}, {n: 1 + n % 7 for n in range(1, 400)}):
        ranks, used = Counter(), {}
        for length, lo, hi, first, offset, each in packing.plan(h, 2048):
            for k in range(lo, hi):
                ranks[length, k] += 1
                used.setdefault(first + (k - lo) // each, []).append((offset + (k - lo) % each * length, length))
        assert ranks == Counter({(x, k): 1 for x, n in h.items() for k in range(n)})
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(used) == best_fit(h, 2048)


def best_fit(histogram, capacity):
    """Sequences that best-fit decreasing opens, piece by piece."""
    rooms = []
    for length, n in sorted(histogram.items(), reverse=True):
        for _ in range(n):
            at = bisect.bisect_left(rooms, length)
            bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - length)
    return len(rooms)


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    assert all(r["source_size"] == sizes[r["source"]] for r in got)
    target = {r["source"]: r["target"] for r in got}
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= max(r["size"] for r in got if r["source"] == s)
    again = mixing.mix(docs.orderBy(F.desc("doc_id"))).collect()
    key = lambda r: (str(r["id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sharding(spark, docs, rows):
    got = sharding.shard(docs, 4000).collect()
    assert Counter((r["id"], r["bytes"]) for r in got) == Counter((r[0], len((r[1] or "").encode())) for r in rows)
    size, n = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["bytes"]
        n[r["shard"]] += 1
    assert all(size[s] <= 4000 or n[s] == 1 for s in size)
    assert sharding.shard(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "x" * 1000)] * 20, "doc_id long, text string")
    parts = Counter(r["shard"] for r in sharding.shard(same, 3000).collect())
    assert sum(parts.values()) == 20 and max(parts.values()) <= 3


def test_lm(spark, docs, rows):
    held = [r[0] is not None and crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    words = [(r[1] or "").encode().lower().split() for r in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda k: np.log10((k + 1) / (n + 1 * (v + 1)))
    want = Counter((r[0], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(sum(base(c[x]) for x in w) + base(ends), 4)) for r, w in zip(rows, words))
    got = lm.score(docs, lm.id_remainder(F.col("doc_id"), 7) != 2).collect()
    assert Counter((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_lm_base_is_a_unigram_distribution(spark):
    train = ["b a a", "c a", None]
    count = Counter(a=3, b=1, c=1)
    ends, n, v = 3, 8, 4
    df = spark.createDataFrame([*enumerate(train), (10, "a"), (11, "b"), (12, "c"), (13, "new")], "doc_id long, text string")
    got = {r["id"]: r["base_score"] for r in lm.score(df, F.col("doc_id") < 10).collect()}
    p = lambda k: (k + 1) / (n + v + 1)
    assert got[2] == pytest.approx(np.log10(p(ends)))
    own = {w: 10 ** (got[i] - got[2]) for i, w in ((10, "a"), (11, "b"), (12, "c"), (13, "new"))}
    assert own == pytest.approx({w: p(count[w]) for w in own})
    assert sum(own.values()) + 10 ** got[2] == pytest.approx(1)


def test_suffix_tree_is_a_distribution(spark, docs):
    counts = lm.count_corpus(docs, F.lit(True), "text").where("kind = 0").select("code", "n")
    got = lm.tree(counts, least=4, gain=0.5).select("depth", "context", "symbol", "logp").toArrow().columns
    tree = lm.SuffixTree(tuple(x.to_numpy() for x in got), None)
    assert max(len(c) for c in tree.contexts[1:]) > 0
    for start in (b"\n\n\n\n\n", b"abcde", b"ab ca", b"zzzzz"):
        context = int.from_bytes(start[::-1], "big")
        codes = np.array([context << 8 | s for s in range(256)])
        assert (10 ** tree.logp(codes)).sum() == pytest.approx(1, rel=1e-5)


def brute_suffix_tree(train, least, gain, depth):
    """Plain Python: {context bytes: ({symbol: probability}, weight of the parent)} of the kept contexts."""
    counts = Counter()
    for s in train:
        padded = lm.END * depth + s
        for i in range(len(s)):
            for d in range(depth + 1):
                counts[padded[depth + i - d : depth + i], s[i]] += 1
    by = {}
    for (context, symbol), n in counts.items():
        by.setdefault(context, {})[symbol] = n
    total, kinds = sum(by[b""].values()), len(by[b""])
    tree, told = {b"": ({s: (by[b""].get(s, 0) + kinds / 256) / (total + kinds) for s in range(256)}, 0.0)}, []
    for context, seen in sorted(by.items(), key=lambda x: len(x[0])):
        c, k = sum(seen.values()), len(seen)
        if not context or c < least:
            continue
        up = tree[context[1:]][0]
        own = {s: (n + k * up[s]) / (c + k) for s, n in seen.items()}
        tree[context] = (own, k / (c + k))
        if sum(n * np.log(own[s] / up[s]) for s, n in seen.items()) - gain * k > 0:
            told.append(context)
    return with_suffixes(tree, told)


def brute_logp(tree, context, symbol):
    while context not in tree:
        context = context[1:]
    own, rest = tree[context]
    return np.log10(own[symbol]) if symbol in own else np.log10(rest) + brute_logp(tree, context[1:], symbol)


def with_suffixes(tree, told):
    return {c: v for c, v in tree.items() if c == b"" or any(x.endswith(c) for x in told)}


@pytest.mark.parametrize("entries, batch", [(3_000_000, 1 << 21), (60, 50)])
def test_lm_scores_by_the_suffix_tree(spark, monkeypatch, entries, batch):
    """Against plain Python, whole and in several parts, texts whole and in pieces."""
    monkeypatch.setattr(lm, "SHARD_ENTRIES", entries)
    monkeypatch.setattr(lm, "BATCH_BYTES", batch)
    r = random.Random(4)
    pool = ["abcdx", "ebcdy", "fabcdx", "gebcdy", "the dog", "été", "zz"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 60)))) for i in range(40)] + [(40, None), (41, "a new thing"), (41, "a new thing")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tree = brute_suffix_tree([lm.stream((t or "").encode())[0] for i, t in rows if i < 30], lm.LEAST_COUNT, lm.GAIN, lm.DEPTH)
    assert max(map(len, tree)) >= 4
    want = []
    for i, t in rows:
        s = lm.stream((t or "").encode())[0]
        padded = lm.END * lm.DEPTH + s
        want.append((i, sum(brute_logp(tree, padded[k : k + lm.DEPTH], s[k]) for k in range(len(s)))))
    got = sorted((x["id"], x["score"]) for x in lm.score(df, F.col("doc_id") < 30).collect())
    assert [x[0] for x in got] == [x[0] for x in sorted(want)]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in sorted(want)], rel=1e-6)


def vectors(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 8))
    x[10:20] = x[0]
    out = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return x, spark.createDataFrame([*out, (400, None), (401, [None] * 8), (402, [float("inf")] * 8), (403, [1.0]), (404, []), (None, [1.0] * 8)], "vec_id long, embedding array<double>")


def test_top_k(spark):
    x, df = vectors(spark)
    whole = np.floor(x * 256).astype(int)
    want = set()
    for q in range(0, 400, 50):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        want |= {(q, k + 1, int(i), int(s[i])) for k, i in enumerate(order)}
    assert {tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0).collect()} == want
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert topk.top_k(df.limit(3), F.col("id") == 0).count() == 2


def test_neighbours_over_many_blocks(spark, monkeypatch):
    """Windows narrower than the table: 1500 rows in 94 blocks a curve, recall against brute force, rows looked at counted."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    r = np.random.default_rng(6)
    centres = r.normal(size=(30, 16)) * 3
    x = centres[r.integers(0, 30, 1500)] + r.normal(size=(1500, 16)) * 0.6
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    def recall(**options):
        found = {}
        for g in ann.neighbours(df, F.col("id") % 50 == 0, 10, **options).collect():
            found.setdefault(g["query_id"], set()).add(g["vec_id"])
        hit = 0
        for q in range(0, 1500, 50):
            order = [int(i) for i in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable") if i != q][:10]
            hit += len(found[q] & set(order))
        return hit / 300

    assert recall() >= 0.9
    got = {(g["query_id"], g["rank"]): g["score"] for g in ann.neighbours(df.withColumn("embedding", F.col("embedding").cast("array<float>")), F.col("id") == 0, 3).collect()}
    single = x.astype(np.float32).astype(np.float64)
    assert [got[0, 1], got[0, 2], got[0, 3]] == pytest.approx(sorted(np.sqrt(((single - single[0]) ** 2).sum(1)))[1:4], rel=1e-12)
    assert recall(curves=1, window=0.01) < 0.9  # so the test can fail


def test_neighbours(spark):
    x, df = vectors(spark)
    got = ann.neighbours(df, F.col("id") % 50 == 0, 10).collect()
    hit = 0
    for q in range(0, 400, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [a[0] for a in own] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in own)
        hit += len({i for _, i, _ in own} & {int(i) for i in np.lexsort((np.arange(400), d)) if i != q} & set([i for i in np.lexsort((np.arange(400), d)) if i != q][:10]))
    assert hit >= 0.9 * 80
    assert ann.neighbours(df.limit(0), F.col("id") == 0).count() == 0


def test_repeated_ids_are_one_candidate(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 8))
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(7, x[0] * (3 - n / 100)) for n in range(60)]  # the largest products, and
    rows += [(9, x[0] + n / 1e4) for n in range(60)]  # the nearest, of more rows than any k
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    whole = {}
    near = {}
    for i, v in rows:
        if i:
            s, d = int(np.floor(v * 256) @ np.floor(x[0] * 256)), float(np.sqrt(((v - x[0]) ** 2).sum()))
            whole[i], near[i] = max(whole.get(i, s), s), min(near.get(i, d), d)
    want = sorted(whole.items(), key=lambda y: (-y[1], y[0]))[:5]
    got = topk.top_k(df, F.col("id") == 0).orderBy("rank").collect()
    assert [(g["rank"], g["vec_id"], g["score"]) for g in got] == [(k + 1, *y) for k, y in enumerate(want)]
    want = sorted(near.items(), key=lambda y: (y[1], y[0]))[:10]
    got = ann.neighbours(df, F.col("id") == 0, 10).orderBy("rank").collect()
    assert [(g["rank"], g["vec_id"]) for g in got] == [(k + 1, y[0]) for k, y in enumerate(want)]
    assert [g["score"] for g in got] == pytest.approx([y[1] for y in want])


def test_best_keeps_the_better_row_of_an_id():
    best = Best(np.array([0]), 2, np.array([-np.inf]))
    best.add(np.array([[5.0, 1.0]]), np.array([1, 2]))
    best.add(np.array([[3.0, 2.0]]), np.array([1, 3]))
    assert sorted(best.rows()) == [(0, 1, 5.0), (0, 3, 2.0)]


def test_best_counts_ids_not_rows():
    best = Best(np.array([0]), 2, np.array([-np.inf]))
    best.add(np.array([[*range(10, 40), 2.0, 1.0]]), np.array([1] * 30 + [2, 3]))
    assert sorted(best.rows()) == [(0, 1, 39.0), (0, 2, 2.0)]


def test_hilbert_neighbours_touch():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = hilbert_key(g, 3)
    o = g[np.argsort(k)]
    assert sorted(k) == list(range(512)) and (np.abs(np.diff(o, axis=0)).sum(1) == 1).all()


def test_classifiers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.where(langid.id_remainder(F.col("doc_id"), 3) != 1)
    found = langid.predict(docs, langid.fit(train)).join(docs, F.col("id") == F.col("doc_id")).where(langid.id_remainder(F.col("doc_id"), 3) == 1)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(quality.labelled(docs, labels))
    scored = quality.predict(docs, model).join(labels, F.col("id") == F.col("doc_id")).where(langid.id_remainder(F.col("doc_id"), 3) == 1)
    assert scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.85
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "été")], "doc_id long, text string")
    assert {r["id"]: r["lang_pred"] for r in langid.predict(odd, langid.fit(train)).collect() if r["id"]} == {1: "und", 2: "und", 3: "und"}
    assert all(0 <= r["score"] <= 1 for r in quality.predict(odd, model).collect())
    assert quality.predict(odd, quality.fit(quality.labelled(docs, labels.limit(0)))).where("score <> 0.5").count() == 0
    assert langid.predict(odd, langid.fit(train.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_kernel_against_brute_force(spark):
    """Kernel ridge regression on all pairs' kernels, with every text a landmark, gives the same decisions and scores."""
    r = random.Random(8)
    pools = {"x": ["alpha", "beta", "gamma"], "y": ["uno", "dos", "tres"], "z": ["ein", "zwei", "drei"]}
    rows = [(i, " ".join(r.choice(pools[k] + ["shared", "words"]) for _ in range(r.randint(3, 9))), k) for i, k in enumerate("xyz" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["id"]: x for x in langid.predict(df, langid.fit(df)).collect()}
    seen = np.zeros(langid.SPECTRUM, bool)
    grams = [set(langid.spectrum(t.encode(), seen).tolist()) for _, t, _ in rows]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    y = np.array([2.0 * (np.array(["x", "y", "z"]) == k) - 1 for _, _, k in rows])
    centred = y - y.mean(axis=0)  # classes of one size weigh alike
    alpha = np.linalg.solve(kernel + langid.RIDGE * len(rows) / 100 * np.eye(len(rows)), centred)
    value = langid.SHARPNESS * (kernel @ alpha + y.mean(axis=0))
    p = np.exp(value - value.max(axis=1, keepdims=True))
    for i, _, _ in rows:
        assert got[i]["lang_pred"] == "xyz"[value[i].argmax()]
        assert got[i]["score"] == pytest.approx(p[i].max() / p[i].sum(), abs=2e-3)


def test_quality_dual_against_projected_gradient():
    """The hinge-loss dual of a small problem, solved the slow way."""
    r = np.random.default_rng(5)
    y = np.where(r.random(60) < 0.5, 1.0, -1.0)
    rows = [np.unique(r.integers(0, 12, 5) + (6 if k > 0 else 0)) for k in y]
    values, cost = r.normal(1, 0.3, 20), np.full(60, 0.4)
    w, bias = quality.dual_coordinate_descent(rows, values, y, cost, 4000)
    x = np.zeros((60, 21))
    for i, places in enumerate(rows):
        x[i, places] = values[places] / np.sqrt(len(places))
        x[i, 20] = 1
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(60)
    for _ in range(60_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, cost)
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert primal(np.append(w, bias)) == pytest.approx(primal((alpha * y) @ x), rel=1e-3)
    fast = quality.NBSVM(w.astype(np.float32), bias, 2.0, 0.1).score([*rows, np.zeros(0, np.int64)])
    slow = [1 / (1 + np.exp(-(2.0 * (w[places].sum() / np.sqrt(max(1, len(places))) + bias) + 0.1))) for places in [*rows, np.zeros(0, np.int64)]]
    assert fast == pytest.approx(slow, rel=1e-5)


def test_sample_per_class_takes_the_least_hashes(spark):
    from vellum.llm import grams

    rows = [(i, "ab"[i % 3 == 0], f"t{i}", "clash") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string, rank string")
    got = Counter(x["label"] for x in grams.sample_per_class(df, "kind", 40, "doc_id", "text").collect())
    assert got == {"a": 40, "b": 40}
    order = df.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).collect()
    want = {x["text"] for k in "ab" for x in sorted((x for x in order if x["kind"] == k), key=lambda x: (x["h"], x["doc_id"]))[:40]}
    assert {bytes(x["t"]).decode() for x in grams.sample_per_class(df, "kind", 40, "doc_id", "text").collect()} == want


CLASHING = "id t key row runs rank label order size shard home node root bits keys n own d1 d2 s fp low component i s_ z k rows each nth copy source_size target w level bin block blocks p u _key _size _rank _slice piece start length v at run part no".split()


def test_columns_that_clash_with_ours(spark, rows):
    """Every operator and stage over documents whose extra columns have the names used inside."""
    import corpus_pipeline as p

    base = spark.createDataFrame([r[:5] for r in rows if r[0] is None or r[0] < 40], "doc_id long, text string, lang string, source string, n_chars long")
    more = base.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])
    both = lambda f: (Counter(map(str, f(base).collect())), Counter(map(str, f(more).collect())))
    model = langid.fit(base)
    for f in (simhash.near_duplicates, similar.similar_documents, lambda d: langid.predict(d, model), repeats.find_repeats, packing.pieces, sharding.shard, mixing.mix, lambda d: lm.score(d, F.lit(True)).select("id", "n_tokens", "n_known", F.round("base_score", 6), F.round("score", 6))):
        a, b = both(f)
        assert a == b
    for f in (similar.drop_similar, repeats.remove_repeats, mixing.take_mix):
        a, b = f(base), f(more)
        assert b.columns == more.columns
        assert Counter(map(str, a.collect())) == Counter(map(str, b.select(base.columns).collect()))
        assert b.select(CLASHING).distinct().count() == 1
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 60").select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.select(CLASHING).distinct().count() == 1
    assert p.STAGES[-1][1](spark, docs, d).count() > 0


def planted(seed=12):
    """Documents, and labels by which one word makes a text bad: near copies, exact copies, a shared passage."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(900)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [make(r.randint(20, 120)) for _ in range(120)]
    texts += [t + " more" for t in texts[:15]] + texts[15:25]
    passage = make(70)
    texts += [f"{make(50)} {passage} {make(50)}" for _ in range(4)] + ["", None]
    bad = [f"{make(30)} rubbish spam rubbish" for _ in range(40)]
    docs = [(i, t, "en", r.choice("pqr"), len(t or "")) for i, t in enumerate(texts + bad)]
    labels = [(i, int(i < len(texts)), 0) for i in range(len(docs)) if i % 2 == 0]
    return docs, labels, len(texts)


def test_pipeline_stages_against_plain_python(spark, tmp_path):
    import corpus_pipeline as p

    rows, labels, good = planted()
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])
    stage = dict(p.STAGES)

    model = quality.fit(quality.labelled(docs, spark.read.parquet(f"{d}/labels.parquet")))
    seen = np.zeros(quality.WIDTH, bool)
    passes = {r[0] for r in rows if model.score([quality.indicators((r[1] or "").encode(), seen)])[0] >= 0.5}
    first = sorted(map(key, stage["quality_classifier"](spark, docs, d).collect()))
    assert first == sorted(r for r in rows if r[0] in passes)
    assert sum(i < good for i in passes) >= 0.95 * good and sum(i >= good for i in passes) <= 4

    docs = spark.createDataFrame(first, docs.schema)
    groups = similar_groups([r[0] for r in first], [r[1] for r in first], 5, 0.8)
    second = sorted(map(key, stage["simhash_near_dedup"](spark, docs, d).collect()))
    assert second == [r for r in first if r[0] in {low for _, low in groups}]
    assert len(second) <= len(first) - 20

    docs = spark.createDataFrame(second, docs.schema)
    texts = [(r[1] or "").encode() for r in second]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for r, t in zip(second, texts):
        gone = {j for i in range(len(t) - 199) if count[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        kept = None if r[1] is None else bytes(b for j, b in enumerate(t) if j not in gone).decode()
        want.append((*r[:1], kept, *r[2:4], None if kept is None else len(kept)))
    third = sorted(map(key, stage["suffix_array_dedup"](spark, docs, d).collect()))
    assert third == want and sum(a[1] != b[1] for a, b in zip(second, third)) >= 3

    docs = spark.createDataFrame(third, docs.schema)
    copies_of = {r["id"]: r["copies"] for r in mixing.mix(docs).collect()}
    fourth = sorted(map(key, stage["mix_sources"](spark, docs, d).collect()))
    assert Counter(fourth) == Counter({r: copies_of[r[0]] for r in third if copies_of[r[0]]})

    docs = spark.createDataFrame(fourth, docs.schema)
    enc, packed = packing.encoder(), stage["best_fit_packing"](spark, docs, d).collect()
    want = Counter()
    for r in fourth:
        ids = np.array([*enc.encode(r[1] or "", allowed_special="all"), 0], "<u4")
        want[r[0], len(ids), crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in packed) == want
    whole = Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in p.run(spark, d).collect())
    assert whole == want


@pytest.mark.parametrize("n", [0, 1])
def test_pipeline_stages_with_nulls_and_empty_tables(spark, tmp_path, n):
    import corpus_pipeline as p

    rows = [(1, None, None, None, None), (None, "no id", None, None, None), (1, "again", None, "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0)] * n
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, d)
        assert docs.columns == columns
    assert (p.run(spark, d).count() > 0) == bool(n)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before, docs = docs.columns, stage(spark, docs, d)
        assert docs.columns == before, name
    assert p.run(spark, d).count() > 0
