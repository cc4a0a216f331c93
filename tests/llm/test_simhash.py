"""Fingerprints and near-duplicate groups against brute force."""

import hashlib
import itertools
import random

import pytest
import xxhash

from copse.llm import fingerprints, simhash_dedup

SCHEMA = "doc_id long, text string, component_id string, w0 string, lang string"


def slow_simhash(text):
    """The stated rule, a bit at a time."""
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius):
    """Smallest id reachable, over all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    texts = ["", None, "  \t\n", "one", "One", "a b c", "x " * 5000]
    base = [" ".join(rng.choices(words, k=rng.randint(3, 120))) for _ in range(n)]
    for t in base:
        texts.append(t)
        for _ in range(rng.randint(0, 4)):
            ws = t.split()
            ws[rng.randrange(len(ws))] = rng.choice(words)
            t = rng.choice([" ", "\n"]).join(ws)
            texts.append(t)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus()
    rows = [(i, t, "clash", "clash", None) for i, t in docs]
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: slow_simhash(t or "") for i, t in docs}
    assert {i: r.w0 % 2**64 for i, r in got.items()} == prints
    want = slow_components(prints, 4)
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_large_groups_and_repeated_rows(spark):
    # a chain and a dense ball of fingerprints, all within shared keys
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {i: base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for i in range(400)}
    far = base
    for i in range(400, 420):
        far ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints[i] = far
    prints |= {i: rng.getrandbits(64) for i in range(420, 600)}
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in prints.items()] + [(5, (prints[5] + 2**63) % 2**64 - 2**63), (None, 7), (None, (prints[5] + 2**63) % 2**64 - 2**63)]
    df = spark.createDataFrame(rows, "doc_id long, w0 long")
    from pyspark.sql import functions as F

    got = fingerprints.within(df, simhash_dedup.variant_keys([F.col("w0")], 3), 4, ["w0"]).collect()
    assert len(got) == len(rows)
    want = slow_components(prints, 4)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == sorted([want[5], None], key=str)


@pytest.mark.parametrize("limit", [1, 7, 50, 1000])
def test_hot_keys_in_parts_lose_no_link(spark, limit):
    from pyspark.sql import functions as F

    from copse.llm import buckets

    rng = random.Random(limit)
    base = rng.getrandbits(64)
    prints = {i: base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for i in range(150)}
    far = base
    for i in range(150, 200):
        far ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints[i] = far
    once = {p: i for i, p in reversed(prints.items())}
    rows = [(i, p - 2**64 if p >= 2**63 else p) for p, i in once.items()]
    keys = simhash_dedup.variant_keys([F.col("w0")], 3)
    edges = buckets.links(spark.createDataFrame(rows, "id long, w0 long"), ["w0"], keys, 4, hot_key=limit)
    nodes = {i: p for p, i in once.items()}
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges.collect():
        assert (nodes[a] ^ nodes[b]).bit_count() <= 4
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {i: find(i) for i in nodes} == slow_components(nodes, 4)


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(4)
    prints = {}
    for i in range(150):
        p = rng.getrandbits(128)
        prints[2 * i] = p
        prints[2 * i + 1] = p ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, fingerprints.RADIUS + 2)))
    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    df = spark.createDataFrame([(i, signed(p >> 64), signed(p & (2**64 - 1))) for i, p in prints.items()], "doc_id long, hi long, lo long")
    assert {r.doc_id: r.component_id for r in fingerprints.search(df).collect()} == slow_components(prints, fingerprints.RADIUS)


@pytest.mark.parametrize("ids", [list(range(7)), [0, 5000, 9_999_999, -3, 2048, 2047], [4], [1, 1, None, None, 3]])
def test_fingerprints_meet_the_next_smaller_id(spark, ids):
    rng = random.Random(len(ids))
    texts = ["".join(rng.choices("ab é😀\n", k=rng.randint(0, 40))) for _ in ids]
    rows = list(zip(ids, texts, strict=True))
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    if len(set(ids)) == len(ids):
        order = sorted(rows, reverse=True)
        for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
            r = next(r for r in got if r.doc_id == i)
            e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert r.fingerprint == fingerprints.weighted_simhash(t).hex() and r.edited_fingerprint == fingerprints.weighted_simhash(e).hex()
            assert r.near_next == fingerprints.likeness(fingerprints.weighted_simhash(t), fingerprints.weighted_simhash(nxt))


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_parts_of_any_size_meet(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "PART_BYTES", size)
    rng = random.Random(size)
    rows = [(i * 10**9 if i % 3 else None, f"t{i} " * rng.randint(1, 9)) for i in range(60)] + [(7, "same text")] * 60
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    order = sorted((r for r in rows if r[0] is not None and r[0] != 7), reverse=True)
    nexts = dict(zip([i for i, _ in order], [t for _, t in order[1:]] + ["same text"], strict=True))
    for r in got:
        if r.doc_id in nexts:
            assert r.near_next == fingerprints.likeness(fingerprints.weighted_simhash(dict(rows)[r.doc_id]), fingerprints.weighted_simhash(nexts[r.doc_id]))
    assert sum(r.doc_id == 7 and r.near_next == 1 for r in got) == 59


def test_weights_grow_with_the_logarithm():
    terms = ["a b c"] * 9 + ["d e f"]  # as texts of one term each would vote
    text = "\n".join(terms)
    assert fingerprints.weighted_simhash(text) == fingerprints.weighted_simhash(text.upper())
    assert fingerprints.weighted_simhash("") == bytes(16)


def test_keep_one_and_empty_tables(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = " ".join(rng.choices(words, k=400))
    near = base.split()
    near[200] = "changed"
    rows = [(1, base, "s"), (2, base, "s"), (3, " ".join(near), "s"), (4, " ".join(rng.choices(words, k=400)), "s"), (5, "", "s"), (6, None, "s"), (None, base, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, None], key=str)
    empty = df.limit(0)
    assert simhash_dedup.near_duplicates(empty).count() == 0 and simhash_dedup.keep_one(empty).count() == 0
    assert fingerprints.search(fingerprints.fingerprints(empty)).count() == 0
