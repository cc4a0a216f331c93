"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from copse.llm import ann


def brute(rows, k):
    out = {}
    for qid in sorted({i for i, _ in rows if i is not None and i % 20 == 0}):
        q = next(v for i, v in rows if i == qid)
        scored = sorted((-float(sum(float(a) * float(b) for a, b in zip(q, v, strict=True))), i) for i, v in rows if i != qid and len(v) == len(q))
        out[qid] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 24))
    rows = [(i, (centers[i % 12] + rng.normal(size=24) * 0.9).astype("float32").tolist()) for i in range(1500)]
    rows = [(i, [x * (1 + i % 3) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute([(i, np.array(v, dtype="float32").tolist()) for i, v in rows], 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        exact = dict(want[q])
        hits += sum(i in exact for _, i, _ in found)
        assert all(abs(exact[i] - s) < 1e-9 for _, i, s in found if i in exact)
    assert hits / (20 * len(got)) > 0.9


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [2.0]), (None, [0.5, 0.5]), (9, [-1.0, 3.0]), (60, [])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=4).collect()
    found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20, 40, 60)}
    assert found[0] == [(20, 1.0), (20, 1.0), (1, 0.5), (2, 0.5)]
    assert found[20] == [(0, 1.0), (1, 0.5), (2, 0.5), (None, 0.5)]
    assert found[40] == [(8, 2.0)] and found[60] == []
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_every_query_meets_every_block(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(13)
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    want = brute(rows, 20)
    assert len(got) == 20 * len(want) == 20 * 35
    assert sum((r.vec_id in dict(want[r.query_id])) for r in got) / len(got) > 0.95


def shapes(rng):
    gauss = rng.normal(size=(20_000, 64))
    long = gauss.copy()
    long[17] *= 20
    return {"gaussian": gauss, "lengths": gauss * rng.lognormal(0, 0.5, size=(20_000, 1)), "one outlier": long, "clusters": gauss * 0.3 + rng.normal(size=(50, 64))[rng.integers(50, size=20_000)]}


def test_recall_at_size():
    """Recall against brute force on tables of 20,000 x 64 of several shapes."""
    for name, vectors in shapes(np.random.default_rng(8)).items():
        vectors = vectors.astype("f4").astype(float)
        index, asked, hits = ann.Index(vectors), np.arange(0, 20_000, 500), 0
        index.ask(vectors[asked])
        for n, q in enumerate(asked):
            rows, scores = index.nearest(np.arange(20_000), q, n, 20)
            whole = vectors @ vectors[q]
            whole[q] = -np.inf
            hits += len(set(rows) & set(np.argsort(-whole, kind="stable")[:20]))
            assert np.allclose(scores, whole[rows]) and (np.diff(scores) <= 0).all()
        assert hits / (20 * len(asked)) >= 0.95, name


def test_windows_only_grow():
    """Collisions counted by what the ends of windows pass are those of the windows themselves."""
    rng = np.random.default_rng(2)
    part = ann.Slice(rng.normal(size=(500, 6)), np.arange(500))
    part.enough = 200
    part.ask(rng.normal(size=(3, 6)))
    part.first /= 4
    for q in range(3):
        level, least = 0, int(np.ceil(ann.THRESHOLD * len(part.at) - 1e-9))
        numbers = np.empty_like(part.sorted)
        np.put_along_axis(numbers, part.order, part.sorted, axis=1)
        while True:
            counts = (np.abs(numbers - part.at[:, q : q + 1]) <= part.first * ann.GROWTH**level).sum(axis=0)
            if (counts >= least).sum() >= 200:
                break
            level += 1
        assert part.candidates(q).tolist() == np.flatnonzero(counts >= np.sort(counts)[-200]).tolist()


def test_one_id_with_two_vectors(spark):
    rows = [(0, [2.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 3.0]), (2, [5.0, 1.0]), (20, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    found = {q: [(r.vec_id, r.score) for r in sorted(got.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20)}
    # the least vector of id 0 asks, and both are candidates of id 20
    assert found == {0: [(1, 3.0), (2, 1.0), (20, 1.0)], 20: [(2, 6.0), (1, 3.5), (0, 2.0), (0, 1.0)]}
