"""Exact search and hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.llm import exact_search, hard_negatives, tiles

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, shard string"


def brute_search(rows, k=5, every=50):
    out, usable = [], [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in usable]
    for q in sorted({i for i, _ in whole if i is not None and i % every == 0}):
        asked = min((tuple(np.float32(v)) for i, v in usable if i == q))
        asked = [int(np.floor(256 * float(x))) for x in asked]
        scores = [(-sum(a * b for a, b in zip(asked, v)), i is None, i) for i, v in whole if i != q and len(v) == len(asked)]
        out += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def brute_negatives(rows, every=100):
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab) for i, v, lab, *_ in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, v, lab in sorted((x for x in whole if x[0] is not None and x[0] % every == 0), key=lambda x: x[0]):
        near = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, w, m in whole if i != a)
        for s, p, _ in [x for x in near if x[2] == lab][:5]:
            fit = [(t, n) for t, n, m in near if m != lab and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fit)]
    return out


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tiles, "LEAST", 16)
    monkeypatch.setattr(tiles, "SHARD", 50)
    monkeypatch.setattr(tiles, "BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype("f4").tolist(), 1, 7, "x") for i in range(500)]
    same = rng.normal(size=8).astype("f4").tolist()
    rows += [(1000 + i, same, 1, 7, "x") for i in range(250)]  # a third of all rows is one vector
    rows += [(2000, None, 1, 7, "x"), (2050, [None] * 8, 1, 7, "x"), (2100, [float("nan")] * 8, 1, 7, "x"), (2150, [float("inf")] * 8, 1, 7, "x"), (None, same, 1, 7, "x")]
    rows += [(2200, [0.0] * 8, None, None, None), (2250, [1.0, 2.0], 1, 7, "x"), (2251, [3.0, 4.0], 1, 7, "x"), (2300, [], 1, 7, "x")]
    rows += [rows[50], rows[50], rows[7], (50, [9.0] * 8, 1, 7, "x")]  # repeated rows, and one id with two vectors
    got = exact_search.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert found(got) == sorted(brute_search(rows))


def test_scores_beyond_doubles_are_exact_and_those_beyond_longs_held():
    a, b = np.array([[2.0**60, 3.0, -1.0]]), np.array([[1.0, 2.0, 5.0], [2.0**60, 1.0, 1.0]])
    assert tiles.products(a, b).tolist() == [[2**60 + 1, 2**63 - 1]]


def test_huge_components_do_not_fail(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [1e300, 1.0]), (3, [-1e300, 5.0])]
    got = exact_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 2**63 - 1), (3, -(2**63) + 1)]
    labelled = spark.createDataFrame([(i, v, i % 2) for i, v in rows], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(labelled, F.col("vec_id") == 0).count() == 0  # no different-label score is within the window


@pytest.mark.parametrize("dim, n, spread", [(4, 400, 1.0), (8, 300, 0.02), (1, 200, 1.0)])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, n, spread):
    monkeypatch.setattr(tiles, "LEAST", 16)
    monkeypatch.setattr(tiles, "SHARD", 100)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(dim)
    rows = [(i, (rng.normal(size=dim) * spread).astype("f4").tolist(), int(rng.integers(3)), 0, "x") for i in range(n)]
    same = (rng.normal(size=dim) * spread).astype("f4").tolist()
    rows += [(10_000 + i, same, int(rng.integers(3)), 0, "x") for i in range(n // 2)]  # ties at every score
    rows += [(20_000, None, 1, 0, "x"), (20_100, [None] * dim, 1, 0, "x"), (20_200, same, None, 0, "x"), (20_300, [float("nan")] * dim, 1, 0, "x")]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(got) == sorted(brute_negatives(rows))


def test_a_tree_leaves_out_what_cannot_meet_the_window(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 32)
    rng = np.random.default_rng(5)
    vectors = np.floor(np.r_[rng.normal(5, 0.1, (2000, 3)), rng.normal(-5, 0.1, (2000, 3))] * 256)
    tree, seen = hard_negatives.Tree(vectors), []
    real = tiles.products
    monkeypatch.setattr(tiles, "products", lambda a, b: seen.append(len(b)) or real(a, b))
    ids = tree.order
    ((rows, scores),) = tree.ask(vectors[0], np.ones(4000, dtype=bool), ids, [(-np.inf, np.inf)], 5)
    whole = vectors @ vectors[0]
    assert scores.tolist() == sorted(whole.tolist(), reverse=True)[:5] and (vectors[ids[rows]] @ vectors[0]).tolist() == scores.tolist()
    assert sum(seen) < 1000


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [2.0, 0.0], 1), (1, [4.0, 0.0], 1), (1, [4.0, 0.0], 1), (None, [2.0, 0.0], 2), (3, [3.0, 0.0], 2), (3, [3.0, 0.0], 2), (4, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = found(hard_negatives.mine(df, F.col("vec_id") == 0).drop("positive_score", "negative_score").where("positive_id = 1").select("rank", "negative_id"))
    # both rows of the positive's id are positives, each with both rows of id 3 and the row without an id
    assert got == [(1, 3), (1, 3), (2, 3), (2, 3), (3, None), (3, None)]
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert exact_search.search(df.limit(0), F.col("vec_id") == 0).count() == 0
