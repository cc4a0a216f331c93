"""Weak supervision on planted words, held-out accuracy, and odd input."""

import itertools
import math
import random
import zlib

import numpy as np

from copse.llm import toxicity


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    plain = [f"w{''.join(rng.choices('abcdefgh', k=5))}" for _ in range(300)]
    bad = ["grubak" + e for e in ("ing", "ed", "or", "ish", "est", "ly")] + ["snarl", "idiot"]
    rows = []
    for i in range(n):
        words, y = rng.choices(plain, k=rng.randint(5, 80)), int(rng.random() < 0.15)
        if y:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, "", "x"), (5001, None, "x"), (None, "snarl", "x"), (0, rows[0][1], "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_on(docs, labels)  # the held-out labels are wrong on purpose: they must not matter
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.toxicity <= 1 for r in got)
    score = {r.doc_id: r.toxicity for r in got}
    held = [(score[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.97
    assert score[5000] == score[5001] < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(40)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit_on(docs, none).score("a") == 0.5
    for label, fits in ((0, lambda s: s < 0.2), (1, lambda s: s > 0.8)):
        same = spark.createDataFrame([(i, 1, label) for i in range(40)], "doc_id long, quality int, toxic int")
        model = toxicity.fit_on(docs, same)
        assert not model.weights and fits(model.score("a"))
    assert toxicity.fit([("a", 1.0)], [([0], [0, 0, 0], 0)] * 9).score("a") < 0.2


def test_columns_with_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a", 7.5)], "doc_id long, text string, toxicity double")
    assert toxicity.reject(docs, toxicity.Model(-2.0, {})).collect()[0].toxicity == 7.5


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, y, ~y) + 1
    good, fair, noise = vote(0.9), vote(0.75), vote(0.5)
    votes = np.stack([good, fair, noise, noise, noise, vote(0.8)], axis=1)
    model = toxicity.fit_label_model(votes, np.where(good == 2, 0.8, 0.2))
    assert model.weights[2] < 0.5 < model.weights[0]
    assert (model.log_odds[0, 2] > model.log_odds[1, 2] > abs(model.log_odds[2, 2]))
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.88


def brute_label_model(votes, start, anchor, rounds):
    """The same model by its definition, a row, a voter and a vote at a time; returns prior, log-odds and weights."""
    n, m, post = len(votes), len(votes[0]), list(start)
    for _ in range(rounds):
        both = [1 - sum(post) / n, sum(post) / n]
        prior = (both[1] * n + 1) / (n + 2)
        chance = []  # of a vote, by class, voter and vote
        for k in (0, 1):
            weight = [p if k else 1 - p for p in post]
            chance.append([[(sum(w for w, row in zip(weight, votes) if row[j] == v) + 0.1) / (sum(weight) + 0.3) for v in range(3)] for j in range(m)])
        left = [[(row[j] == 2) - p * chance[1][j][2] - (1 - p) * chance[0][j][2] for j in range(m)] for p, row in zip(post, votes)]
        means = [sum(r[j] for r in left) / n for j in range(m)]
        spread = [math.sqrt(sum((r[j] - means[j]) ** 2 for r in left) / n) + 1e-9 for j in range(m)]
        weights = []
        for j in range(m):
            together = [sum(r[j] * r[i] for r in left) / n / spread[j] / spread[i] for i in range(m) if i != j]
            weights.append(1 / (1 + sum(min(1, max(0, c)) for c in together)))
        odds = [[0.0 if v == 0 else math.log(chance[1][j][v] / chance[0][j][v]) for v in range(3)] for j in range(m)]
        if anchor:
            odds[0], weights[0] = [0.0, math.log((1 - anchor) / anchor), math.log(anchor / (1 - anchor))], 1
        post = [brute_posterior(prior, odds, weights, row) for row in votes]
    return prior, odds, weights


def brute_posterior(prior, odds, weights, row):
    """Bayes' rule with the class-conditional odds of each vote raised to its voter's weight."""
    toxic, clean = prior, 1 - prior
    for j, v in enumerate(row):
        toxic *= math.exp(odds[j][v]) ** weights[j]
    return toxic / (toxic + clean)


def test_label_model_equals_brute_force():
    rng = np.random.default_rng(1)
    y = rng.random(400) < 0.4
    vote = lambda right: np.where(rng.random(400) < right, y, ~y) + 1
    first = vote(0.8)
    votes = np.stack([vote(0.9), first, np.where(rng.random(400) < 0.9, first, 0), vote(0.7)], axis=1)
    rows = np.array(list(itertools.product(range(3), repeat=4)))
    for anchor in (None, 0.97):
        start = np.where(votes[:, 0] == 2, 0.9, 0.1)
        model = toxicity.fit_label_model(votes, start, anchor, rounds=5)
        prior, odds, weights = brute_label_model(votes.tolist(), start.tolist(), anchor, 5)
        assert abs(model.prior - prior) < 1e-9 and np.allclose(model.log_odds, odds) and np.allclose(model.weights, weights)
        assert np.allclose(model.posterior(rows), [brute_posterior(prior, odds, weights, r) for r in rows.tolist()])
        assert model.weights[2] < model.weights[3]  # the copy shares its weight with what it repeats


def test_classifier_is_near_the_optimum_of_brute_force():
    """The fitted weights against plain gradient descent on the same loss, summed a row at a time."""
    rng = random.Random(2)
    chosen = [(f, 3.0) for f in ("bada", "badb", "odd-", "rare")]
    rows = []
    for _ in range(120):
        y = int(rng.random() < 0.4)
        rows.append(([f for f in range(4) if rng.random() < ((0.8, 0.7, 0.6, 0.1)[f] if y else (0.05, 0.1, 0.3, 0.05)[f])], [0, 0, 0], y))
    model = toxicity.fit(chosen, rows, rounds=3000)
    words, insults = {0, 1, 3}, set()
    votes = [[2 if y else 1, *[2 if set(own) & found else 1 for found in (insults, words, {2})], *seen, *[2 if f in own else 0 for f in range(4)]] for own, seen, y in rows]
    prior, odds, weights = brute_label_model(votes, [0.97 if y else 0.03 for *_, y in rows], 0.97, 12)
    target = [brute_posterior(prior, odds, weights, v) for v in votes]
    w, bias = [0.0] * 4, 0.0
    for _ in range(20_000):
        slope, level = [1e-3 * x for x in w], 0.0
        for (own, _, _), t in zip(rows, target):
            gap = (1 / (1 + math.exp(-bias - sum(w[f] for f in own))) - t) / len(rows) * 10
            level += gap
            for f in own:
                slope[f] += gap
        w, bias = [a - 0.1 * b for a, b in zip(w, slope)], bias - 0.1 * level
    scores = lambda b, ws, own: 1 / (1 + math.exp(-b - sum(ws[f] for f in own)))
    mine = [model.weights.get(f, 0.0) for f, _ in chosen]
    assert all(abs(scores(model.bias, mine, own) - scores(bias, w, own)) < 0.02 for own, *_ in rows)


def test_a_label_that_repeats_or_is_null(spark):
    """Repeated documents each count, a toxic label wins over a clean one of the same id, null ids and labels teach nothing."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, "grim snarl" if i % 2 else "mild word") for i in ids] + [(ids[0], None), (None, "snarl")], "doc_id long, text string")
    plain = [(i, 1, i % 2) for i in ids]
    score = lambda rows: toxicity.fit_on(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).score("grim snarl")
    assert score(plain) > 0.5
    assert score([*plain, *[(i, 1, 0) for i in ids], (None, 1, 0), (ids[1], 1, None)]) == score(plain)
