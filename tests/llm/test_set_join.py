"""Near copies by whole shingle sets, against brute force over all pairs."""

import itertools
import random

import pytest

from copse.llm import set_join, simhash_dedup


def exact_components(docs, similarity=0.8, words=5):
    sets = {i: set(set_join.shingles(t, words)) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in docs}


def got(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash_dedup.verified_duplicates(df).collect()}


def test_contiguous_edits_are_found(spark):
    rng, docs = random.Random(5), {}
    say = lambda n: rng.choices([f"w{i}" for i in range(20_000)], k=n)
    for i in range(0, 900, 3):
        n = rng.randint(150, 600)
        base, tail = say(n), int(n * rng.uniform(0.12, 0.23))
        docs[i], docs[i + 1], docs[i + 2] = (" ".join(x) for x in (base, base + say(tail), base[: n - tail // 2] + say(tail // 2)))
    want = exact_components({i: docs[i] for i in list(docs)})
    assert got(spark, docs) == want and len(set(want.values())) < 400


@pytest.mark.parametrize("hot", [7, 4096])
def test_variants_of_a_template_are_one_class(spark, monkeypatch, hot):
    monkeypatch.setattr(set_join, "HOT_KEY", hot)
    rng, docs = random.Random(6), {}
    base = [f"w{i}" for i in range(200)]
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([2, 3])):
            words[at] = f"e{i}x{at}"
        docs[i] = " ".join(words)
    assert got(spark, docs) == exact_components(docs)


def test_pairs_near_the_threshold_are_judged_on_whole_sets(spark):
    rng, docs = random.Random(7), {}
    for i in range(0, 200, 2):
        base = [f"d{i}w{k}" for k in range(800)]
        docs[i] = " ".join(base)
        for at in rng.sample(range(0, 800, 8), rng.randint(15, 21)):
            base[at] = "new"
        docs[i + 1] = " ".join(base)
    want = exact_components(docs)
    assert got(spark, docs) == want and 110 < len(set(want.values())) < 190


def test_exact_copies_that_share_no_key_with_others(spark):
    assert got(spark, {4: "a b", 2: "A b", 7: "c", 9: ""}) == {4: 2, 2: 2, 7: 7}


def test_pairs_that_cannot_be_similar_are_no_rows(spark, monkeypatch):
    # variants of one template of which hardly any two are similar: all share keys, few may be paired
    rng, docs, made = random.Random(8), {}, []
    base = [f"w{i}" for i in range(200)]
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(200), 4):
            words[at] = f"e{i}x{at}"
        docs[i] = " ".join(words)
    for i in range(150, 170):  # and some groups of long texts, each pair of which shares hundreds of keys
        words = [f"l{i // 5}w{k}" for k in range(2000)]
        words[:i] = [f"l{i}v{k}" for k in range(i)]
        docs[i] = " ".join(words)
    tried = set_join._tried

    def counted(similarity, near, far):
        run, rows = tried(similarity, near, far), spark.sparkContext.accumulator(0)
        made.append(rows)

        def counting(batches):
            for batch in run(batches):
                rows.add(batch.num_rows)
                yield batch

        return counting

    monkeypatch.setattr(set_join, "_tried", counted)
    assert got(spark, docs) == exact_components(docs)
    assert len(made) > 1 and sum(rows.value for rows in made[1:]) < 2 * len(docs), [rows.value for rows in made]


def test_bounds_never_leave_out_similar_sets():
    rng = random.Random(9)
    for n in (1, 5, 30, 400, 3000, 30_000):
        a = set_join.hashed(" ".join(rng.choices([f"w{i}" for i in range(5000)], k=n + 4)), 5)
        for share in (0, 0.02, 0.1, 0.12, 0.3):
            own = set_join.hashed(" ".join(f"o{share}x{i}" for i in range(int(share * n) + 5)), 5)
            b = set_join.np.unique(set_join.np.r_[a[int(share * n) :], own[: int(share * n)]])
            x, y = (set_join.np.frombuffer(set_join.profile(s), set_join.np.uint8) for s in (a, b))
            assert set_join.may_be_similar(x, y, len(a), len(b), min(0.8, set_join.jaccard(a, b)))
    firsts = [set_join.np.frombuffer(set_join.first_keys(set_join.np.array(k, dtype="int64")), "int64")[None] for k in ([3, 7, 9], [5, 7], [0])]
    met = lambda i, j, p, q: bool(set_join._met_before(firsts[i], firsts[j], set_join.np.array([p]), set_join.np.array([q]))[0])
    assert met(0, 1, 2, 2) and not met(0, 1, 1, 1) and not met(0, 1, 2, 1)  # before both places, not at them
    assert not met(0, 2, 3, 1) and not met(1, 2, 2, 1)  # what fills up is no key
