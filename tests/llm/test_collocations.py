"""Phrase collocations against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from copse.llm import collocations

SCHEMA = "doc_id long, text string, lang string, rank int, f string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count=30, max_n=4, first=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[("und" if lang is None else lang)] += len(words)
            for size in range(1, max_n + 1):
                f.update((("und" if lang is None else lang), tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= min_count}
    out = []
    for (lang, p), a in often.items():
        longer = [f[lang, q] for (other, q) in often if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranks = Counter()
    for lang, score, a, p, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= first:
            yield lang, ranks[lang], p.decode(), -a, left, right, n[lang], -score


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 5, "x") for i, (t, lang) in enumerate(rows)], SCHEMA)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    words = ["the", "The", "of", "a", "a", "é", "ÉA", "x\x01", "x", "\x00", "in", "quick", "brown", "fox", "naïve", "\U0001f600", " nb", *[f"w{i}" for i in range(60)]]
    weights = 1 / np.arange(1, len(words) + 1)
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".\n", "\r", ";", " \x0b"]
    text = lambda n: "".join(w + m for w, m in zip(rng.choice(words, n, p=weights / weights.sum()), rng.choice(marks, n)))
    out = [(text(int(n)), lang) for n, lang in zip(rng.integers(0, 200, 150), rng.choice(["en", "fr", None, ""], 150, p=[0.6, 0.2, 0.1, 0.1]))]
    out += [("the quick brown fox jumps over", "en")] * 40 + [("of of of of of of", "fr")] * 12 + [(None, "en"), ("", None), ("...", "xx"), ("lone", "yy")]
    return out


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])  # a bitmap too small to leave anything out changes nothing
def test_equals_brute_force(spark, rows, bits):
    assert found(collocations.mine(frame(spark, rows), bits=bits)) == sorted(brute(rows))


def test_cut_texts_and_first_rows(spark, rows, monkeypatch):
    long = [(" ".join(t or "" for t, lang in rows if lang == "en"), "en"), ("k" * 3000 + " " + "v " * 500, "en")]
    monkeypatch.setattr(collocations, "BLOCK", 500)
    monkeypatch.setattr(collocations, "_COLUMNS", 2)
    docs = frame(spark, rows + long).coalesce(1)
    # blocks are cut in this process, as the patched sizes do not reach the workers
    batch = docs.selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text").toArrow().combine_chunks().to_batches()
    counted = Counter()
    for lang, block, own in collocations._blocks(iter(batch), 4):
        number, first = block.names()
        assert [block.word(first[x]) for x in number] == [block.word(i) for i in range(len(block))]
        for i in range(own):
            for size in range(1, 5):
                if i + size <= len(block) and block.piece[i] == block.piece[i + size - 1]:
                    counted[lang, b" ".join(block.word(j) for j in range(i, i + size))] += 1
    whole = Counter()
    for text, lang in rows + long:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 5):
                whole.update((("und" if lang is None else lang), " ".join(words[i : i + size]).encode()) for i in range(len(words) - size + 1))
    assert counted == whole
    got = found(collocations.mine(docs, first=7))
    assert got == sorted(brute(rows + long, first=7))


def test_words_with_one_hash_are_told_apart():
    block = collocations.Block("en", b"aa bb aa cc bb")
    block.hash[:] = 7
    number, first = block.names()
    assert [block.word(first[x]) for x in number] == [b"aa", b"bb", b"aa", b"cc", b"bb"]


def test_empty_tables_and_exact_division(spark):
    assert found(collocations.mine(frame(spark, [(None, None)]))) == []
    assert found(collocations.mine(frame(spark, []).limit(0))) == []
    assert found(collocations.mine(frame(spark, [("x y", "en")] * 30))) == [("en", 1, "x y", 30, 30, 30, 60, 1_000_000)]
