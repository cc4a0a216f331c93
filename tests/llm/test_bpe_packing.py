"""Byte-level BPE by tree reduction, and packing, against the libraries and slow versions."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from copse.llm import bpe, packing

ENC = bpe.encoding()
ODD = ["'s", "'", "r", "e", " ", "  ", "\n", "\t", " ", "\x1c", " ", "é", "日本", "😀", "a", "B", "1", "²", "٣", "!?", "<|endoftext|>", "\r\n", "ll", "ß", "​", "́"]


@given(st.lists(st.sampled_from(ODD), max_size=80).map("".join), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_any_tree_gives_the_library_ids(text, leaf):
    ids = bpe.encode(text, ENC, leaf)
    assert ids == ENC.encode_ordinary(text)
    assert bpe.decode(ids, ENC, leaf) == text.encode()


@given(st.text(max_size=60), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_any_text(text, leaf):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.encode(text, ENC, leaf) == ENC.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 20_000, "ab'" * 9_000, "word " * 20_000, "\n" * 5000 + "x" + " " * 5000])
def test_long_texts(text):
    ids = bpe.encode(text, ENC)
    assert ids == ENC.encode_ordinary(text) and bpe.decode(ids, ENC) == text.encode()


@pytest.mark.parametrize("space", [" ", "\n", "\t ", "\u3000"])
def test_very_long_white_space(space):
    run = space * (70_000 // len(space))
    for text in (run, run + "x", "a" + run, f"a{run}b {run}{run}'s", f"{run}\x1c{run}1"):
        assert bpe.encode(text, ENC) == ENC.encode_ordinary(text)
    text = space * 1_200_000 + "end"  # on which the library's regular expression overflows
    assert bpe.decode(bpe.encode(text, ENC), ENC) == text.encode()


def test_documents(spark):
    texts = ["", None, "hello world", "héllo " * 3000, "hello world"]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted(bpe.digest_documents(df).collect(), key=lambda r: r.doc_id or 0)
    full = sorted(bpe.encode_documents(df).collect(), key=lambda r: r.doc_id or 0)
    assert len(got) == len(full) == 5 and got[0].doc_id is None
    for t, r, f in zip(texts, got, full, strict=True):
        ids = ENC.encode_ordinary(t or "")
        assert f.ids == ids and bytes(f.decoded) == (t or "").encode()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digest_documents(df.limit(0)).count() == 0


def slow_best_fit(lengths, length):
    room, out = [], []
    for n in lengths:
        fits = [w for w in range(len(room)) if room[w] >= n]
        w = min(fits, key=lambda w: room[w]) if fits else len(room)
        if not fits:
            room.append(length)
        out.append(length - room[w])
        room[w] -= n
    return sorted(room), out


@given(st.lists(st.integers(1, 31), max_size=200))
@settings(max_examples=200, deadline=None)
def test_best_fit_decreasing(lengths):
    lengths = sorted(lengths, reverse=True)
    windows, offsets = packing.best_fit_decreasing(lengths, 32)
    room = {}
    for n, w, o in zip(lengths, windows, offsets, strict=True):
        assert room.get(w, 0) == o  # gapless
        room[w] = o + n
        assert room[w] <= 32
    assert sorted(32 - x for x in room.values()) == slow_best_fit(lengths, 32)[0]


def test_packing_holds_every_id_once(spark):
    rng = random.Random(5)
    tok = Tokenizer.from_file(packing.TOKENIZER)
    texts = ["", None, "a <|endoftext|> b", "<|endoftext|>", "x" * 9000, "word " * 2047, "word " * 6000, *(" ".join(rng.choices(["the", "über", "12", "\n"], k=rng.randint(1, 4000))) for _ in range(60))]
    texts.append(texts[-1])
    df = spark.createDataFrame([(None if i == 4 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    from pyspark.sql import functions as F

    cut = packing.cut(packing.pieces(df).withColumn("ids_crc32", F.crc32("ids")))
    packed = packing.pack(cut, shard=20)
    rows = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc[None if i == 4 else i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for s, own in by_sequence.items():
        want = b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.offset))
        n = len(want) // 4
        assert bytes(whole[s].ids) == want + bytes(0 if n & (n - 1) == 0 else 4 * (2048 - n))
    assert packing.packed_digests(df.limit(0)).count() == 0


def test_repeated_rows_are_spread(spark):
    df = spark.createDataFrame([(3, "the same text", "s")] * 1000, "doc_id long, text string, shard string").repartition(8)
    packed = packing.pack(packing.cut(packing.pieces(df).selectExpr("*", "'own' AS shard")), shard=100).collect()
    shards = {}
    for r in packed:
        shards[(r.sequence_id // 2) >> 33] = shards.get((r.sequence_id // 2) >> 33, 0) + 1
    assert len(packed) == 1000 and len(shards) == 10 and max(shards.values()) < 200 and {r.shard for r in packed} == {"own"}
