"""The pipeline's stages on planted cases, odd rows, and an empty table."""

import random
import zlib

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from copse.llm import packing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def planted(rng):
    words = ["".join(rng.choices("bcdfglmnprst", k=2)) + "".join(rng.choices("aeiou", k=2)) + "".join(rng.choices("bdgkt", k=2)) for _ in range(4000)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    docs, toxic = {}, {}
    for i in range(300):
        docs[i] = f"{say(rng.randint(30, 120))}\n{say(40)}"
        if i % 6 == 0:
            docs[i] += "\n" + " ".join(rng.choice(["idiot", "moron", "scum", "loser"]) + " " + say(3) for _ in range(4))
        toxic[i] = int(i % 6 == 0)
    clean = [i for i in docs if not toxic[i]]
    near = {}
    for k, i in enumerate(clean[:20]):
        ws = docs[i].split(" ")
        ws[rng.randrange(len(ws))] = "edited"
        docs[1000 + k] = " ".join(ws)
        near[1000 + k] = i
    for k in range(15):
        docs[2000 + k] = docs[clean[30]]
        near[2000 + k] = clean[30]
    for i in clean[40:120]:
        docs[i] = "All rights reserved here.\n" + docs[i]
    docs[clean[50]] += "\nwrite to jo@site.org or 4111 1111 1111 1111"
    return docs, toxic, near, clean


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(11)
    docs, toxic, near, clean = planted(rng)
    root = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", f"src{i % 3}", len(t), "x") for i, t in docs.items()]
    rows += [(5000, None, None, None, None, None), (5001, "", "en", "src0", 0, "y"), (None, "alone " * 30, "en", "src1", 3, None), (clean[60], docs[clean[60]], "en", "src0", 1, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), docs, toxic, near, clean


def test_stages(spark, sf, tmp_path):
    root, docs, toxic, near, clean = sf
    df = spark.read.parquet(f"{root}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, root)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        kept[name] = df.collect()
    by_id = lambda name: {r.doc_id: r for r in kept[name]}
    assert {r.doc_id for r in kept["toxicity"]} == {i for i in docs if not toxic.get(i)} | {5000, 5001, None}
    lines = by_id("line_dedup")
    assert len(kept["line_dedup"]) == len(kept["toxicity"]) and lines[5000].text is None and lines[5001].text == ""
    assert all(lines[i].text == docs[i].removeprefix("All rights reserved here.\n") for i in clean)
    left = by_id("simhash_near_dedup")
    assert set(left) == set(lines) - set(near)
    assert len(kept["simhash_near_dedup"]) == len(left) + 1  # the repeated row stays with its other
    assert left.keys() == by_id("pii").keys() and by_id("pii")[clean[50]].text.endswith("write to [EMAIL] or [CARD]")
    tok = Tokenizer.from_file(packing.TOKENIZER)
    for i, r in by_id("pii").items():
        assert r.n_chars == (None if r.text is None else len(r.text))
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert {p.doc_tokens for p in kept["packing"] if p.doc_id == i} == {n}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, root).collect()} == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in kept["packing"]}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_held_out_remainder_is_that_of_crc32(spark):
    from copse.llm import toxicity
    from pyspark.sql import functions as F

    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
