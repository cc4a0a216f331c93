"""The queries that apply each operator, with production parameters, to its whole table.

Each query derives its columns from the operator's own result. ``ORACLE_SQL`` has DuckDB SQL where SQL can
express the operator; the others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm import ann, bpe, collocations, exact_search, fingerprints, hard_negatives, line_dedup, packing, pii, secrets, simhash_dedup, toxicity, urls
from copse.llm.common import spans_digest, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.search(fingerprints.fingerprints(table(spark, sf_dir, "documents"))).drop("hi", "lo")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), host="source")
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _found(found: DataFrame, counts: dict[str, str], base: list[str], kinds: list[str]) -> DataFrame:
    of = lambda these: F.filter("found", lambda s: s["kind"].isin(these))
    n = [F.size(of([kind])).cast("long").alias(name) for name, kind in counts.items()]
    sha = F.sha2(F.encode(spans_digest(of(base), kinds), "UTF-8"), 256).alias("base_sha256")
    return found.select("doc_id", *n, sha, spans_digest("found", kinds).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return _found(found, {f"n_{k}": k for k in secrets.BASE}, secrets.BASE, secrets.KINDS)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), predicted)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return _found(found, {f"n_{k}": k for k in pii.BASE}, pii.BASE, pii.KINDS)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"))


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_fingerprints, op3_url_filters, op4_line_dedup, op5_nearest, op6_secrets, op7_simhash_dedup, op8_toxicity, op9_pii, op10_byte_bpe,
        op11_exact_search, op12_hard_negatives, op13_collocations, pipeline,
    )
}

#: Vectors that take part, each component as a whole number; their products are below 2^53, where doubles are exact.
_WHOLE = """whole AS (
            SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        )"""

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT rowid_, source, doc_id, pos, string_split(text, chr(10))[pos] AS line
            FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rowid_ FROM documents) d, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(pos)
        ), total AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
        seen AS (SELECT source, line, count(DISTINCT rowid_) AS n FROM lines GROUP BY source, line),
        judged AS (
            SELECT l.*, trim(l.line, ' ') <> '' AND n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.RATIO} * total AS dropped
            FROM lines l JOIN seen USING (source, line) JOIN total USING (source)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
            length(kept) AS kept_chars, md5(kept) AS kept_md5
        FROM (SELECT *, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped) OVER (PARTITION BY rowid_), '') AS kept FROM judged)
        GROUP BY rowid_, doc_id, kept""",
    "op11_exact_search": f"""
        WITH {_WHOLE}
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
        FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        ) WHERE rank <= 5""",
    "op12_hard_negatives": f"""
        WITH {_WHOLE}, labelled AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM whole WHERE label IS NOT NULL),
        scores AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM labelled a JOIN labelled c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM (
            SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
            FROM positives p JOIN scores n USING (anchor_id)
            WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
        ) WHERE rank <= 10""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
        grams AS (
            SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
            FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), unnest([1, 2, 3, 4]) s(size) WHERE i + size - 1 <= len(w)
        ), f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
        candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
        inside AS (
            SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longer
            FROM candidates, unnest([2, 3]) s(m), unnest([1, 2, 3]) t(i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL
        ), parts AS (
            SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS left_, array_to_string(list_slice(w, k + 1, size), ' ') AS right_
            FROM candidates, unnest([1, 2, 3]) s(k) WHERE k < size
        ), cuts AS (
            SELECT p.lang, p.phrase, a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS score
            FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = left_ JOIN f y ON y.lang = p.lang AND y.phrase = right_
        ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM best LEFT JOIN inside USING (lang, phrase) WHERE 100::HUGEINT * coalesce(longer, 0) < 80::HUGEINT * a
        ) JOIN totals USING (lang) WHERE rank <= 2000""",
}
