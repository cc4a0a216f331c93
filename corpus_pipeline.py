"""The corpus pipeline: five stages over ``documents``, each applying one operator to all that the one before kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet in the shared folder and read again as the next one's ``docs``. ``ORACLE_SQL`` is None: hashing, learned
scores and tokenizers are beyond SQL, so the stages are tested against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from copse.llm import line_dedup, packing, pii, simhash_dedup, toxicity
from copse.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of rows that are not held out.

    A null text is scored as an empty one and stays null; repeated rows are judged alike; other columns are left out.
    """
    model = toxicity.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs.select(*COLUMNS), model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; a document of nothing else stays as it is.

    A null text stays null, a null source is a source of its own, repeated rows are pages of their own, and a line on
    exactly the ratio of a source's pages stays.
    """
    kept = line_dedup.drop_boilerplate(docs, host="source", keep_whole=True)
    return kept.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS LONG) AS n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    SimHash variants make the first pairs; what they miss is found by prefix filtering, and whole sets of shingle hashes
    (40 bits each) decide all links, so a link is exact up to equal hashes.

    Rows without an id, and null, empty and wordless texts, are no copies and stay. Of rows with one id all stay or go.
    """
    return simhash_dedup.keep_one(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; of spans that overlap the first and longest counts. A null text stays null."""
    return pii.redacted(docs).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS LONG) AS n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; a null text is its end id alone, and repeated rows are documents of their own."""
    return packing.packed_digests(docs)


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written once and read by the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
