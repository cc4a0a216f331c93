"""The driver contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as driver
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(driver.__file__))
QUICK = ["count_by_language", "role_summary", "token_estimate", "file_changes", "glob_match", "glob_many", "rename_pair", "budget_tiers", "coupling_pairs", "comment_drift", "dup_windows", "log_parsing", "folded_changes", "chunk_kinds"]


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_sql_agrees(spark, name):
    for table in ("customer", "orders", "lineitem", "part", "documents", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    ours = driver.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = duckdb.sql(driver.oracle_sql()[name])
    order = [list(theirs.columns).index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in ours.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in theirs.fetchall())


def test_comment_blame_agrees(spark):
    test_sql_agrees(spark, "comment_blame")


def test_works_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "copse"), tmp_path / "copse", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'count_by_language' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
