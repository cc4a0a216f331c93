"""The registered queries of exact operators against their SQL, on the smallest tables."""

import duckdb
import pytest

from copse.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_exact_search", "op12_hard_negatives", "op13_collocations"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    ours, theirs = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(ours.columns)
    order = [list(theirs.columns).index(c) for c in columns]
    rows = sorted(tuple(r[c] for c in columns) for r in ours.collect())
    assert rows and rows == sorted(tuple(r[i] for i in order) for r in theirs.fetchall())
