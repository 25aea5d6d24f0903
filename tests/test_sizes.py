"""Queries on tables with keys, groups and orders that the smallest tables don't have, against their SQL."""

from __future__ import annotations

import duckdb
import pytest
from test_queries import QUERIES, SQL, plain


def same(spark, name, folder, tables):
    """Whether a query over ``tables`` (name: SQL) equals its own SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    found = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    wanted = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert wanted and found == wanted


#: Parts whose keys have six digits and begin alike.
SHOP = {
    "part": "SELECT 123400 + i AS p_partkey, 'part ' || (i // 2) AS p_name FROM range(60) r(i) UNION ALL SELECT i, 'low ' || i FROM range(1, 60) r(i)",
    "orders": "SELECT 200000 + i AS o_orderkey FROM range(40) r(i)",
    "lineitem": "SELECT 200000 + i // 7 AS l_orderkey, CASE WHEN i % 5 = 0 THEN 1 + i % 59 ELSE 123400 + i * 7 % 60 END AS l_partkey, CAST(i % 7 + 1 AS INTEGER) AS l_linenumber FROM range(210) r(i)",
}


@pytest.mark.parametrize("name", ["match_cascade", "bibliography_matches", "connect_decision"])
def test_parts_of_six_digits_are_told_apart(spark, tmp_path, name):
    same(spark, name, tmp_path, SHOP)


@pytest.fixture
def words(tmp_path):
    same_word = "SELECT 1 AS doc_id, repeat('a ', 3000) AS text UNION ALL SELECT 2, NULL UNION ALL SELECT 3, ' ' UNION ALL SELECT 4, 'b  a b' UNION ALL SELECT 4, 'c d'"
    return {"documents": f"{same_word} UNION ALL SELECT 10, (SELECT string_agg('w' || (i * 7919 % 1000), ' ' ORDER BY i) FROM range(5000) r(i))"}


def test_abstracts_are_rebuilt_from_rows_of_any_length_and_id(spark, tmp_path, words):
    """Two texts of one id are two texts, which a grouping by id had made one."""
    same(spark, "rebuilt_abstracts", tmp_path, words)


def test_abstracts_are_rebuilt_without_a_shuffle(spark, tmp_path, words):
    duckdb.sql(f"COPY ({words['documents']}) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    assert "Exchange" not in QUERIES["rebuilt_abstracts"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
