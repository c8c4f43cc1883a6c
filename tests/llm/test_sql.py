"""The SQL statements give what the queries give, also on hostile rows."""

from __future__ import annotations

import duckdb
import pytest

from namewatch.llm import catalog
from namewatch.llm.sql import ORACLE_SQL
from tests.conftest import SF_SMALL


def _compare(spark, name, folder):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS FROM read_parquet('{folder}/{table}.parquet/*.parquet')"
                    if folder != SF_SMALL else
                    f"CREATE VIEW {table} AS FROM read_parquet('{folder}/{table}.parquet')")
    got = catalog.QUERIES[name](spark, folder)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(
        map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_small_tables(spark, name):
    _compare(spark, name, SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_hostile_tables(spark, name, hostile_docs, tmp_path):
    hostile_docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "la la la"), (2, None), (2, "Ünïcode é"), (3, "one TWO three"), (None, "one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(
        [(c, t, r, x) for c in (0, 1, 7, 100, 101, 250) for t, r, x in
         [(None, "user", "hi"), (1, None, "é🎉"), (2, "user", None)][: 1 + c % 3]]
        + [(None, 1, "user", "x"), (1, 5, "b", "two"), (1, 5, "a", "one"), (7, 1, None, "é🎉")],
        "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    _compare(spark, name, str(tmp_path))
