"""The driver contract: entry() runs the flagship query; every registered query builds
and, for a sample, matches its oracle SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_entry_runs_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["model_id", "prompt_id", "ecosystem", "name", "appearances", "runs",
                          "recurrence_rate", "needs_review", "status"]
    assert df.count() == 814


def test_every_query_has_an_oracle_or_is_listed():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(qs) - set(E.CORPUS_QUERIES) <= set(sql)


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict(recursive=True).items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", ["recurrence", "per_model", "extract_mentions",
                                  "filtered_audit", "reduce_attempts", "reduce_calls",
                                  "dq_prompts", "js_manifest"])
def test_sample_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in res.fetchall())
    assert got == want
