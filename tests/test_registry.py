"""Lookup outcomes from attempt logs: an error is never a negative; definitive results
are cached, errors never; both positives and negatives expire."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from namewatch import schemas
from namewatch.functions import text as TX
from namewatch.operators import lookups as L

T0 = dt.datetime(2026, 1, 1)


def _attempts(spark, rows):
    return spark.createDataFrame(
        [(e, n, a, s, d, T0 + dt.timedelta(seconds=a)) for e, n, a, s, d in rows],
        schemas.ATTEMPTS)


def _one(spark, statuses):
    rows = [("python", "x", i, s, None if s else "ConnectTimeout") for i, s in enumerate(statuses)]
    return L.reduce_attempts(_attempts(spark, rows)).first()


def test_200_exists_404_not_found(spark):
    assert _one(spark, [200])["status"] == "exists"
    assert _one(spark, [404])["status"] == "not_found"


def test_retryable_then_decisive(spark):
    r = _one(spark, [503, 200])
    assert (r["status"], r["http_status"]) == ("exists", 200)


def test_rate_limit_exhausted_is_error_not_negative(spark):
    r = _one(spark, [429, 429, 429, 429])
    assert (r["status"], r["http_status"], r["detail"]) == ("error", 429, "HTTP 429")


def test_non_retryable_stops(spark):
    r = _one(spark, [403, 200])
    assert (r["status"], r["http_status"]) == ("error", 403)


def test_network_failure_is_error(spark):
    r = _one(spark, [None, None])
    assert (r["status"], r["http_status"], r["detail"]) == ("error", None, "ConnectTimeout")


def test_cache_put_skips_errors_and_latest_wins(spark):
    cache = spark.createDataFrame(
        [("python", "a", "not_found", 404, None, T0)], schemas.LOOKUP_CACHE)
    new = spark.createDataFrame(
        [("python", "a", "exists", 200, None, T0 + dt.timedelta(days=1)),
         ("python", "b", "error", 503, "HTTP 503", T0)], schemas.LOOKUP_CACHE)
    out = {r["name"]: r["status"] for r in L.cache_put(cache, new).collect()}
    assert out == {"a": "exists"}


def test_cache_freshness_expires_both(spark):
    cache = spark.createDataFrame(
        [("python", "old", "exists", 200, None, T0),
         ("python", "neg", "not_found", 404, None, T0),
         ("python", "new", "not_found", 404, None, T0 + dt.timedelta(days=9))],
        schemas.LOOKUP_CACHE)
    as_of = F.lit(T0 + dt.timedelta(days=10))
    names = spark.createDataFrame([("python", "old"), ("python", "neg"), ("python", "new"),
                                   ("python", "never")], "ecosystem string, name string")
    split = {r["name"]: r["from_cache"] for r in L.cache_split(names, cache, as_of).collect()}
    assert split == {"old": False, "neg": False, "new": True, "never": False}
    stats = L.cache_stats(L.cache_split(names, cache, as_of)).first()
    assert (stats["hits"], stats["misses"]) == (1, 3)
    refresh = L.cache_split(names, cache, as_of, refresh=True)
    assert refresh.filter("from_cache").count() == 0


def test_scoped_npm_url_encoding(spark):
    df = spark.createDataFrame([("javascript", "@types/node"), ("javascript", "express"),
                                ("python", "a/b")], "ecosystem string, name string")
    got = {r["name"]: (r["k"], r["u"]) for r in df.select(
        "name", TX.registry_lookup_key(F.col("ecosystem"), F.col("name")).alias("k"),
        TX.registry_url(F.col("ecosystem"), F.col("name")).alias("u")).collect()}
    assert got["@types/node"] == ("@types%2Fnode", "https://registry.npmjs.org/@types%2Fnode")
    assert got["express"][1] == "https://registry.npmjs.org/express"
    assert got["a/b"] == ("a/b", "https://pypi.org/pypi/a/b/json")


def test_first_seen_and_latest(spark):
    rows = spark.createDataFrame(
        [("python", "a", 2, "x"), ("python", "a", 1, "y"), ("python", "b", 5, "z")],
        "ecosystem string, name string, pos int, v string")
    first = {r["name"]: r["pos"] for r in L.dedupe_first_seen(rows, ["pos"]).collect()}
    assert first == {"a": 1, "b": 5}
