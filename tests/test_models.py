"""Model-call outcomes from attempt logs: transient failures retry, terminal ones stop,
quota exhaustion is terminal even on 429, truncation is provider-specific."""

from __future__ import annotations

import datetime as dt

from namewatch import schemas
from namewatch.operators import calls as C

T0 = dt.datetime(2026, 1, 1)


def _log(spark, attempts, provider="anthropic"):
    rows = []
    for i, (exc, code, status, msg, stop) in enumerate(attempts, start=1):
        rows.append((1, "m", "p", 0, i, provider, exc, code, status, msg, stop, 0.5 * i, T0))
    return spark.createDataFrame(rows, schemas.CALLS)


def _reduce(spark, attempts, provider="anthropic", retries=2):
    return C.reduce_calls(_log(spark, attempts, provider), retries).first()


OK = (None, None, None, None, "end_turn")


def test_success(spark):
    r = _reduce(spark, [OK])
    assert r["ok"] and r["error"] is None and r["latency_s"] == 0.5


def test_transient_then_success(spark):
    r = _reduce(spark, [("RateLimitError", None, 429, "slow down", None), OK])
    assert r["ok"] and r["deciding_attempt"] == 2 and r["latency_s"] == 1.0


def test_terminal_stops(spark):
    r = _reduce(spark, [("BadRequestError", None, 400, "bad", None), OK])
    assert not r["ok"] and r["error"] == "BadRequestError: bad"


def test_quota_429_is_terminal(spark):
    r = _reduce(spark, [("RateLimitError", "insufficient_quota", 429, "quota", None), OK])
    assert not r["ok"] and r["deciding_attempt"] == 1
    r = _reduce(spark, [("RateLimitError", None, 429, "credit_balance_exhausted now", None), OK])
    assert not r["ok"]


def test_retries_exhausted(spark):
    t = ("InternalServerError", None, 503, "x" * 400, None)
    r = _reduce(spark, [t, t, t, OK])
    assert not r["ok"] and r["deciding_attempt"] == 3
    assert r["error"] == "InternalServerError: " + "x" * 300


def test_truncation_is_provider_specific(spark):
    assert _reduce(spark, [(None, None, None, None, "max_tokens")])["truncated"]
    assert not _reduce(spark, [(None, None, None, None, "length")])["truncated"]
    assert _reduce(spark, [(None, None, None, None, "length")], provider="openai")["truncated"]


def test_response_assemble(spark):
    parts = spark.createDataFrame(
        [(1, 0, "thinking", "hmm "), (1, 1, "text", "Hello "), (1, 2, "text", "world"),
         (2, 0, "text", None)],
        "response_id long, part_idx int, type string, text string")
    got = {r["response_id"]: (r["text"], r["thinking"]) for r in C.response_assemble(parts).collect()}
    assert got == {1: ("Hello world", "hmm "), 2: ("", None)}
