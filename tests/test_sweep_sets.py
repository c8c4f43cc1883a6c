"""Planning, resuming and caching as set operations on made-up rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from namewatch.operators import calls as C
from namewatch.operators import lookups as L
from namewatch.operators import sweep as SW

KEYS = "prompt_id string, model_id string, run_index int"


def _plan(spark, runs=2):
    models = spark.createDataFrame([("m2", True), ("m1", True), ("off", False)],
                                   "id string, enabled boolean")
    prompts = spark.createDataFrame(
        [("q1", "python", "d", "vague", 0), ("q2", "javascript", "d", "niche", 1)],
        "id string, ecosystem string, domain string, specificity string, ord int")
    return models, prompts, SW.sweep_plan(models, prompts, runs)


def test_plan_is_every_enabled_combination(spark):
    _, _, plan = _plan(spark)
    got = sorted((r["prompt_id"], r["model_id"], r["run_index"]) for r in plan.collect())
    assert got == [(q, m, i) for q in ("q1", "q2") for m in ("m1", "m2") for i in (0, 1)]
    assert _plan(spark, 0)[2].count() == 0


def test_plan_without_enabled_models_is_empty(spark):
    models, prompts, _ = _plan(spark)
    assert SW.sweep_plan(models.where("NOT enabled"), prompts, 3).count() == 0
    assert SW.sweep_plan(models, prompts, 3, "m1").count() == 6


def test_resume(spark):
    _, _, plan = _plan(spark)
    records = spark.createDataFrame([("q1", "m1", 0, True), ("q1", "m1", 1, False),
                                     ("q1", "m1", 0, True), ("gone", "m1", 0, True)],
                                    KEYS + ", ok boolean")
    done = SW.completed_keys(records)
    assert done.count() == 2
    assert SW.resume_pending(plan, done).count() == 7
    assert SW.resume_done(plan, done).first()["done"] == 1


def test_records_of_unknown_prompts_and_models_stay(spark):
    models, prompts, _ = _plan(spark)
    models = models.withColumns({"model": F.lit("alias"), "provider": F.lit("p")})
    records = spark.createDataFrame(
        [("s", "q1", "m1", 0, True, False, 1.23456, dt.datetime(2024, 1, 1)),
         ("s", "gone", "m1", 0, True, False, 1.0, dt.datetime(2024, 1, 1)),
         ("s", "q1", "gone", 0, True, False, 1.0, dt.datetime(2024, 1, 1))],
        "run_id string, prompt_id string, model_id string, run_index int, ok boolean, "
        "truncated boolean, latency_s double, created_at timestamp")
    got = {(r["prompt_id"], r["model_id"]): (r["domain"], r["provider"], r["latency_s"])
           for r in SW.records_enriched(records, prompts, models).collect()}
    assert got == {("q1", "m1"): ("d", "p", 1.235), ("gone", "m1"): (None, "p", 1.0),
                   ("q1", "gone"): ("d", None, 1.0)}


def test_later_put_wins_and_errors_are_never_written(spark):
    schema = ("ecosystem string, name string, status string, http_status int, detail string, "
              "checked_at timestamp")
    day = lambda n: dt.datetime(2024, 1, n)
    old = spark.createDataFrame([("python", "a", "exists", 200, None, day(9)),
                                 ("python", "b", "exists", 200, None, day(9))], schema)
    new = spark.createDataFrame([("python", "a", "not_found", 404, "x", day(5)),
                                 ("python", "b", "error", 500, "y", day(10)),
                                 ("python", "c", "not_found", 404, None, day(1)),
                                 ("python", "c", "exists", 200, None, day(2))], schema)
    put = L.cache_put(old, new)
    assert {r["name"]: (r["status"], r["checked_at"].day) for r in put.collect()} == {
        "a": ("not_found", 5), "b": ("exists", 9), "c": ("exists", 2)}
    names = spark.createDataFrame([("python", n) for n in "abcd"], "ecosystem string, name string")
    split = L.cache_split(names, put, F.lit(day(10)), max_age_days=6)
    assert {r["name"]: (r["from_cache"], r["status"], r["http_status"], r["detail"])
            for r in split.collect()} == {
        "a": (True, "not_found", 404, "x"), "b": (True, "exists", 200, None),
        "c": (False, None, None, None), "d": (False, None, None, None)}


def test_attempts_beyond_the_limit_are_counted_not_used(spark):
    schema = ("call_id long, model_id string, prompt_id string, run_index int, attempt int, "
              "exc_type string, error_code string, status_code int, message string, "
              "latency_s double, stop_reason string, provider string")
    row = lambda call, attempt, status, message=None: (
        call, "m", "p", 0, attempt, None, None, status, message, 1.0, "end", "openai")
    log = spark.createDataFrame(
        [row(1, 1, None), row(2, 4, None), row(2, 5, None), row(3, 1, 400, "no"),
         row(4, 1, None), row(4, 9, None)], schema)
    got = {r["call_id"]: (r["ok"], r["error"], r["attempts"], r["ignored_attempts"])
           for r in C.reduce_calls(log).collect()}
    assert got == {1: (True, None, 1, 0), 2: (False, C.NO_ALLOWED_ATTEMPT, 0, 2),
                   3: (False, "Error: no", 1, 0), 4: (True, None, 1, 1)}
