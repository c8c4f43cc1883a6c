"""Rates and recurrence on a small made-up sweep; every number follows from the definitions.

Two models answer one prompt: ``north`` four times (once failing), ``south`` twice. Statuses:
``real`` exists, ``gone`` and ``lost`` are not found, ``shaky`` errored, ``new`` is unchecked.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from namewatch.operators import report as R
from namewatch.sources import files as FS

RUNS = [
    # model, run index, ok, truncated
    ("north", 0, True, False), ("north", 1, True, True), ("north", 2, True, False),
    ("north", 3, False, False), ("south", 0, True, False), ("south", 1, True, False),
]
MENTIONS = [
    # model, run index, ecosystem, name, alias flag
    ("north", 0, "python", "real", True), ("north", 0, "python", "gone", None),
    ("north", 0, "python", "gone", None), ("north", 1, "python", "gone", True),
    ("north", 1, "python", "lost", False), ("north", 2, "python", "shaky", None),
    ("north", 2, "javascript", "lost", None), ("south", 0, "python", "new", None),
    ("south", 1, "python", "real", None),
]
STATUS = [("python", "real", "exists"), ("python", "gone", "not_found"),
          ("python", "lost", "not_found"), ("python", "shaky", "error"),
          ("javascript", "lost", "not_found")]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(
        [("s", "p", "python", "d", "vague", *r) for r in RUNS],
        "run_id string, prompt_id string, ecosystem string, domain string, specificity string, "
        "model_id string, run_index long, ok boolean, truncated boolean")


@pytest.fixture(scope="module")
def m(spark):
    rows = [("s", "p", "d", "vague", "code_block", "install", *x) for x in MENTIONS]
    mentions = spark.createDataFrame(
        rows, "run_id string, prompt_id string, domain string, specificity string, "
              "origin string, source string, model_id string, run_index long, "
              "ecosystem string, name string, alias_resolved boolean")
    registry = spark.createDataFrame(STATUS, "ecosystem string, name string, status string")
    return R.mention_status(mentions, registry)


@pytest.fixture(scope="module")
def rec(runs, m):
    return R.recurrence(m, R.cell_runs(runs), ordered=False)


def test_counts(runs, m):
    assert R.totals(runs, m).first().asDict() == {
        "records": 6, "ok": 5, "failed": 1, "truncated": 1, "undetermined_mentions": 2}


def test_rates_by_model(runs, m):
    rows = {r["model_id"]: r.asDict() for r in R.per_model(runs, m).collect()}
    north, south = rows["north"], rows["south"]
    # seven mentions; all but shaky are checkable; gone x3 and javascript lost are confirmed
    assert (north["ok_responses"], north["mentions"], north["checkable"]) == (3, 7, 6)
    assert (north["confirmed"], north["needs_review"], north["distinct_confirmed"]) == (4, 1, 2)
    assert north["confirmed_rate"] == pytest.approx(4 / 6)
    assert (north["responses_with_halluc"], north["response_rate"]) == (3, pytest.approx(1.0))
    assert (south["mentions"], south["checkable"], south["confirmed"]) == (2, 1, 0)
    assert (south["responses_with_halluc"], south["response_rate"]) == (0, 0.0)


def test_recurrence(rec):
    rows = {(r["ecosystem"], r["name"]): r for r in rec.collect()}
    assert set(rows) == {("python", "gone"), ("python", "lost"), ("javascript", "lost")}
    gone = rows["python", "gone"]       # runs 0 and 1 of three
    assert (gone["appearances"], gone["runs"], gone["status"]) == (2, 3, "confirmed")
    assert gone["recurrence_rate"] == pytest.approx(2 / 3)
    assert rows["python", "lost"]["status"] == "needs_review"
    assert rows["javascript", "lost"]["status"] == "confirmed"


def test_preaggregated_recurrence_agrees(runs, m, rec, spark):
    registry = spark.createDataFrame(STATUS, "ecosystem string, name string, status string")
    other = R.recurrence_preaggregated(m.drop("status"), registry, R.cell_runs(runs), False)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, rec.collect()))


def test_summary_and_review(rec):
    assert R.recurrence_summary(rec).first().asDict() == {
        "cells": 3, "one_off": 2, "recurring_2plus": 1, "majority": 1, "every_run": 0}
    assert [tuple(r) for r in R.needs_review_names(rec).collect()] == [("python", "lost")]


def test_caveats(runs, m):
    got = {r["caveat"]: r["n"] for r in R.caveats(runs, m).collect()}
    assert got == {"failed": 1, "truncated": 1, "undetermined_mentions": 2, "needs_review": 1}


def test_top_and_csv(rec, spark, tmp_path):
    assert R.top_recurring(rec, 1).first()["name"] == "gone"
    R.write_recurrence_csv(rec, str(tmp_path / "csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert sorted((r["ecosystem"], r["name"], r["recurrence_rate"]) for r in rows) == [
        ("javascript", "lost", "0.3333"), ("python", "gone", "0.6667"),
        ("python", "lost", "0.3333")]


def test_statuses_only_move_between_their_counts(runs, m):
    """An errored check takes a name out of the rates; it never makes it a missing one."""
    worse = m.withColumn("status", F.when(F.col("name") == "gone", "error")
                         .otherwise(F.col("status")))
    row = {r["model_id"]: r for r in R.per_model(runs, worse).collect()}["north"]
    assert (row["checkable"], row["confirmed"], row["needs_review"]) == (3, 1, 1)


def test_report_sections(spark, tmp_path, runs, m):
    packages = m.groupBy("model_id", "run_index").agg(F.collect_list(F.struct(
        F.col("name").alias("raw"), "name", "ecosystem", "source", "origin",
        "alias_resolved")).alias("packages"))
    records = runs.join(packages, ["model_id", "run_index"], "left")
    registry = spark.createDataFrame(STATUS, "ecosystem string, name string, status string")
    sections = R.build_report(records, registry)
    assert set(sections) == set(R.REPORT_SECTIONS)
    assert sections["totals"].first()["records"] == 6


def test_versions_are_read_once_committed(spark, tmp_path):
    base = str(tmp_path / "table")
    FS.write_version(spark.range(3), base, 1)
    spark.range(9).write.parquet(f"{base}/version=2")       # written, not committed
    assert FS.read_current(spark, base).count() == 3
    FS.write_version(spark.range(5), base, 2)
    with pytest.raises(ValueError):
        FS.write_version(spark.range(4), base, 2)           # committed versions stay
    assert FS.read_current(spark, base).count() == 5
    FS.write_version(spark.range(2), base, 7)
    FS.write_version(spark.range(6), base, 3)               # the last commit, not the largest
    assert FS.read_current(spark, base).count() == 6
    assert FS.read_version(spark, base, 1).count() == 3
    with pytest.raises(ValueError):
        FS.read_version(spark, base, 5)
