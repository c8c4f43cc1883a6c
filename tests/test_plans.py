"""Plan shape: the properties the design relies on at scale, read from explain()."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from namewatch.operators import extensions
from namewatch.plans import catalog
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture(scope="module")
def q():
    return catalog.all_queries()


def test_extraction_is_narrow_with_broadcast_vocabularies(spark, q):
    plan = _plan(q["extract_mentions"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan
    # the response text is never shuffled by key: no hash exchange anywhere
    assert "Exchange hashpartitioning" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["per_model", "strict_rates", "untruncated_rates", "caveats"])
def test_report_sections_read_mentions_and_registry_once(spark, q, name):
    plan = _plan(q[name](spark, SF_SMALL))
    assert plan.count("l_orderkey:bigint") == 1             # one scan of the mentions
    assert plan.count("p_partkey:bigint") == 1              # one registry join
    assert "Expand" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("name", ["filtered_audit", "response_names", "prose_note"])
def test_what_belongs_to_a_response_stays_in_its_row(spark, q, name):
    plan = _plan(q[name](spark, SF_SMALL))
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_records_move_no_texts(spark, q):
    """The small prompt and model tables are broadcast; the calls are not exchanged."""
    plan = _plan(q["build_records"](spark, SF_SMALL))
    for line in plan.splitlines():
        assert "Exchange" not in line or "response_text" not in line
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_reextraction_is_one_projection(spark):
    from namewatch.operators import extract as X
    from namewatch.operators import records as RC
    from namewatch import schemas
    records = spark.createDataFrame([], schemas.RUNS).withColumn("response_id", F.lit(1))
    plan = _plan(RC.reextract(records, X.Vocabulary.default(spark)))
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan
    diff = _plan(RC.reextraction_diff(records, records))
    assert not any("Exchange" in x and "response_text" in x for x in diff.splitlines())


def test_recurrence_prunes_pushes_and_preaggregates(spark, q):
    plan = _plan(q["recurrence"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linestatus:string>" in plan
    assert "PushedFilters: [IsNotNull(o_orderpriority), Not(EqualTo(o_orderpriority,5-LOW))" in plan
    # every exchange of the aggregation is fed by a partial (map-side) aggregate
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "HashAggregate" in lines[i + 1] or "Project" in lines[i + 1], line
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cross_recurrence_gathers_no_sets(spark, q):
    plan = _plan(q["cross_recurrence"](spark, SF_SMALL))
    assert "collect_set" not in plan and "Expand" not in plan and "ObjectHashAggregate" not in plan


def test_cross_recurrence_counts_with_nulls(spark):
    rows = [("e", "n", "m1", "p1", 1), ("e", "n", "m1", "p1", 1), ("e", "n", "m1", "p1", 2),
            ("e", "n", "m2", "p2", 1), ("e", "n", None, "p3", 1), ("e", "n", "m1", None, 1),
            ("e", "n", "m2", "p2", None), ("e", None, None, None, None), (None, "n", "m1", "p1", 1)]
    m = spark.createDataFrame([(*r, "not_found") for r in rows] + [("e", "x", "m1", "p1", 1, "found")],
                              "ecosystem string, name string, model_id string, prompt_id string, "
                              "run_index long, status string")
    got = {tuple(r) for r in extensions.cross_recurrence(m).collect()}
    assert got == {("e", "n", 3, 2, 3), ("e", None, 0, 0, 0), (None, "n", 1, 1, 1)}


@pytest.mark.parametrize("name", ["per_model", "cache_split", "reduce_attempts", "reduce_calls",
                                  "sweep_plan", "resume_pending", "totals", "dq_prompts"])
def test_no_cartesian_products(spark, q, name):
    plan = _plan(q[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["reduce_calls", "reduce_attempts"])
def test_lines_are_numbered_before_their_texts_are_derived(spark, q, name):
    """What is exchanged and sorted for the window has the table's columns only."""
    below = _plan(q[name](spark, SF_SMALL)).partition("Window [")[2]
    assert "row_number" in below and "RateLimitError" not in below and "HTTP " not in below


def test_reduced_calls_carry_no_whole_messages(spark):
    """What is sorted by task has an error's cut text, not the message it is cut from."""
    from namewatch import schemas
    from namewatch.operators import calls as C
    sorts = [x for x in _plan(C.reduce_calls(spark.createDataFrame([], schemas.CALLS))).splitlines()
             if "SortAggregate" in x]
    assert sorts and not any("message" in x for x in sorts)


@pytest.mark.parametrize("key, larger, most, smaller", [
    ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB", "8m", "16k"),
    ("spark.sql.autoBroadcastJoinThreshold", "10485760", "1m", "-1"),
    ("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB", "1m", "256k"),
])
def test_sizes_of_a_task_are_bounded(spark, key, larger, most, smaller):
    """Larger settings of the session are lowered; smaller ones stay."""
    from namewatch.session import apply_engine_conf
    before = spark.conf.get(key, None)
    try:
        for given, want in ((larger, most), (smaller, smaller)):
            spark.conf.set(key, given)
            assert apply_engine_conf(spark).conf.get(key) == want
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
