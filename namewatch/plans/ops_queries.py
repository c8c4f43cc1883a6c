"""Registered queries: sweep, lookups, call logs, corpus checks, extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewatch.operators import calls as C
from namewatch.operators import extensions as E
from namewatch.operators import extract as X
from namewatch.operators import lookups as L
from namewatch.operators import quality as Q
from namewatch.operators import report as R
from namewatch.operators import sweep as SW
from namewatch.sources import files as FS
from namewatch.sources import fixtures as FX

RUNS_PER_PROMPT = 20
# Key of the redacted recurrence table here; a publisher keeps its own secret.
REDACTION_KEY = "example-key"
PROMPT_LIMIT = 10
# History before this instant is the "previous" lookup pass in the derived attempt log.
CUT = "1998-06-01 00:00:00"
# The instant the later pass's snapshot is stamped with.
LATER = "2002-01-01 00:00:00"


def _plan(s: SparkSession, sf: str) -> DataFrame:
    return SW.sweep_plan(FX.models(s, sf), FX.prompts(s, sf), RUNS_PER_PROMPT)


def _records(s: SparkSession, sf: str) -> DataFrame:
    r = FX.runs(s, sf)
    o = FX.read_table(s, sf, "orders").select(
        F.col("o_orderkey").alias("response_id"),
        (F.col("o_totalprice") / 7919.0).alias("latency_s"),
    )
    return r.join(o, "response_id")


def _snapshot(s: SparkSession, sf: str, part: str | None = None) -> DataFrame:
    """R2 over the derived attempt log: all of it, or the lookup pass before / after CUT."""
    a = FX.attempts(s, sf)
    cut = F.lit(CUT).cast("timestamp_ntz")
    if part == "before":
        a = a.filter(F.col("checked_at") < cut)
    elif part == "after":
        a = a.filter(F.col("checked_at") >= cut)
    return L.reduce_attempts(a, order=["checked_at", "batch", "attempt"])


def _cache(s: SparkSession, sf: str) -> DataFrame:
    """The cache after the earlier pass, then the later pass put into it."""
    cols = ["ecosystem", "name", "status", "http_status", "detail", "checked_at"]
    old = _snapshot(s, sf, "before").filter(L.is_definitive(F.col("status"))).select(*cols)
    put = L.cache_put(old, _snapshot(s, sf, "after"))
    # read twice by its users (its own latest check time is their instant)
    path = FS.scratch_path(s, "cache")
    put.write.parquet(path)
    return s.read.schema(put.schema).parquet(path)


def _as_of(cache: DataFrame):
    """The cache's own latest check time (a scalar subquery): an explicit instant derived
    from the data, never the wall clock."""
    return cache.agg(F.max("checked_at")).scalar()


def cache_fresh(s, sf):
    c = _cache(s, sf)
    return c.select("ecosystem", "name", "status", "checked_at",
                    L.cache_fresh(c, _as_of(c)).alias("fresh"))


def cache_split(s, sf):
    c = _cache(s, sf)
    names = L.unique_names(FX.mentions(s, sf))
    return L.cache_split(names, c, _as_of(c))


def _m(s, sf):
    return R.mention_status(FX.mentions(s, sf), FX.names(s, sf))


QUERIES = {
    # sweep (J4-J7, A14, R8, R9, P7, O4)
    "plan_enabled": lambda s, sf: SW.enabled_models(FX.models(s, sf)).select("id", "provider", "model"),
    "sweep_plan": _plan,
    "plan_limited": lambda s, sf: SW.limit_prompts(FX.prompts(s, sf), PROMPT_LIMIT).select(
        "id", "ecosystem", "domain", "specificity", "ord"),
    "completed_keys": lambda s, sf: SW.completed_keys(FX.runs(s, sf)),
    "resume_pending": lambda s, sf: SW.resume_pending(
        _plan(s, sf), SW.completed_keys(FX.runs(s, sf))).select(*SW.TASK_KEY),
    "resume_done": lambda s, sf: SW.resume_done(_plan(s, sf), SW.completed_keys(FX.runs(s, sf))),
    "records_enriched": lambda s, sf: SW.records_enriched(
        _records(s, sf).drop("ecosystem", "domain", "specificity"), FX.prompts(s, sf),
        FX.models(s, sf)),
    "sweep_summary": lambda s, sf: SW.sweep_summary(
        _plan(s, sf),
        SW.completed_keys(FX.runs(s, sf).filter(F.col("run_id") == "sweep-0")),
        FX.runs(s, sf).filter(F.col("run_id") != "sweep-0")),
    # lookups (R1-R3, J8, J10, W1, W2, A15-A17, A20, S10, E5)
    "classify_http": lambda s, sf: FX.attempts(s, sf).groupBy(
        "http_status", L.classify_http(F.col("http_status")).alias("status")).agg(
        F.count(F.lit(1)).alias("n")),
    "reduce_attempts": lambda s, sf: _snapshot(s, sf),
    "cache_fresh": cache_fresh,
    "latest_status": lambda s, sf: L.latest_status(
        FX.attempts(s, sf).select(
            "ecosystem", "name", L.classify_http(F.col("http_status")).alias("status"),
            "http_status", "checked_at", "batch", "attempt"),
        order=["checked_at", "batch", "attempt"]).drop("batch", "attempt"),
    "cache_put": _cache,
    "cache_split": cache_split,
    "cache_stats": lambda s, sf: L.cache_stats(cache_split(s, sf)),
    "unique_names": lambda s, sf: L.unique_names(FX.mentions(s, sf)),
    "dedupe_first_seen": lambda s, sf: L.dedupe_first_seen(
        X.mentions_of(X.extract_resolved(FX.responses(s, sf), X.Vocabulary.default(s))),
        ["response_id", *X.POS]),
    "status_counts": lambda s, sf: L.status_counts(_snapshot(s, sf)),
    "check_summary": lambda s, sf: L.check_summary(_snapshot(s, sf)),
    "check_ambiguous": lambda s, sf: L.check_ambiguous(
        _snapshot(s, sf), X.Vocabulary.default(s).aliases),
    "status_transitions": lambda s, sf: L.status_transitions(
        _snapshot(s, sf, "before").withColumn("snapshot_at", F.lit(CUT).cast("timestamp_ntz"))
        .unionByName(_snapshot(s, sf, "after").withColumn(
            "snapshot_at", F.lit(LATER).cast("timestamp_ntz")))
    ),
    # call logs
    "classify_call_error": lambda s, sf: C.classified_calls(FX.calls(s, sf)).groupBy(
        "exc_type", "error_code", "status_code", "message", "outcome").agg(
        F.count(F.lit(1)).alias("n")),
    "reduce_calls": lambda s, sf: C.reduce_calls(FX.calls(s, sf)),
    "truncated_flag": lambda s, sf: FX.calls(s, sf).filter(F.col("status_code").isNull()).groupBy(
        "provider", "stop_reason",
        C.truncated_flag(F.col("provider"), F.col("stop_reason")).alias("truncated")).agg(
        F.count(F.lit(1)).alias("n")),
    "response_assemble": lambda s, sf: C.response_assemble(FX.content_parts(s, sf)),
    # corpus (Q1-Q4, S3, A19)
    "dq_prompts": lambda s, sf: Q.dq_prompts(FX.prompt_corpus(s, sf)),
    "corpus_summary": lambda s, sf: Q.corpus_summary(FX.prompts(s, sf)),
    # document-only extensions
    "cross_recurrence": lambda s, sf: E.cross_recurrence(_m(s, sf)),
    "by_domain": lambda s, sf: R.rates_by(_m(s, sf), "domain"),
    "rates_grouping_sets": lambda s, sf: E.rates_grouping_sets(_m(s, sf)),
    "strict_rates": lambda s, sf: E.strict_rates(FX.runs(s, sf), _m(s, sf)),
    "untruncated_rates": lambda s, sf: E.untruncated_rates(FX.runs(s, sf), _m(s, sf)),
    "recurrence_redacted": lambda s, sf: E.recurrence_redacted(R.recurrence_preaggregated(
        FX.mentions(s, sf), FX.names(s, sf), R.cell_runs(FX.runs(s, sf)), ordered=False),
        REDACTION_KEY),
    "by_resolved_model": lambda s, sf: E.by_resolved_model(
        R.mention_status(
            FX.mentions(s, sf).withColumn("resolved_model", FX.resolved_model_of(
                F.col("model_id"), F.col("created_at"))),
            FX.names(s, sf))),
}
