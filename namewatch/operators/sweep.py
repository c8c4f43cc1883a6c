"""Sweep planning and resume as set operations.

A task is keyed (prompt_id, model_id, run_index). The plan is every enabled model x
prompt x run; resume is an anti join against the keys that already succeeded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_KEY = ["prompt_id", "model_id", "run_index"]

def enabled_models(models: DataFrame, model_id: str | None = None) -> DataFrame:
    """Enabled models, optionally restricted to one id."""
    m = models.filter(F.col("enabled"))
    return m.filter(F.col("id") == model_id) if model_id else m


def limit_prompts(prompts: DataFrame, n: int | None) -> DataFrame:
    """The first n prompts in file-then-entry order (``ord``)."""
    return prompts if n is None else prompts.orderBy("ord").limit(n)


def sweep_plan(models: DataFrame, prompts: DataFrame, runs_per_prompt: int,
               model_id: str | None = None) -> DataFrame:
    """Enabled models x prompts x range(runs_per_prompt), with the prompt attributes.

    The ids of the enabled models, sorted, are a scalar subquery, expanded per prompt row with
    ``explode``: the plan is generated where the prompts are, in parallel, without a join."""
    model_arr = F.coalesce(
        enabled_models(models, model_id).agg(F.array_sort(F.collect_set("id"))).scalar(),
        F.array().cast("array<string>"))
    runs = F.sequence(F.lit(0), F.lit(max(runs_per_prompt, 1) - 1)) if runs_per_prompt > 0 \
        else F.array().cast("array<int>")
    per_model = prompts.select(
        F.col("id").alias("prompt_id"), "ecosystem", "domain", "specificity",
        F.explode(model_arr).alias("model_id"),
    )
    return per_model.select(
        "prompt_id", "ecosystem", "domain", "specificity", "model_id",
        F.explode(runs).alias("run_index"),
    ).withColumn("run_index", F.col("run_index").cast("bigint"))


def completed_keys(records: DataFrame) -> DataFrame:
    """Keys of successful records; failed ones are gaps to retry."""
    return records.filter(F.col("ok")).select(*TASK_KEY).distinct()


def resume_pending(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """Planned tasks without a successful record."""
    return plan.join(completed, TASK_KEY, "left_anti")


def resume_done(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """How many planned tasks already succeeded."""
    return plan.join(completed, TASK_KEY, "left_semi").agg(F.count(F.lit(1)).alias("done"))


def records_enriched(records: DataFrame, prompts: DataFrame, models: DataFrame) -> DataFrame:
    """J7 + R8: each call record with its prompt's and model's attributes; latency rounded
    to 3 decimals. A record whose prompt or model has left the corpus keeps its row with NULL
    attributes. Prompts and models are dimensions (a join on their keys, which AQE
    broadcasts from their measured size)."""
    p = prompts.select(
        F.col("id").alias("prompt_id"), "ecosystem", "domain", "specificity"
    )
    m = models.select(F.col("id").alias("model_id"), F.col("model").alias("model_alias"),
                      "provider")
    return (
        records.join(p, "prompt_id", "left")
        .join(m, "model_id", "left")
        .select(
            "run_id", "prompt_id", "ecosystem", "domain", "specificity", "model_id",
            "model_alias", "provider", "run_index", "ok", "truncated", "created_at",
            F.round("latency_s", 3).alias("latency_s"),
        )
    )


def sweep_summary(plan: DataFrame, completed_before: DataFrame, new_records: DataFrame
                  ) -> DataFrame:
    """Total, skipped, attempted, ok, failed, truncated for one sweep pass."""
    totals = plan.agg(F.count(F.lit(1)).alias("total"))
    pending = resume_pending(plan, completed_before)
    pend = pending.agg(F.count(F.lit(1)).alias("pending"))
    attempted = new_records.join(pending.select(*TASK_KEY), TASK_KEY, "left_semi").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("ok")).alias("ok"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("truncated")).alias("truncated"),
    )
    long = (
        totals.select(F.lit("total").alias("k"), F.col("total").alias("v"))
        .unionByName(pend.select(F.lit("pending").alias("k"), F.col("pending").alias("v")))
        .unionByName(attempted.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("k"), F.col(c).alias("v"))
            for c in ["attempted", "ok", "failed", "truncated"]])).alias("kv")).select("kv.*"))
    )
    wide = long.groupBy().pivot("k", ["total", "pending", "attempted", "ok", "failed",
                                       "truncated"]).agg(F.first("v"))
    return wide.select(
        "total", (F.col("total") - F.col("pending")).alias("skipped"), "attempted", "ok",
        "failed", "truncated",
    )
