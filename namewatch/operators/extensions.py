"""Operators the reference's documents describe but its code does not build (E1-E7);
ours, built on the same mention table ``m``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewatch.operators import report as R


def cross_recurrence(m: DataFrame) -> DataFrame:
    """Recurrence across prompts and models: per not-found (ecosystem, name), the
    distinct prompts, models and (model, prompt, run) triples it appeared in."""
    nf = m.filter(F.col("status") == "not_found").select(
        "ecosystem", "name", "model_id", "prompt_id", "run_index").distinct()
    known = F.col("model_id").isNotNull() & F.col("prompt_id").isNotNull() & \
        F.col("run_index").isNotNull()
    # two levels, first one row per name and prompt and per name and model, so that no name's
    # prompts are in one buffer; both from one pass over the mentions
    either = F.explode(F.array(
        F.struct(F.lit(True).alias("prompt"), F.col("prompt_id").cast("string").alias("value"),
                 known.alias("known")),
        F.struct(F.lit(False).alias("prompt"), F.col("model_id").cast("string").alias("value"),
                 F.lit(False).alias("known"))))
    values = nf.select("ecosystem", "name", either.alias("x")).groupBy(
        "ecosystem", "name", "x.prompt", "x.value").agg(F.count_if("x.known").alias("runs"))
    has = F.col("value").isNotNull()
    return values.groupBy("ecosystem", "name").agg(
        F.count_if(has & F.col("prompt")).alias("prompts"),
        F.count_if(has & ~F.col("prompt")).alias("models"), F.sum("runs").alias("runs"))


def rates_grouping_sets(m: DataFrame) -> DataFrame:
    """Checkable / confirmed / review counts by model, specificity, ecosystem and
    domain in one pass (GROUPING SETS): one scan of ``m`` instead of four."""
    g = m.groupingSets(
        [["model_id"], ["specificity"], ["ecosystem"], ["domain"]],
        "model_id", "specificity", "ecosystem", "domain",
    ).agg(
        F.count_if(R.is_checkable()).alias("checkable"),
        F.count_if(R.is_confirmed()).alias("confirmed"),
        F.count_if(R.is_review()).alias("needs_review"),
        F.grouping_id().alias("gid"),
    )
    dim = (
        F.when(F.col("gid") == 7, "model_id")
        .when(F.col("gid") == 11, "specificity")
        .when(F.col("gid") == 13, "ecosystem")
        .otherwise("domain")
    )
    value = F.coalesce("model_id", "specificity", "ecosystem", "domain")
    return g.select(
        dim.alias("dimension"), value.alias("value"), "checkable", "confirmed", "needs_review",
        F.try_divide(F.col("confirmed"), F.col("checkable")).alias("confirmed_rate"),
    )


def strict_rates(runs: DataFrame, m: DataFrame) -> DataFrame:
    """The per-model report with prose mentions excluded."""
    return R.per_model(runs, m.filter(F.col("origin") == "code_block"))


def untruncated_rates(runs: DataFrame, m: DataFrame) -> DataFrame:
    """The per-model report without truncated responses (denominators included)."""
    keep = ~F.coalesce(F.col("truncated"), F.lit(False))
    return R.per_model(runs.filter(keep), m.filter(keep))


def recurrence_redacted(rec: DataFrame, key: str) -> DataFrame:
    """Aggregate-only publication: the name replaced by a keyed hash."""
    return rec.select(
        "model_id", "prompt_id", "ecosystem", R.redacted_name(key).alias("name_sha256"),
        "appearances", "runs", "recurrence_rate", "status",
    )


def by_resolved_model(m: DataFrame) -> DataFrame:
    """Rates by (model_id, resolved_model)."""
    return (
        m.groupBy("model_id", "resolved_model")
        .agg(
            F.count(F.lit(1)).alias("mentions"),
            F.count_if(R.is_checkable()).alias("checkable"),
            F.count_if(R.is_confirmed()).alias("confirmed"),
        )
        .select("*", F.try_divide(F.col("confirmed"), F.col("checkable")).alias("confirmed_rate"))
    )
