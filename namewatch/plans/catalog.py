"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables under ``sf_dir`` (through the derivations in
``namewatch.sources.fixtures``) and runs over them whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewatch.fixed_values import TOP_K_CONSOLE
from namewatch.operators import increments as INC
from namewatch.operators import report as R
from namewatch.sources import files as FS
from namewatch.sources import fixtures as FX

Query = Callable[[SparkSession, str], DataFrame]


def _m(spark: SparkSession, sf: str) -> DataFrame:
    return R.mention_status(FX.mentions(spark, sf), FX.names(spark, sf))


def _rec(spark: SparkSession, sf: str, ordered: bool = True, modulus: int = 400) -> DataFrame:
    """Recurrence from pre-aggregated mentions (distinct cell-name-run rows before the
    registry semi join). ``modulus`` sets how many distinct names the derived mentions
    use; 40 makes names recur in every run of a cell."""
    return R.recurrence_preaggregated(FX.mentions(spark, sf, modulus), FX.names(spark, sf, modulus),
                                      R.cell_runs(FX.runs(spark, sf)), ordered=ordered)


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    """Recurrence of three sweeps whose bits were written one after another and merged; the
    last part holds runs that the parts before have too."""
    path = FS.scratch_path(spark, "recurrence-bits")
    runs, mentions = FX.runs(spark, sf), FX.mentions(spark, sf)
    for sweeps in (["sweep-0"], ["sweep-1"], ["sweep-1", "sweep-2"]):
        part = F.col("run_id").isin(sweeps)
        INC.mention_bits(mentions.filter(part)).write.mode("append").parquet(f"{path}/mentions")
        INC.cell_bits(runs.filter(part)).write.mode("append").parquet(f"{path}/cells")
    return INC.recurrence_of_bits(spark.read.parquet(f"{path}/mentions"),
                                  spark.read.parquet(f"{path}/cells"), FX.names(spark, sf),
                                  ordered=True)


WIDE = 1_000_000_000     # more names than parts: names are not folded

REPORT: dict[str, Query] = {
    "ok_runs": lambda s, sf: R.ok_runs(FX.runs(s, sf)).select(
        "response_id", "model_id", "prompt_id", "run_index"
    ),
    "mentions": lambda s, sf: R.mention_projection(FX.mentions(s, sf)),
    "mention_status": lambda s, sf: _m(s, sf).select(
        "model_id", "prompt_id", "run_index", "ecosystem", "name", "source", "origin",
        "alias_resolved", "status",
    ),
    "checkable_mentions": lambda s, sf: _m(s, sf).filter(R.is_checkable()).select(
        "model_id", "prompt_id", "run_index", "ecosystem", "name", "status"
    ),
    "confirmed_mentions": lambda s, sf: _m(s, sf).filter(R.is_confirmed()).select(
        "model_id", "prompt_id", "run_index", "ecosystem", "name"
    ),
    "review_mentions": lambda s, sf: _m(s, sf).filter(R.is_review()).select(
        "model_id", "prompt_id", "run_index", "ecosystem", "name"
    ),
    "undetermined_mentions": lambda s, sf: _m(s, sf).filter(R.is_undetermined()).select(
        "model_id", "prompt_id", "run_index", "ecosystem", "name", "status"
    ),
    "cell_runs": lambda s, sf: R.cell_runs(FX.runs(s, sf)),
    "recurrence": lambda s, sf: _rec(s, sf),
    "recurrence_merged": _merged,
    # a registry that grows with the data: a name for every part
    "recurrence_wide": lambda s, sf: _rec(s, sf, ordered=False, modulus=WIDE),
    "mention_status_wide": lambda s, sf: R.mention_status(
        FX.mentions(s, sf, WIDE), FX.names(s, sf, WIDE)).groupBy("name", "status").agg(
        F.count(F.lit(1)).alias("n")),
    "recurrence_summary": lambda s, sf: R.recurrence_summary(_rec(s, sf, ordered=False)),
    "needs_review": lambda s, sf: R.needs_review_names(_rec(s, sf, ordered=False)),
    "recurrence_dense": lambda s, sf: _rec(s, sf, modulus=40),
    "recurrence_summary_dense": lambda s, sf: R.recurrence_summary(
        _rec(s, sf, ordered=False, modulus=40)),
    "top_recurring": lambda s, sf: R.top_recurring(_rec(s, sf, ordered=False)),
    "top_recurring_console": lambda s, sf: R.top_recurring(
        _rec(s, sf, ordered=False), TOP_K_CONSOLE),
    "recurrence_csv": lambda s, sf: R.recurrence_csv_rows(_rec(s, sf, ordered=False)),
    "totals": lambda s, sf: R.totals(FX.runs(s, sf), _m(s, sf)),
    "ok_by_model": lambda s, sf: R.ok_by_model(FX.runs(s, sf)),
    "halluc_responses": lambda s, sf: R.halluc_responses(_m(s, sf)),
    "model_mentions": lambda s, sf: R.model_mentions(_m(s, sf)),
    "per_model": lambda s, sf: R.per_model(FX.runs(s, sf), _m(s, sf)),
    "by_specificity": lambda s, sf: R.by_specificity(_m(s, sf)),
    "by_ecosystem": lambda s, sf: R.by_ecosystem(_m(s, sf)),
    "caveats": lambda s, sf: R.caveats(FX.runs(s, sf), _m(s, sf)),
}


def all_queries() -> dict[str, Query]:
    from namewatch.plans.extraction_queries import QUERIES as EXTRACTION
    from namewatch.plans.file_queries import QUERIES as FILES
    from namewatch.plans.ops_queries import QUERIES as OPS
    from namewatch.plans.record_queries import QUERIES as RECORDS
    from namewatch.plans.stream_queries import QUERIES as STREAMS

    out: dict[str, Query] = {}
    out.update(REPORT)
    out.update(EXTRACTION)
    out.update(OPS)
    out.update(FILES)
    out.update(RECORDS)
    out.update(STREAMS)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrence, the headline metric."""
    return _rec(spark, sf_dir)


__all__ = ["all_queries", "flagship"]
