"""Analysis: mentions joined to registry status; rates and recurrence.

Definitions (held by every function here):

* a *mention* is one extracted name in one successful response (``ok`` true);
* *checkable* means status ``exists`` or ``not_found``; ``error`` and unchecked (NULL)
  are in neither numerator nor denominator;
* *confirmed* is ``not_found`` except Python names whose import was never mapped
  (``alias_resolved IS FALSE``), which are *needs review*.

Scale notes: ``mention_status`` is the one large join (mentions x registry on
(ecosystem, name)); AQE turns it into a broadcast when the registry's measured size is
small and otherwise splits hot names (skew join). Every aggregate below is a hash
aggregate with a map-side partial step, so a name that holds a third of all mentions
is combined per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch.fixed_values import CAVEATS, TOP_K_MARKDOWN

CELL = ["model_id", "prompt_id"]


# ------------------------------------------------------------------ predicates
def ok_runs(runs: DataFrame) -> DataFrame:
    """Successful calls only; a NULL ``ok`` is dropped like ``WHERE ok``."""
    return runs.filter(F.col("ok"))


def is_checkable(status: Column | None = None) -> Column:
    """A definitive status."""
    s = F.col("status") if status is None else status
    return s.isin("exists", "not_found")


def is_unmapped_python() -> Column:
    return (F.col("ecosystem") == "python") & F.col("alias_resolved").eqNullSafe(False)


def is_confirmed() -> Column:
    """not_found and not an unmapped Python import."""
    return (F.col("status") == "not_found") & ~is_unmapped_python()


def is_review() -> Column:
    """not_found and an unmapped Python import."""
    return (F.col("status") == "not_found") & is_unmapped_python()


def is_undetermined() -> Column:
    """P5: error, or never checked."""
    return (F.col("status") == "error") | F.col("status").isNull()


def review_label(needs_review: Column) -> Column:
    """The labelled status of a recurrence row."""
    return F.when(needs_review, "needs_review").otherwise("confirmed")


# ------------------------------------------------------------------ projections and joins
def mention_projection(mentions: DataFrame) -> DataFrame:
    """The run columns plus the mention fields the analysis reads."""
    return mentions.select(
        "run_id", "prompt_id", "ecosystem", "domain", "specificity", "model_id",
        "run_index", "name", "source", "origin", "alias_resolved",
    )


def explode_packages(runs: DataFrame) -> DataFrame:
    """Run records (with a ``packages`` array) -> one row per mention of an ok run.
    Inner explode: an empty list yields no row (B14). The mention's ecosystem is the
    run's, as in the analysis view."""
    return (
        ok_runs(runs)
        .select(
            "run_id", "prompt_id", "ecosystem", "domain", "specificity", "model_id",
            "run_index", "truncated", F.explode("packages").alias("pkg"),
        )
        .select(
            "run_id", "prompt_id", "ecosystem", "domain", "specificity", "model_id",
            "run_index", "truncated",
            F.col("pkg.name").alias("name"),
            F.col("pkg.source").alias("source"),
            F.col("pkg.origin").alias("origin"),
            F.col("pkg.alias_resolved").alias("alias_resolved"),
        )
    )


def mention_status(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach registry status; an unchecked name keeps a NULL status.

    The registry must hold one row per (ecosystem, name) (see ``latest_status``), since a
    duplicate would multiply mentions."""
    reg = registry.select("ecosystem", "name", "status")
    return mentions.join(reg, ["ecosystem", "name"], "left")


def mention_status_as_of(mentions: DataFrame, snapshots: DataFrame,
                         at: str = "created_at") -> DataFrame:
    """J1 at the time of the mention: the status that the latest snapshot up to then gives the
    name (``snapshots``: ecosystem, name, status, snapshot_at); NULL before its first one. Of
    entries of one instant the largest status holds.

    Each name's history is folded into one sorted array, one entry per snapshot that has the
    name, and equi-joined, so that a hot name is split like in any join; the entry is picked
    inside the row. There is no range join and no sort of the mentions."""
    entry = F.struct(F.col("snapshot_at").cast("timestamp").alias("at"), "status")
    history = snapshots.filter(F.col("snapshot_at").isNotNull()).groupBy("ecosystem", "name").agg(
        F.array_sort(F.collect_set(entry)).alias("nw_history"))
    then = F.col(at).cast("timestamp")
    up_to = F.filter("nw_history", lambda e: e["at"] <= then)
    return mentions.join(history, ["ecosystem", "name"], "left").withColumn(
        "status", F.try_element_at(up_to, F.lit(-1))["status"]).drop("nw_history")


def cell_runs(runs: DataFrame) -> DataFrame:
    """Distinct successful run indexes per (model, prompt) cell."""
    return ok_runs(runs).groupBy(*CELL).agg(F.count_distinct("run_index").alias("runs"))


# ------------------------------------------------------------------ aggregates
def totals(runs: DataFrame, m: DataFrame) -> DataFrame:
    """A1 + A2: one row of record counts and the undetermined mention count."""
    return totals_long(runs, m).groupBy().pivot(
        "metric", ["records", "ok", "failed", "truncated", "undetermined_mentions"]
    ).agg(F.first("value"))


def _long(row: DataFrame) -> DataFrame:
    """The columns of a one-row table as (metric, value) rows."""
    return row.select(F.explode(F.array(*(
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns)))
        .alias("kv")).select("kv.*")


def totals_long(runs: DataFrame, m: DataFrame) -> DataFrame:
    """The totals as (metric, value) rows: one pass over runs, one over mentions."""
    r = runs.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("ok")).alias("ok"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("truncated")).alias("truncated"),
    )
    u = m.agg(F.count_if(is_undetermined()).alias("undetermined_mentions"))
    return _long(r).unionByName(_long(u))


def ok_by_model(runs: DataFrame) -> DataFrame:
    """A3: successful responses per model (a row count, so a retried key counts twice)."""
    return ok_runs(runs).groupBy("model_id").agg(F.count(F.lit(1)).alias("ok_responses"))


def halluc_responses(m: DataFrame) -> DataFrame:
    """A4: responses with at least one not_found mention (review names included)."""
    return (
        m.filter(F.col("status") == "not_found")
        .select("model_id", "run_id", "prompt_id", "run_index").distinct()
        .groupBy("model_id").agg(F.count(F.lit(1)).alias("responses_with_halluc"))
    )


def model_mentions(m: DataFrame) -> DataFrame:
    """A5: per-model mention counts. Mentions are first added up by name, so the distinct
    counts are plain counts of those sums."""
    by_name = m.groupBy("model_id", "name").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_if(is_checkable()).alias("checkable"),
        F.count_if(is_confirmed()).alias("confirmed"),
        F.count_if(is_review()).alias("needs_review"),
    )
    return by_name.groupBy("model_id").agg(
        F.sum("mentions").alias("mentions"),
        F.count("name").alias("distinct_names"),
        F.sum("checkable").alias("checkable"),
        F.sum("confirmed").alias("confirmed"),
        F.sum("needs_review").alias("needs_review"),
        F.count(F.when(F.col("confirmed") > 0, F.col("name"))).alias("distinct_confirmed"),
    )


def _model_numbers(m: DataFrame) -> DataFrame:
    """A4 + A5 from one pass over ``m``: a mention counts for its (model, name) and, if its
    name is not found, for its (model, response); both are added up first, so the distinct
    counts are plain counts of those sums."""
    blank = {c: F.lit(None).cast(m.schema[c].dataType) for c in ("run_id", "prompt_id",
                                                                 "run_index", "name")}

    def entry(by_name: bool, *columns: str) -> Column:
        return F.struct(F.lit(by_name).alias("by_name"), *(
            (F.col(c) if c in columns else blank[c]).alias(c) for c in blank))

    of_name = entry(True, "name")
    of_response = entry(False, "run_id", "prompt_id", "run_index")
    rows = m.select(
        "model_id", is_checkable().alias("known"), is_confirmed().alias("sure"),
        is_review().alias("doubt"),
        F.explode(F.when(F.col("status") == "not_found", F.array(of_name, of_response))
                  .otherwise(F.array(of_name))).alias("of"))
    sums = rows.groupBy("model_id", "of").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("known").alias("known"),
        F.count_if("sure").alias("sure"), F.count_if("doubt").alias("doubt"))
    name = F.col("of.by_name")
    of_names = lambda c: F.sum(F.when(name, F.col(c)))
    return sums.groupBy("model_id").agg(
        of_names("n").alias("mentions"),
        F.count(F.when(name, F.col("of.name"))).alias("distinct_names"),
        of_names("known").alias("checkable"),
        of_names("sure").alias("confirmed"),
        of_names("doubt").alias("needs_review"),
        F.count(F.when(name & (F.col("sure") > 0), F.col("of.name")))
        .alias("distinct_confirmed"),
        F.count_if(~name).alias("responses_with_halluc"))


def per_model(runs: DataFrame, m: DataFrame) -> DataFrame:
    """A6 (J3): one row per model with ok responses; zeros where it has no mentions. The
    mentions, and the registry join in them, are read once."""
    zero = F.lit(0).cast("bigint")
    out = ok_by_model(runs).join(_model_numbers(m), "model_id", "left")
    return out.select(
        "model_id",
        "ok_responses",
        *[F.coalesce(F.col(c), zero).alias(c) for c in
          ["mentions", "distinct_names", "checkable", "confirmed", "needs_review",
           "distinct_confirmed", "responses_with_halluc"]],
    ).select(
        "*",
        F.try_divide(F.col("confirmed"), F.col("checkable")).alias("confirmed_rate"),
        F.try_divide(F.col("responses_with_halluc"), F.col("ok_responses"))
        .alias("response_rate"),
    ).orderBy("model_id")


def rates_by(m: DataFrame, key: str) -> DataFrame:
    """A7 shape for any grouping column: checkable, confirmed, review, confirmed rate."""
    return (
        m.groupBy(key)
        .agg(
            F.count_if(is_checkable()).alias("checkable"),
            F.count_if(is_confirmed()).alias("confirmed"),
            F.count_if(is_review()).alias("needs_review"),
        )
        .select(
            "*", F.try_divide(F.col("confirmed"), F.col("checkable")).alias("confirmed_rate")
        )
        .orderBy(key)
    )


def by_specificity(m: DataFrame) -> DataFrame:
    """Rates by prompt specificity (groups without mentions do not appear, B13)."""
    return rates_by(m, "specificity")


def by_ecosystem(m: DataFrame) -> DataFrame:
    """Every not_found counts here, needs-review included."""
    return (
        m.groupBy("ecosystem")
        .agg(
            F.count_if(is_checkable()).alias("checkable"),
            F.count_if(F.col("status") == "not_found").alias("halluc_mentions"),
        )
        .select(
            "*",
            F.try_divide(F.col("halluc_mentions"), F.col("checkable")).alias("mention_rate"),
        )
        .orderBy("ecosystem")
    )


def recurrence(m: DataFrame, cells: DataFrame, ordered: bool = True) -> DataFrame:
    """A10 (flagship): per (model, prompt, ecosystem, name) with a not_found status, the
    distinct runs it appeared in against the cell's run total.

    ``needs_review`` marks the whole cell once any of its mentions is an unmapped Python
    import (B10). O1 order: appearances desc, model, name, then prompt and ecosystem so
    ties are stable."""
    nf = m.filter(F.col("status") == "not_found")
    agg = nf.groupBy(*CELL, "ecosystem", "name").agg(
        F.count_distinct("run_index").alias("appearances"),
        F.bool_or(F.col("alias_resolved").eqNullSafe(False)).alias("any_unmapped"),
    )
    return recurrence_rows(agg.join(cells, CELL, "inner"), ordered)


def recurrence_summary(rec: DataFrame) -> DataFrame:
    """Bucket counts over the recurrence cells (majority includes one-offs when a
    cell has one or two runs, B11)."""
    rate = F.col("recurrence_rate")
    return rec.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("appearances") == 1).alias("one_off"),
        F.count_if(F.col("appearances") >= 2).alias("recurring_2plus"),
        F.count_if(rate.isNotNull() & (rate >= 0.5)).alias("majority"),
        F.count_if((rate == 1.0) & (F.col("runs") > 1)).alias("every_run"),
    )


def needs_review_names(rec: DataFrame) -> DataFrame:
    """Distinct (ecosystem, name) among needs-review recurrence cells."""
    return rec.filter(F.col("needs_review")).select("ecosystem", "name").distinct()


def caveats(runs: DataFrame, m: DataFrame) -> DataFrame:
    """One row per non-zero condition, with the report's sentence. The mentions are read
    once: added up by name, a name needs review if any of its mentions in a cell does."""
    r = runs.agg(F.count_if(~F.col("ok")).alias("failed"),
                 F.count_if("truncated").alias("truncated"))
    in_cell = F.col("model_id").isNotNull() & F.col("prompt_id").isNotNull()
    names = m.groupBy("ecosystem", "name").agg(
        F.count_if(is_undetermined()).alias("undetermined"),
        F.count_if(is_review() & in_cell).alias("review"))
    u = names.agg(F.coalesce(F.sum("undetermined"), F.lit(0)).alias("undetermined_mentions"),
                  F.count_if(F.col("review") > 0).alias("needs_review"))
    rows = _long(r).unionByName(_long(u)).filter(F.col("value") > 0)
    n = F.col("value")
    message = F.coalesce(*(F.when(F.col("metric") == k, F.format_string(said, n))
                           for k, said in CAVEATS.items()))
    return rows.select(F.col("metric").alias("caveat"), n.alias("n"), message.alias("message"))


def top_recurring(rec_unordered: DataFrame, k: int = TOP_K_MARKDOWN) -> DataFrame:
    """O2: the first k recurrence rows in report order (TakeOrderedAndProject: each task
    keeps its own top k, so only k rows per task reach the final merge)."""
    return rec_unordered.orderBy(
        F.col("appearances").desc(), "model_id", "name", "prompt_id", "ecosystem"
    ).limit(k)


def recurrence_csv_rows(rec: DataFrame) -> DataFrame:
    """The CSV's eight columns; the rate as ``%.4f`` text, empty when NULL.

    ``format_number`` rounds half-even as Python's format does (``format_string`` rounds
    half-up and differs on ties such as 1/32); grouping commas cannot occur for a rate
    but are removed all the same."""
    rate = F.regexp_replace(F.format_number(F.col("recurrence_rate"), 4), ",", "")
    return rec.select(
        "model_id", "prompt_id", "ecosystem", "name", "appearances", "runs",
        F.coalesce(rate, F.lit("")).alias("recurrence_rate"),
        "status",
    )


def redacted_name(key: str) -> Column:
    """The name as a hash that only holders of ``key`` can check against a name list."""
    return F.sha2(F.concat(F.lit(f"{key}:"), F.col("name")), 256)


def write_recurrence_csv(rec: DataFrame, path: str, redaction_key: str | None = None) -> None:
    """S11 sink: header + rows, through Spark's committer (one folder of part files). With a
    ``redaction_key`` the names are written as keyed hashes."""
    rows = recurrence_csv_rows(rec)
    if redaction_key is not None:
        rows = rows.withColumn("name", redacted_name(redaction_key))
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


# ------------------------------------------------------------------ the report as a whole
REPORT_SECTIONS = ("totals", "per_model", "by_specificity", "by_ecosystem", "recurrence",
                   "recurrence_summary", "needs_review", "caveats", "top_recurring")


def build_report(runs: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """Every report section from one materialised mention table.

    ``m`` (mentions with status) feeds most sections, so it is computed once and its
    lineage cut with a reliable checkpoint in the shared ``spark.checkpoint.dir`` (a lost
    executor then re-reads the checkpoint instead of re-running extraction and the join).
    """
    from namewatch.session import checkpoint_dir

    spark = runs.sparkSession
    checkpoint_dir(spark)
    m = mention_status(explode_packages(runs), registry).checkpoint(eager=True)
    cells = cell_runs(runs)
    rec = recurrence(m, cells, ordered=False).checkpoint(eager=True)
    return {
        "totals": totals(runs, m),
        "per_model": per_model(runs, m),
        "by_specificity": by_specificity(m),
        "by_ecosystem": by_ecosystem(m),
        "recurrence": rec.orderBy(F.col("appearances").desc(), "model_id", "name",
                                  "prompt_id", "ecosystem"),
        "recurrence_summary": recurrence_summary(rec),
        "needs_review": needs_review_names(rec),
        "caveats": caveats(runs, m),
        "top_recurring": top_recurring(rec),
    }


def recurrence_preaggregated(mentions: DataFrame, registry: DataFrame, cells: DataFrame,
                             ordered: bool = True) -> DataFrame:
    """A10 computed from mentions without materialising ``m``: mentions are first reduced
    to distinct (cell, ecosystem, name, run) rows (map-side combine, so repeated mentions
    of a hot name within a run collapse before any shuffle), then semi-joined to the
    registry's not_found names (one row per name: no duplication), then counted. Same
    result as ``recurrence(mention_status(...))``."""
    keys = [*CELL, "ecosystem", "name"]
    pre = mentions.groupBy(*keys, "run_index").agg(
        F.bool_or(F.col("alias_resolved").eqNullSafe(False)).alias("unmapped"))
    not_found = registry.filter(F.col("status") == "not_found").select("ecosystem", "name")
    nf = pre.join(not_found, ["ecosystem", "name"], "left_semi")
    agg = nf.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("appearances"),
        F.bool_or("unmapped").alias("any_unmapped"),
    )
    return recurrence_rows(agg.join(cells, CELL, "inner"), ordered)


def recurrence_rows(counted: DataFrame, ordered: bool) -> DataFrame:
    """Recurrence columns of ``counted`` (appearances, runs, any_unmapped)."""
    needs_review = (F.col("ecosystem") == "python") & F.col("any_unmapped")
    out = counted.select(
        "model_id", "prompt_id", "ecosystem", "name", "appearances", "runs",
        F.try_divide(F.col("appearances"), F.col("runs")).alias("recurrence_rate"),
        needs_review.alias("needs_review"),
        review_label(needs_review).alias("status"),
    )
    if ordered:
        out = out.orderBy(F.col("appearances").desc(), "model_id", "name", "prompt_id",
                          "ecosystem")
    return out
