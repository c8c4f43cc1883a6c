"""Registry lookups as tables.

No network: the engine reduces *logs* of lookup attempts and joins snapshots and a lookup
cache. Every per-name reduction is a hash aggregate with ``min_by``/``max_by`` (map-side
partial aggregation), never a window over a name, so a name that holds a third of all
rows is combined per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch import fixed_values as V

KEY = ["ecosystem", "name"]


def classify_http(status: Column) -> Column:
    """200 -> exists, 404 -> not_found, anything else (or no response) -> error."""
    return F.when(status == 200, "exists").when(status == 404, "not_found").otherwise("error")


def is_definitive(status: Column) -> Column:
    return status.isin("exists", "not_found")


def reduce_attempts(attempts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """R2: one result per (ecosystem, name) from its ordered attempts.

    The first attempt that is decisive (200/404) or not retryable (an HTTP status outside
    408, 425, 429, 500, 502, 503, 504) ends the lookup: 200/404 give exists/not_found,
    anything else an error with that status. Without such an attempt the result is an
    error carrying the last attempt's status and detail. ``checked_at`` is the first
    attempt's time."""
    order_cols = order or ["attempt", "checked_at"]
    ordering = F.struct(*[F.col(c) for c in order_cols])
    st = F.col("http_status")
    terminal = st.isNotNull() & (st.isin(200, 404) | ~st.isin(*V.RETRYABLE_HTTP))
    outcome = F.struct(st.alias("http_status"), F.col("detail").alias("detail"))
    agg = attempts.groupBy(*KEY).agg(
        F.min_by(outcome, F.when(terminal, ordering)).alias("first_terminal"),
        F.max_by(outcome, ordering).alias("last"),
        F.min("checked_at").alias("checked_at"),
        F.count(F.lit(1)).alias("attempts"),
    )
    ft = F.col("first_terminal")
    decided = ft.isNotNull()
    http = F.when(decided, ft["http_status"]).otherwise(F.col("last")["http_status"])
    detail = F.when(decided & ft["http_status"].isin(200, 404), F.lit(None).cast("string")) \
        .when(decided, F.concat(F.lit("HTTP "), ft["http_status"].cast("string"))) \
        .when(F.col("last")["http_status"].isNotNull(),
              F.concat(F.lit("HTTP "), F.col("last")["http_status"].cast("string"))) \
        .otherwise(F.col("last")["detail"])
    return agg.select(
        *KEY,
        F.when(decided, classify_http(ft["http_status"])).otherwise("error").alias("status"),
        http.alias("http_status"),
        detail.alias("detail"),
        "checked_at",
        "attempts",
    )


def cache_fresh(cache: DataFrame, as_of: Column, max_age_days: float = V.CACHE_MAX_AGE_DAYS
                ) -> Column:
    """An entry is usable if it is not an error and no older than ``max_age_days``
    at ``as_of`` (an explicit instant, never the wall clock). Both positives and
    negatives expire."""
    age_s = F.timestamp_diff("SECOND", F.col("checked_at"), as_of)
    return (F.col("status") != "error") & (age_s <= max_age_days * 86400.0)


def latest_status(entries: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The latest entry per (ecosystem, name) (a later put overwrites the key)."""
    order_cols = order or ["checked_at", "status"]
    cols = [c for c in entries.columns if c not in KEY]
    latest = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order_cols]))
    return entries.groupBy(*KEY).agg(latest.alias("e")).select(*KEY, "e.*")


def cache_put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """Definitive results overwrite their keys, whatever their check times; errors are
    never written. Several results for one key: the latest check wins."""
    cols = ["ecosystem", "name", "status", "http_status", "detail", "checked_at"]
    new = results.filter(is_definitive(F.col("status"))).select(*cols)
    both = cache.select(*cols, F.lit(0).alias("put")).unionByName(
        new.select("*", F.lit(1).alias("put")))
    return latest_status(both, ["put", "checked_at", "status"]).select(*cols)


def cache_split(names: DataFrame, cache: DataFrame, as_of: Column, refresh: bool = False,
                max_age_days: float = V.CACHE_MAX_AGE_DAYS) -> DataFrame:
    """Each distinct name to check, with ``from_cache`` true when a fresh definitive
    cache entry answers it (``refresh`` ignores the cache); the rest are to fetch."""
    n = names.select(*KEY).distinct()
    answer = ["status", "http_status", "detail", "checked_at"]
    if refresh:
        return n.select(*KEY, F.lit(False).alias("from_cache"),
                        F.lit(None).cast("string").alias("status"),
                        F.lit(None).cast("int").alias("http_status"),
                        F.lit(None).cast("string").alias("detail"),
                        F.lit(None).cast("timestamp").alias("checked_at"))
    c = cache.select(*KEY, *answer).filter(cache_fresh(cache, as_of, max_age_days))
    j = n.join(c, KEY, "left")
    return j.select(*KEY, F.col("status").isNotNull().alias("from_cache"), *answer)


def cache_stats(split: DataFrame) -> DataFrame:
    """Cache hits and misses (absent, error entry or stale count as misses)."""
    return split.agg(
        F.count_if(F.col("from_cache")).alias("hits"),
        F.count_if(~F.col("from_cache")).alias("misses"),
    )


def unique_names(mentions: DataFrame) -> DataFrame:
    """Distinct (ecosystem, name) from successful runs; empty names dropped; sorted.
    ``mentions`` holds the mentions of ok runs (P1 applied upstream)."""
    return (
        mentions.filter(F.col("ecosystem").isNotNull() & (F.col("ecosystem") != "")
                        & F.col("name").isNotNull() & (F.col("name") != ""))
        .select(*KEY)
        .distinct()
        .orderBy(*KEY)
    )


def dedupe_first_seen(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per distinct (ecosystem, name): its first occurrence in input order
    (``order`` columns), kept as the first-seen position."""
    pos = F.struct(*[F.col(c) for c in order])
    return rows.groupBy(*KEY).agg(F.min(pos).alias("first_seen")).select(
        *KEY, *[F.col("first_seen")[c].alias(c) for c in order]
    )


def status_counts(snapshot: DataFrame) -> DataFrame:
    """Names per status in a snapshot."""
    return snapshot.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def check_summary(results: DataFrame) -> DataFrame:
    """Not found / exist / undetermined."""
    s = F.col("status")
    return results.agg(
        F.count_if(s == "not_found").alias("not_found"),
        F.count_if(s == "exists").alias("exist"),
        F.count_if(s == "error").alias("undetermined"),
    )


def check_ambiguous(results: DataFrame, aliases: DataFrame) -> DataFrame:
    """Python names not found and not among the alias table's distribution names
    (the alias table is a small dimension; the anti join is broadcast by AQE)."""
    dist = aliases.select(F.col("dist_name").alias("name")).distinct()
    return (
        results.filter((F.col("ecosystem") == "python") & (F.col("status") == "not_found"))
        .join(dist, "name", "left_anti")
        .select("ecosystem", "name")
    )


def status_transitions(snapshots: DataFrame) -> DataFrame:
    """E5: status changes between consecutive snapshots of a name (e.g. a missing name
    later registered). The window holds one name's snapshots: bounded by the number of
    snapshot passes, not by mentions."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY).orderBy("snapshot_at")
    prev = F.lag("status").over(w)
    return (
        snapshots.select(*KEY, "snapshot_at", "status", prev.alias("previous_status"))
        .filter(F.col("previous_status").isNotNull() & (F.col("previous_status") != F.col("status")))
    )
