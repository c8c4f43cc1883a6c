"""Registered source/sink queries: each writes table-derived data under the session's
checkpoint folder through the engine's writer, reads it back through the engine's
reader, and returns what the reader sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewatch import schemas
from namewatch.operators import extract as X
from namewatch.operators import lookups as L
from namewatch.operators import report as R
from namewatch.plans.ops_queries import CUT, LATER, _snapshot
from namewatch.sources import cache_table as CT
from namewatch.sources import files as FS
from namewatch.sources import fixtures as FX

RUN_COLS = ["run_id", "prompt_id", "ecosystem", "domain", "specificity", "model_id",
            "run_index", "ok", "truncated", "created_at"]


def _records(s: SparkSession, sf: str) -> DataFrame:
    """Run records as the sweep writes them: run columns plus the packages list."""
    runs = FX.runs(s, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return FS.run_records_with_packages(runs, FX.mentions(s, sf))


def _runs_json(s: SparkSession, sf: str) -> str:
    path = FS.scratch_path(s, "runs")
    FS.append_runs(_records(s, sf), path)
    return path


def scan_runs(s, sf):
    """S1 + P8: run records read back from JSON lines; packages counted per record."""
    r = FS.scan_runs(s, _runs_json(s, sf))
    return r.select(*RUN_COLS, F.size("packages").alias("n_packages"))


def scan_mentions(s, sf):
    """S1 + P8 + B14: the mention rows of the JSON records (ok runs, inner explode)."""
    return R.mention_projection(R.explode_packages(FS.scan_runs(s, _runs_json(s, sf))))


def scan_registry(s, sf):
    """The registry snapshot written as JSON lines and scanned back."""
    path = FS.scratch_path(s, "registry")
    FX.names(s, sf).withColumn("checked_at", F.lit(CUT).cast("timestamp")).write.json(path)
    return FS.scan_registry(s, path)


def scan_tolerant(s, sf):
    """S6 + R9: completed keys from a run file with blank and damaged lines (damaged:
    orders whose key is a multiple of 13 lost the second half of their line)."""
    path = FS.scratch_path(s, "runs-damaged")
    rec = _records(s, sf).select("response_id", F.to_json(F.struct(*RUN_COLS)).alias("line"))
    damaged = F.when(F.col("response_id") % 13 == 0,
                     F.substring("line", 1, F.length("line") / 2)).otherwise(F.col("line"))
    lines = rec.select(damaged.alias("value")).unionByName(
        rec.filter(F.col("response_id") % 17 == 0).select(F.lit("").alias("value")))
    lines.write.text(path)
    ok = FS.scan_tolerant(s, path).filter(F.col("ok") & F.col("prompt_id").isNotNull()
                                         & F.col("model_id").isNotNull())
    return ok.select("prompt_id", "model_id", "run_index").distinct()


def append_runs(s, sf):
    """Two sweeps appended to one folder; the folder then holds both."""
    path = FS.scratch_path(s, "runs-append")
    rec = _records(s, sf).select(*RUN_COLS)
    FS.append_runs(rec.filter(F.col("run_id") == "sweep-0"), path)
    FS.append_runs(rec.filter(F.col("run_id") != "sweep-0"), path)
    r = FS.scan_runs(s, path)
    return r.groupBy("run_id").agg(F.count(F.lit(1)).alias("records"),
                                   F.count_if("ok").alias("ok"))


def snapshot_write(s, sf):
    """Two lookup passes appended as two snapshot partitions; both stay readable."""
    path = FS.scratch_path(s, "snapshots")
    cols = ["ecosystem", "name", "status", "http_status", "checked_at"]
    FS.write_snapshot(_snapshot(s, sf, "before").select(*cols), CUT, path)
    FS.write_snapshot(_snapshot(s, sf, "after").select(*cols), LATER, path)
    snaps = FS.read_snapshots(s, path)
    return snaps.groupBy("snapshot_id", "status").agg(F.count(F.lit(1)).alias("n"))


def scan_strict(s, sf):
    """S6, strict half: sound run records read so that a damaged line would fail the job."""
    r = FS.scan_tolerant(s, _runs_json(s, sf), strict=True)
    return r.select(*RUN_COLS, F.size("packages").alias("n_packages"))


def snapshot_mention_status(s, sf):
    """Mentions by status under the latest snapshot of each name."""
    path = FS.scratch_path(s, "snapshots")
    cols = ["ecosystem", "name", "status", "http_status", "checked_at"]
    FS.write_snapshot(_snapshot(s, sf, "before").select(*cols), CUT, path)
    FS.write_snapshot(_snapshot(s, sf, "after").select(*cols), LATER, path)
    m = R.mention_status(FX.mentions(s, sf), FS.current_registry(s, path))
    return m.groupBy(F.coalesce("status", F.lit("unchecked")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


# Instants of the lookup passes that mention_status_as_of stores.
PASSES = ("1994-01-01 00:00:00", "1996-01-01 00:00:00", "1998-01-01 00:00:00")


def mention_status_as_of(s, sf):
    """S9 to J1 at the time of the mention: three dated snapshots, each of the lookups made
    before it, and every mention under the latest one up to its run."""
    path = FS.scratch_path(s, "snapshots")
    cols = ["ecosystem", "name", "status", "http_status", "checked_at"]
    for at in PASSES:
        looked_up = FX.attempts(s, sf).filter(F.col("checked_at") < F.lit(at).cast("timestamp_ntz"))
        FS.write_snapshot(L.reduce_attempts(
            looked_up, order=["checked_at", "batch", "attempt"]).select(*cols), at, path)
    m = R.mention_status_as_of(FX.mentions(s, sf), FS.read_snapshots(s, path))
    return m.groupBy("model_id", F.year("created_at").cast("long").alias("year"),
                     F.coalesce("status", F.lit("unchecked")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


def cache_table(s, sf):
    """S10 as a stored table: the earlier lookup pass put into an empty cache, then the later
    pass, name group by name group; what a reader sees."""
    base = FS.scratch_path(s, "cache-table")
    CT.put(_snapshot(s, sf, "before"), base)
    after = FS.stored(_snapshot(s, sf, "after"), "after")
    CT.put(after.filter(F.col("ecosystem") == "python"), base)
    CT.put(after.filter(F.col("ecosystem") != "python"), base)
    return CT.read_cache(s, base)


def wordlist_load(s, sf):
    """A word list (nation names, each twice, padded) with comment and blank lines."""
    path = FS.scratch_path(s, "wordlist")
    n = FX.read_table(s, sf, "nation").select("n_name")
    r = FX.read_table(s, sf, "region").select("r_name")
    lines = (
        n.select(F.concat(F.lit("  "), F.col("n_name"), F.lit("\t")).alias("value"))
        .unionByName(n.select(F.col("n_name").alias("value")))
        .unionByName(r.select(F.concat(F.lit("# "), F.col("r_name")).alias("value")))
        .unionByName(r.select(F.lit("   ").alias("value")))
    )
    lines.write.text(path)
    return FS.load_wordlist(s, path)


def alias_load(s, sf):
    """Import-name -> distribution-name files derived from the part table: four groups of
    growing size, each naming again the modules of the groups before; the last file wins."""
    path = FS.scratch_path(s, "aliases")
    m = FX.read_table(s, sf, "part").select((F.col("p_partkey") % 1000).alias("m"))
    m.select("m", F.explode(F.sequence(3 - F.col("m") % 4, F.lit(3).cast("long"))).alias("g")) \
        .select(F.concat(F.lit("mod_"), F.col("m").cast("string")).alias("import_name"),
                F.concat(F.lit("dist-"), F.col("g").cast("string"), F.lit("-"),
                         (F.col("m") % 97).cast("string")).alias("dist_name"), "g") \
        .write.partitionBy("g").option("header", True).csv(path)
    return FS.load_aliases(s, path)


def mentions_loaded(s, sf):
    """S4 + S5 to K21: word lists and aliases written from the names that extraction without
    any vocabulary finds (by the hash of the name: listed, or given an alias), loaded from
    their files, and used to extract again; names by what became of them."""
    resp = FX.responses(s, sf)
    found = X.mentions_of(X.extract_resolved(resp, X.Vocabulary.small(s, set(), set(), {})))
    lists = FS.scratch_path(s, "vocabulary")
    of = lambda eco, col, listed: found.filter(
        (F.col("ecosystem") == eco) & ((F.md5(F.col(col).cast("binary")) < "8") == listed)) \
        .select(F.col(col).alias("value")).distinct()
    of("python", "raw", True).write.text(f"{lists}/python")
    of("javascript", "name", True).write.text(f"{lists}/javascript")
    of("python", "raw", False).select(
        F.col("value").alias("import_name"), F.concat(F.lit("dist-"), "value").alias("dist_name")
    ).write.option("header", True).csv(f"{lists}/aliases")
    vocab = X.Vocabulary.of(FS.load_wordlist(s, f"{lists}/python"),
                            FS.load_wordlist(s, f"{lists}/javascript"),
                            FS.load_aliases(s, f"{lists}/aliases"))
    r = X.extract_resolved(resp, vocab)
    return r.groupBy("ecosystem", F.coalesce("reason", F.lit("kept")).alias("reason"),
                     "audit_name", "name", "alias_resolved").agg(F.count(F.lit(1)).alias("n"))


def recurrence_csv_write(s, sf):
    """The recurrence CSV written and read back as text columns."""
    path = FS.scratch_path(s, "recurrence-csv")
    rec = R.recurrence_preaggregated(FX.mentions(s, sf), FX.names(s, sf),
                                     R.cell_runs(FX.runs(s, sf)), ordered=False)
    R.write_recurrence_csv(rec, path)
    return s.read.option("header", True).csv(path)


def reextract_diff(s, sf):
    """S8 + A18: records extracted with a stale vocabulary (no standard library, no
    aliases) are re-extracted with the current one; the new version is written next to
    the old and the diff is computed between the two committed versions."""
    base = FS.scratch_path(s, "records")
    resp = FX.responses(s, sf)
    stale = X.Vocabulary.small(s, set(), set(), {})
    current = X.Vocabulary.default(s)

    def records(vocab):
        pk = X.packages_per_response(X.mentions_of(X.extract_resolved(resp, vocab)))
        empty = F.array().cast(f"array<{schemas.PACKAGE.simpleString()}>")
        return resp.select("response_id").join(pk, "response_id", "left").select(
            "response_id", F.coalesce("packages", empty).alias("packages"))

    FS.write_version(records(stale), base, 1)
    FS.write_version(records(current), base, 2)
    old = FS.read_version(s, base, 1)
    new = FS.read_current(s, base)
    j = old.alias("o").join(new.alias("n"), "response_id")
    return j.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~F.col("o.packages").eqNullSafe(F.col("n.packages"))).alias("changed"),
        F.sum(F.size("o.packages")).alias("packages_before"),
        F.sum(F.size("n.packages")).alias("packages_after"),
    )


def prompts_scan(s, sf):
    """S3: the prompt corpus written as one folder per file and loaded back in
    file-then-entry order (entries numbered by their position), Python prompts only, text
    stripped."""
    from namewatch.operators import quality as Q
    path = FS.scratch_path(s, "prompts")
    FS.write_prompt_corpus(FX.prompt_corpus(s, sf), path)
    return Q.load_prompts(FS.scan_prompt_corpus(s, path), ["python"])


QUERIES = {
    "prompts_scan": prompts_scan,
    "scan_runs": scan_runs,
    "scan_mentions": scan_mentions,
    "scan_registry": scan_registry,
    "scan_tolerant": scan_tolerant,
    "scan_strict": scan_strict,
    "append_runs": append_runs,
    "snapshot_write": snapshot_write,
    "snapshot_mention_status": snapshot_mention_status,
    "mention_status_as_of": mention_status_as_of,
    "cache_table": cache_table,
    "wordlist_load": wordlist_load,
    "alias_load": alias_load,
    "mentions_loaded": mentions_loaded,
    "recurrence_csv_write": recurrence_csv_write,
    "reextract_diff": reextract_diff,
}
