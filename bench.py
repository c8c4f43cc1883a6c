"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

``documents`` is one file with one row group, which a scan cannot split; before the clock starts
it is laid out in two files a core, as a table of any size would be (same rows; the other tables
are read where they are). Each query runs to completion into Spark's ``noop`` sink (the whole
plan executes, no rows travel to the driver). The list runs twice: the first (cold) pass pays JVM warm-up
and code generation, the second (warm) pass is the reported value; both are printed.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from namewatch.plans.catalog import all_queries  # noqa: E402
from namewatch.session import build_session  # noqa: E402

HEADLINE = [
    "recurrence",            # A10 flagship
    "by_specificity",        # A7
    "per_model",             # A6
    "totals",                # A1-A2
    "recurrence_summary",    # A11
    "extract_mentions",      # K21 full extraction over whole response texts
    "filtered_audit",        # K18
    "reduce_attempts",       # R2
    "cache_split",           # J8
    "reduce_calls",          # R5
    "resume_pending",        # J4
    "rates_grouping_sets",   # E2
]


def laid_out(spark, sf_dir: str, files: int) -> str:
    """A folder with the tables of ``sf_dir``, ``documents`` in several files."""
    folder = tempfile.mkdtemp(prefix="namewatch-bench-")
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(os.path.join(os.path.abspath(sf_dir), name), os.path.join(folder, name))
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(files).write.parquet(
        f"{folder}/documents.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          app_name="namewatch-bench")
    tables = laid_out(spark, sf_dir, 2 * cpus)
    queries = all_queries()
    names = [q for q in (sys.argv[1:] or HEADLINE) if q in queries]

    def run_pass() -> dict[str, float]:
        out: dict[str, float] = {}
        for name in names:
            t0 = time.perf_counter()
            queries[name](spark, tables).write.format("noop").mode("overwrite").save()
            out[name] = round(time.perf_counter() - t0, 3)
        return out

    cold = run_pass()   # first pass: JVM warm-up, code generation, file listing
    warm = run_pass()   # second pass: steady state (reported)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold_total": round(sum(cold.values()), 3),
        "cold_queries": cold,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "documents_files": 2 * cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
