"""Registered streaming queries: each streams table-derived JSON files (as many as the
writer makes) through the operator with ``availableNow``, then returns the sink's
contents, which must equal the batch result."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from namewatch.operators import extract as X
from namewatch.operators import report as R
from namewatch.operators import sweep as SW
from namewatch.plans.file_queries import RUN_COLS, _records
from namewatch.plans.ops_queries import _plan
from namewatch.session import checkpoint_dir
from namewatch.sources import files as FS
from namewatch.sources import fixtures as FX
from namewatch.streaming import streams as ST


def _responses_dir(s: SparkSession, sf: str) -> str:
    path = FS.scratch_path(s, "stream-responses")
    FX.responses(s, sf).write.json(path)
    return path


def _runs_dir(s: SparkSession, sf: str) -> str:
    path = FS.scratch_path(s, "stream-runs")
    _records(s, sf).select("response_id", *RUN_COLS, "packages").write.json(path)
    return path


def stream_mentions(s, sf):
    """Incremental extraction into a Parquet sink."""
    src = ST.read_stream(s, _responses_dir(s, sf), ST.RESPONSES)
    out = FS.scratch_path(s, "sink-mentions")
    ST.run_append(ST.stream_mentions(src, X.Vocabulary.default(s)), out,
                  FS.scratch_path(s, "ckpt-mentions"))
    return s.read.parquet(out)


def _new_names(s: SparkSession, streams, label: str):
    """Streams that run one after another, each with its own checkpoint, into one table of
    known names; what they emitted together."""
    out = FS.scratch_path(s, f"known-{label}")
    for i, mentions in enumerate(streams):
        ST.run_batches(mentions, ST.new_name_sink(out, f"run-{i}"),
                       FS.scratch_path(s, f"ckpt-{label}"))
    return ST.known_names(s, out).select("ecosystem", "name")


def stream_new_names(s, sf):
    """First sighting of each (ecosystem, name) over the mention stream."""
    src = ST.read_stream(s, _responses_dir(s, sf), ST.RESPONSES)
    return _new_names(s, [ST.stream_mentions(src, X.Vocabulary.default(s))], "names")


def stream_new_names_bounded(s, sf):
    """T2 over two runs: new names among the mentions of arriving run records, first of one
    sweep, then, in a later run of the stream, of all; the later run emits only names that the
    earlier one has not."""
    def mentions(records):
        return R.ok_runs(records).select("ecosystem", F.explode("packages").alias("p")) \
            .select("ecosystem", F.col("p.name").alias("name"))

    src = ST.read_stream(s, _runs_dir(s, sf), ST.RUN_RECORDS)
    return _new_names(s, [mentions(src.filter(F.col("run_id") == "sweep-0")), mentions(src)],
                      "names-b")


def stream_recurrence(s, sf):
    """Running recurrence, one file a micro-batch where there are several, numerators and
    denominators of the same batches."""
    out = FS.scratch_path(s, "sink-rec")
    runs = ST.read_stream(s, _runs_dir(s, sf), ST.RUN_RECORDS, max_files_per_trigger=4)
    ST.run_batches(runs, ST.recurrence_sink(out, "run-0"), FS.scratch_path(s, "ckpt-rec"))
    return ST.read_recurrence(s, out, FX.names(s, sf)).select(
        "model_id", "prompt_id", "ecosystem", "name", "appearances", "runs", "recurrence_rate")


def stream_progress(s, sf):
    """T4: live counters (a global streaming aggregate, complete mode)."""
    src = ST.read_stream(s, _runs_dir(s, sf), ST.RUN_RECORDS)
    out = FS.scratch_path(s, "sink-progress")
    ST.run_update(ST.stream_progress(src), out, FS.scratch_path(s, "ckpt-progress"),
                  mode="complete")
    return ST.read_latest(s, out, [])


def stream_resume(s, sf):
    """T5: completed keys recorded per micro-batch (idempotent); pending = plan minus
    recorded keys."""
    src = ST.read_stream(s, _runs_dir(s, sf), ST.RUN_RECORDS)
    plan = _plan(s, sf)
    # every micro-batch semi-joins against the plan: compute it once, lineage cut in the
    # shared checkpoint folder
    checkpoint_dir(s)
    plan_keys = plan.select(*SW.TASK_KEY).checkpoint(eager=True)
    out = FS.scratch_path(s, "sink-resume")
    (src.writeStream.foreachBatch(ST.resume_sink(plan_keys, out))
     .option("checkpointLocation", FS.scratch_path(s, "ckpt-resume"))
     .trigger(availableNow=True).start().awaitTermination())
    done = s.read.parquet(out).select(*SW.TASK_KEY).distinct()
    return SW.resume_pending(plan, done).select(*SW.TASK_KEY)


QUERIES = {
    "stream_mentions": stream_mentions,
    "stream_new_names": stream_new_names,
    "stream_new_names_bounded": stream_new_names_bounded,
    "stream_recurrence": stream_recurrence,
    "stream_progress": stream_progress,
    "stream_resume": stream_resume,
}
