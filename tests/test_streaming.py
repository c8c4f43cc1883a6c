"""Streams processed with availableNow must reach the batch answer."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from namewatch.operators import increments as INC
from namewatch.operators import report as R
from namewatch.plans import catalog
from namewatch.streaming import streams as ST
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())


def test_stream_mentions_equal_batch(spark):
    q = catalog.all_queries()
    assert _rows(q["stream_mentions"](spark, SF_SMALL)) == _rows(q["extract_mentions"](spark, SF_SMALL))


def test_stream_recurrence_equal_batch(spark):
    q = catalog.all_queries()
    batch = q["recurrence"](spark, SF_SMALL).select(
        "model_id", "prompt_id", "ecosystem", "name", "appearances", "runs", "recurrence_rate")
    assert _rows(q["stream_recurrence"](spark, SF_SMALL)) == _rows(batch)


def test_stream_progress_and_resume_equal_batch(spark):
    q = catalog.all_queries()
    prog = q["stream_progress"](spark, SF_SMALL).first().asDict()
    tot = q["totals"](spark, SF_SMALL).first()
    assert (prog["records"], prog["ok"], prog["failed"], prog["truncated"]) == (
        tot["records"], tot["ok"], tot["failed"], tot["truncated"])
    assert _rows(q["stream_resume"](spark, SF_SMALL)) == _rows(q["resume_pending"](spark, SF_SMALL))


def _record(model, run, names, ok=True):
    return {"model_id": model, "prompt_id": "p", "run_id": "r", "run_index": run, "ok": ok,
            "ecosystem": "python", "packages": [
                {"name": n, "ecosystem": "python", "source": "install", "origin": "prose"}
                for n in names]}


def _arrive(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in records))


def _names(spark, folder):
    src = ST.read_stream(spark, str(folder), ST.RUN_RECORDS, max_files_per_trigger=1)
    return R.explode_packages(src).select(F.lit("python").alias("ecosystem"), "name")


def test_new_names_are_emitted_once(spark, tmp_path):
    """Within a batch, over batches, over restarts, and over later runs of the stream with
    another checkpoint; the stream itself keeps no state."""
    out, folder = str(tmp_path / "known"), tmp_path / "in"
    assert ST.known_names(spark, out).count() == 0
    _arrive(folder, "1", [_record("m", 1, ["a", "a", "b", None]), _record("m", 2, ["a"])])
    _arrive(folder, "2", [_record("m", 3, ["b", "c"]), _record("m", 4, ["z"], ok=False)])
    run = lambda stream: ST.run_batches(
        _names(spark, folder), ST.new_name_sink(out, stream), str(tmp_path / stream))
    run("first")
    rows = ST.known_names(spark, out).collect()
    assert sorted(str(r["name"]) for r in rows) == ["None", "a", "b", "c"]
    _arrive(folder, "3", [_record("m", 5, ["c", "d"])])
    run("first")                                            # restarted: goes on
    assert sorted(str(r["name"]) for r in ST.known_names(spark, out).collect()) == [
        "None", "a", "b", "c", "d"]
    _arrive(folder, "4", [_record("m", 6, ["d", "e"])])
    run("second")                                           # another run: everything again
    rows = ST.known_names(spark, out).collect()
    assert sorted((str(r["name"]), r["stream"]) for r in rows) == [
        ("None", "first"), ("a", "first"), ("b", "first"), ("c", "first"), ("d", "first"),
        ("e", "second")]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    sink = ST.new_name_sink(str(tmp_path / "known"), "s")
    batch = spark.createDataFrame([("e", "a"), ("e", "b")], "ecosystem string, name string")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.unionByName(spark.createDataFrame([("e", "c")], batch.schema)), 1)
    assert sorted(r["name"] for r in ST.known_names(spark, str(tmp_path / "known")).collect()) \
        == ["a", "b", "c"]


def test_new_names_keep_no_state(spark, tmp_path):
    folder = tmp_path / "in"
    _arrive(folder, "1", [_record("m", 1, ["a"])])
    q = (_names(spark, folder).writeStream.foreachBatch(
        ST.new_name_sink(str(tmp_path / "known"), "s"))
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert all(not p["stateOperators"] for p in map(lambda x: json.loads(x.json),
                                                    q.recentProgress))


class _Stopped(Exception):
    pass


def test_recurrence_halves_are_of_one_instant(spark, tmp_path, monkeypatch):
    """The job stops between the two writes of a batch: the reader keeps to the batches that
    both tables have; after the restart the batch counts in both, once."""
    folder, out = tmp_path / "in", str(tmp_path / "rec")
    registry = spark.createDataFrame([("python", "ghost", "not_found")],
                                     "ecosystem string, name string, status string")
    read = lambda: {(r["model_id"], r["name"]): (r["appearances"], r["runs"])
                    for r in ST.read_recurrence(spark, out, registry).collect()}
    with pytest.raises(ValueError):
        read()
    _arrive(folder, "1", [_record("m", 1, ["ghost", "real"]), _record("m", 2, []),
                          _record("m", 3, ["ghost"], ok=False)])
    src = ST.read_stream(spark, str(folder), ST.RUN_RECORDS, max_files_per_trigger=1)
    run = lambda: ST.run_batches(src, ST.recurrence_sink(out, "s"), str(tmp_path / "c"))
    run()
    assert read() == {("m", "ghost"): (1, 2)}
    _arrive(folder, "2", [_record("m", 2, ["ghost"]), _record("m", 70, ["ghost"])])
    cells = INC.cell_bits

    def stops(_):
        raise _Stopped

    monkeypatch.setattr(INC, "cell_bits", stops)
    with pytest.raises(Exception, match="_Stopped"):
        run()
    assert read() == {("m", "ghost"): (1, 2)}
    monkeypatch.setattr(INC, "cell_bits", cells)
    run()
    assert read() == {("m", "ghost"): (3, 3)}


def test_merged_bits_equal_the_whole(spark):
    """Parts that overlap, indexes past a word, null and negative indexes."""
    rows = [("m", "p", i, True) for i in [0, 1, 63, 64, 65, 200, None, -1]]
    runs = spark.createDataFrame(rows, "model_id string, prompt_id string, run_index long, "
                                       "ok boolean")
    said = [("m", "p", "python", n, i, a) for n, i, a in [
        ("x", 0, True), ("x", 64, None), ("x", 64, None), ("x", 200, False), ("y", -1, None),
        ("y", None, None), ("z", None, None), ("known", 1, None)]]
    m = spark.createDataFrame(said, "model_id string, prompt_id string, ecosystem string, "
                                    "name string, run_index long, alias_resolved boolean")
    registry = spark.createDataFrame([("python", n, "not_found") for n in "xyz"],
                                     "ecosystem string, name string, status string")
    want = R.recurrence(R.mention_status(m, registry), R.cell_runs(runs), ordered=False)
    one, two = m.filter("run_index < 65 OR run_index IS NULL"), m.filter(
        "run_index >= 64 OR name = 'y'")
    bits = INC.mention_bits(one).unionByName(INC.mention_bits(two))
    cells = INC.cell_bits(runs).unionByName(INC.cell_bits(runs.limit(3)))
    for _ in range(2):      # merging again changes nothing
        got = INC.recurrence_of_bits(bits, cells, registry)
        assert _rows(got) == _rows(want) and got.count() == 3
        bits, cells = INC.merged_mentions(bits), INC.merged_cells(cells)


def test_status_at_the_time_of_the_mention(spark):
    """A name registered between two sweeps is not found in the first and exists in the
    second; before the first snapshot nothing is known."""
    m = spark.createDataFrame(
        [("python", n, t) for n in ("late", "gone", "never") for t in
         ("2024-01-01", "2024-02-01", "2024-03-15", "2024-05-01")] + [("python", "late", None)],
        "ecosystem string, name string, created_at string")
    snaps = spark.createDataFrame(
        [("python", "late", "not_found", "2024-02-01"), ("python", "late", "exists", "2024-04-01"),
         ("python", "gone", "exists", "2024-02-01"), ("python", "gone", "not_found", "2024-03-01"),
         ("python", "late", "exists", None)],
        "ecosystem string, name string, status string, snapshot_at string")
    got = {(r["name"], r["created_at"]): r["status"]
           for r in R.mention_status_as_of(m, snaps).collect()}
    of = lambda n: [got[n, t] for t in
                    ("2024-01-01", "2024-02-01", "2024-03-15", "2024-05-01")]
    assert of("late") == [None, "not_found", "not_found", "exists"]
    assert of("gone") == [None, "exists", "not_found", "not_found"]
    assert of("never") == [None] * 4 and got["late", None] is None and len(got) == 13
