"""Order of files and of entries in them, whatever the files' sizes and splits."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from namewatch.sources import cache_table as CT
from namewatch.sources import files as FS


@pytest.fixture
def small_splits(spark):
    """Splits of 2 KB, packed into tasks by size."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                             "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


SIZES = [3, 400, 0, 1, 90, 1200, 7, 300, 2]


def test_last_alias_entry_wins_over_many_files(spark, tmp_path, small_splits):
    want = {}
    for i, n in enumerate(SIZES):
        rows = [(f"m{(k * 7 + i) % 500}", f"d{i}-{k}") for k in range(n)]
        want.update(rows)
        (tmp_path / f"{i:02d}.csv").write_text(
            "import_name,dist_name\n" + "".join(f"{a},{b}\n" for a, b in rows))
    got = FS.load_aliases(spark, str(tmp_path))
    assert {r[0]: r[1] for r in got.collect()} == want


def test_alias_order_of_two_files(spark, tmp_path):
    """The larger file is read first by Spark, and comes last by name."""
    (tmp_path / "a.csv").write_text("import_name,dist_name\nx,first\n")
    (tmp_path / "b.csv").write_text("import_name,dist_name\n" + "y,other\n" * 200 + "x,last\n")
    got = FS.load_aliases(spark, str(tmp_path))
    assert {r[0]: r[1] for r in got.collect()} == {"x": "last", "y": "other"}


def test_prompt_positions(spark, tmp_path, small_splits):
    """Entries are numbered by file and place over many splits; several files of one folder
    count on; a null file name is a folder like any other."""
    want = {}
    for i, n in enumerate(SIZES):
        folder = tmp_path / f"file=f{i % 4}"
        folder.mkdir(exist_ok=True)
        (folder / f"part-{i:02d}.json").write_text("".join(
            json.dumps({"id": f"p{i}-{k}", "text": "t" * (k % 50)}) + "\n" for k in range(n)))
    for f in range(4):
        ids = [f"p{i}-{k}" for i, n in enumerate(SIZES) if i % 4 == f for k in range(n)]
        want.update({p: (f"f{f}", at) for at, p in enumerate(ids)})
    rows = FS.scan_prompt_corpus(spark, str(tmp_path)).select("id", "file", "ord").collect()
    assert {r["id"]: (r["file"], r["ord"]) for r in rows} == want and len(rows) == len(want)


def test_corpus_round_trip(spark, tmp_path):
    rows = [(f"e{n}", f"file-{n % 3}.yaml", 1000 - n) for n in range(500)]
    corpus = spark.createDataFrame(rows, "id string, file string, ord long").withColumns(
        {c: F.lit("x") for c in ("ecosystem", "domain", "specificity", "text")}).repartition(7)
    FS.write_prompt_corpus(corpus, str(tmp_path / "corpus"))
    got = FS.scan_prompt_corpus(spark, str(tmp_path / "corpus")).select("id", "file", "ord")
    want = []
    for f in range(3):
        ids = [r[0] for r in sorted(rows, key=lambda r: r[2]) if r[1] == f"file-{f}.yaml"]
        want += [(i, f"file-{f}.yaml", at) for at, i in enumerate(ids)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def _results(spark, rows):
    return spark.createDataFrame(
        [("python", n, status, 200, None, at) for n, status, at in rows],
        "ecosystem string, name string, status string, http_status int, detail string, "
        "checked_at string").withColumn("checked_at", F.col("checked_at").cast("timestamp"))


def _files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("part-*")}


def test_a_put_computes_its_results_once(spark, tmp_path):
    """Finding the buckets and rewriting them read the results as written, not the log again."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = _results(spark, [(f"n{i}", "exists", "2024-01-01") for i in range(30)])
    assert CT.put(rows.mapInArrow(through, rows.schema), str(tmp_path / "cache"), buckets=4) == 4
    assert seen.value == 30
    assert CT.read_cache(spark, str(tmp_path / "cache")).count() == 30


def test_cache_puts_rewrite_touched_buckets_only(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    read = lambda: {r["name"]: r["status"] for r in CT.read_cache(spark, base).collect()}
    with pytest.raises(ValueError):
        CT.read_cache(spark, base)
    first = [(f"n{i}", "exists", "2024-01-01") for i in range(200)] + [(None, "exists", None)]
    assert CT.put(_results(spark, first), base, buckets=16) == 16
    version, buckets, before = CT.manifest(spark, base)
    files = _files(tmp_path / "data")
    # one name, checked earlier than what the cache holds: the put wins; errors are not written
    put = _results(spark, [("n7", "not_found", "2023-01-01"), ("n8", "error", "2025-01-01")])
    assert CT.put(put, base, buckets=99) == 1
    want = {r[0]: r[1] for r in first} | {"n7": "not_found"}
    assert read() == want and CT.read_cache(spark, base).count() == 201
    _, same, after = CT.manifest(spark, base)
    assert same == buckets == 16 and sum(before[b] != after[b] for b in before) == 1
    assert files.items() <= _files(tmp_path / "data").items()
    assert CT.put(_results(spark, [("n9", "error", "2025-01-01")]), base) == 0
    # a put that fails before its commit: the cache stays as it was
    commit = CT._MANIFEST
    monkeypatch.setattr(CT, "_MANIFEST", "no schema")
    with pytest.raises(Exception):
        CT.put(_results(spark, [("n1", "not_found", "2026-01-01")]), base)
    monkeypatch.setattr(CT, "_MANIFEST", commit)
    assert read() == want
    assert CT.put(_results(spark, [("n1", "not_found", "2026-01-01"), ("new", "exists", None)]),
                  base) in (1, 2)
    assert read() == want | {"n1": "not_found", "new": "exists"}
