"""File sources and sinks.

Run records are newline-delimited JSON with a declared schema; analysis tables are
Parquet. Writes go through Spark's output committer (a failed job leaves nothing
committed); re-writes create a new version instead of overwriting the data being read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from namewatch import schemas
from namewatch.functions.text import ustrip
from namewatch.operators.lookups import latest_status
from namewatch.session import checkpoint_dir

CORRUPT = "_corrupt_record"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint location (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a fresh scratch folder and read back: however often it is used, what
    it derives from is computed once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it does not exist."""
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(here):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(here) if s.isDirectory())


def written_parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` whose write ended (Spark's marker lies in them)."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f for f in folders(spark, path) if fs.exists(of(f"{path}/{f}/_SUCCESS"))]


# ------------------------------------------------------------------ position in files
def with_place(rows: DataFrame, out: str = "place") -> DataFrame:
    """``rows`` as read from files, with a struct that sorts them by file path, then by
    position in the file.

    Spark packs files and splits into tasks by size, so a row number of the whole scan does
    not follow file names. Within one split rows keep their order, and splits of a file are
    told apart by where they start."""
    return rows.withColumn(out, F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row")))


def with_ordinals(rows: DataFrame, keys: list[str], out: str = "ord",
                  place: str = "place") -> DataFrame:
    """``rows (.., place)`` numbered from 0 within ``keys`` in order of place: rows of a split
    by their number in it, plus what the splits before hold. Only one row per split is
    windowed; the rows themselves are not sorted or moved."""
    split = [*keys, f"{place}.path", f"{place}.start"]
    sizes = rows.groupBy(*(F.col(c).alias(f"k{i}") for i, c in enumerate(split))).agg(
        F.count(F.lit(1)).alias("n"), F.min(f"{place}.row").alias("first"))
    names = [f"k{i}" for i in range(len(split))]
    before = Window.partitionBy(*names[:len(keys)]).orderBy(*names[len(keys):]).rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(split, names)]
    return rows.join(sizes, same).withColumn(
        out, F.col("before") + F.col(f"{place}.row") - F.col("first")).drop(
        *names, "n", "first", "before")


# ------------------------------------------------------------------ run records
def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records from JSON lines, schema declared (never inferred)."""
    return spark.read.schema(schemas.RUNS).json(path)


def scan_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry snapshot, projected to the three columns the analysis joins on."""
    return spark.read.schema(schemas.REGISTRY).json(path).select("ecosystem", "name", "status")


def scan_tolerant(spark: SparkSession, path: str, schema=schemas.RUNS,
                  strict: bool = False) -> DataFrame:
    """Tolerant scan skips blank and malformed lines (resume, name collection);
    ``strict`` fails on the first malformed line (re-extraction input)."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    with_corrupt = (StructType([*schema.fields, StructField(CORRUPT, StringType())])
                    if CORRUPT not in schema.fieldNames() else schema)
    df = (
        spark.read.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def append_runs(records: DataFrame, path: str) -> None:
    """Append records (one JSON line each); earlier files are never touched."""
    records.write.mode("append").json(path)


def run_records_with_packages(runs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Run records carrying their ``packages`` list (successful runs only have packages).
    One group per response, bounded by its mentions."""
    pk = mentions.groupBy("response_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("mention_idx").alias("i"),
            F.struct(F.col("name").alias("raw"), "name", "ecosystem", "source", "origin",
                     "alias_resolved").alias("p"))
        )).alias("l")
    ).select("response_id", F.transform("l", lambda x: x["p"]).alias("packages"))
    empty = F.array().cast(f"array<{schemas.PACKAGE.simpleString()}>")
    return runs.join(pk, "response_id", "left").withColumn(
        "packages", F.coalesce(F.col("packages"), empty))


# ------------------------------------------------------------------ snapshots and cache
def snapshot_id(ts) -> object:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def write_snapshot(results: DataFrame, snapshot_at: str, path: str) -> None:
    """Append one existence snapshot, partitioned by its instant; earlier snapshots
    stay (the reference's writer replaced the file although its docs promise a new
    snapshot per pass)."""
    ts = F.lit(snapshot_at).cast("timestamp")
    (results.withColumn("snapshot_at", ts).withColumn("snapshot_id", snapshot_id(ts))
     .write.mode("append").partitionBy("snapshot_id").parquet(path))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def current_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(ecosystem, name, status)`` per name: its entry in the latest snapshot that
    has it, ready for the join with mentions."""
    latest = latest_status(read_snapshots(spark, path), ["snapshot_at", "checked_at", "status"])
    return latest.select("ecosystem", "name", "status")


# ------------------------------------------------------------------ prompt corpus
def write_prompt_corpus(corpus: DataFrame, path: str) -> None:
    """A prompt corpus as files, one folder per source file name, its entries in their order
    (``ord``, which is not written: a reader knows it from the position)."""
    corpus.orderBy("file", "ord").drop("ord").write.mode("overwrite").partitionBy("file") \
        .json(path)


def scan_prompt_corpus(spark: SparkSession, path: str) -> DataFrame:
    """S3 source: every prompt file under ``path`` (``file`` from the folder name, ``ord``
    the entry's position within its file, counted from 0)."""
    rows = spark.read.schema(schemas.PROMPTS).json(path)
    return with_ordinals(with_place(rows), ["file"]).drop("place")


# ------------------------------------------------------------------ vocabularies
def load_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """A word list file: strip, drop blank and '#' lines, dedupe."""
    lines = spark.read.text(path).select(ustrip(F.col("value")).alias("word"))
    return lines.filter((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Import name -> distribution name (CSV files with a header); the last entry of a
    name wins, in order of file path, then of line."""
    rows = with_place(spark.read.schema(schemas.ALIASES).option("header", True).csv(path))
    return rows.filter(F.col("import_name").isNotNull()).groupBy("import_name").agg(
        F.max_by("dist_name", "place").alias("dist_name"))


# ------------------------------------------------------------------ versioned rewrite
def write_version(df: DataFrame, base: str, version: int) -> None:
    """Write a new version of a table next to the old ones (never over the path being
    read), then commit it. Every write has a folder of its own, named in its commit, so a
    write that fails or runs twice leaves what readers follow as it is. A version that is
    committed already is refused."""
    spark = df.sparkSession
    if commits(spark, base).filter(F.col("version") == version).limit(1).count():
        raise ValueError(f"version {version} of {base} is committed already")
    folder = f"version={version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{folder}")
    spark.range(1).select(
        F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"),
        F.current_timestamp().alias("at")).coalesce(1).write.mode("append") \
        .parquet(f"{base}/_commits")


def commits(spark: SparkSession, base: str) -> DataFrame:
    """The commits of a versioned table (none before its first)."""
    schema = "version long, folder string, at timestamp"
    if "_commits" not in written_parts(spark, base):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/_commits")


def read_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    """A committed version (of two writers that committed it at once, the first)."""
    row = commits(spark, base).filter(F.col("version") == version).orderBy("at", "folder") \
        .select("folder").first()
    if row is None:
        raise ValueError(f"version {version} of {base} is not committed")
    return spark.read.parquet(f"{base}/{row[0]}")


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """The version committed last."""
    row = commits(spark, base).orderBy(F.desc("at"), F.desc("version")).select("version").first()
    if row is None:
        raise ValueError(f"{base} has no committed version")
    return read_version(spark, base, row[0])
