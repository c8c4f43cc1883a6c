"""Structured Streaming forms of the pipeline.

Arriving run records / responses are JSON files in a folder. Each stream checkpoints
under the shared checkpoint location, so a restarted job resumes where it stopped;
sinks are idempotent per micro-batch (a batch re-run after a failure rewrites its own
folder only).

* T1 extraction is stateless (append).
* T2 new names: the stream keeps no state. Known names are a table, and each micro-batch
  writes those of its names that the table lacks.
* T3 running recurrence: the stream keeps no state. Each micro-batch writes its run indexes as
  bits, numerators and denominators under one batch id; the reader ORs the batches that both
  tables have, so a rate's two halves are always of one instant.
* T4 progress counters: a global streaming aggregate.
* T5 exactly-once resume: ``foreachBatch`` writes each batch's completed keys to a
  folder named by the batch id; pending work is the plan anti-joined with that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from namewatch import schemas
from namewatch.operators import extract as X
from namewatch.operators import increments as INC
from namewatch.operators import report as R
from namewatch.sources import files as FS

RESPONSES = StructType(
    [
        StructField("response_id", LongType()),
        StructField("ecosystem", StringType()),
        StructField("response_text", StringType()),
    ]
)

RUN_RECORDS = StructType([*schemas.RUNS.fields, StructField("response_id", LongType())])


def read_stream(spark: SparkSession, path: str, schema: StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON files; Spark's own number of files per trigger unless given."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


# ------------------------------------------------------------------ operators
def stream_mentions(responses: DataFrame, vocab: X.Vocabulary) -> DataFrame:
    """Incremental extraction (stateless; the vocabulary is a static broadcast
    dimension)."""
    return X.mentions_of(X.extract_resolved(responses, vocab))


def stream_progress(runs: DataFrame) -> DataFrame:
    """T4: live counters."""
    return runs.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("ok")).alias("ok"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("truncated")).alias("truncated"),
    )


# ------------------------------------------------------------------ sinks
def run_append(df: DataFrame, path: str, checkpoint: str) -> None:
    """Stateless or append-mode stream -> Parquet folder (file sink with its own log:
    exactly-once), processing what is available now."""
    (df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start(path).awaitTermination())


def _batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}")

    return write


def run_update(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Stateful aggregate -> one folder per micro-batch (idempotent rewrite on retry)."""
    (df.writeStream.foreachBatch(_batch_writer(path)).option("checkpointLocation", checkpoint)
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current value of each key of an update-mode sink (latest batch wins)."""
    df = spark.read.parquet(path)
    if not keys:
        latest = df.agg(F.max("batch_id")).scalar()
        return df.filter(F.col("batch_id") == latest).drop("batch_id", "batch")
    vals = [c for c in df.columns if c not in keys and c not in ("batch_id", "batch")]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*vals), F.col("batch_id")).alias("v")).select(*keys, "v.*")


# Folders that known names are split into by hash: a micro-batch reads those it touches.
NAME_BUCKETS = 64
_KNOWN = "ecosystem string, name string, stream string, batch long, bucket int"


def known_names(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`new_name_sink` writes: ``(ecosystem, name, stream, batch,
    bucket)``, each name once."""
    streams = FS.folders(spark, path)
    if not any(FS.written_parts(spark, f"{path}/{s}") for s in streams):
        return spark.createDataFrame([], _KNOWN)
    return spark.read.schema(_KNOWN).parquet(path)


def new_name_sink(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """Names that no batch before has, of this stream or of any other that writes to
    ``path``, land in ``path/stream=<stream>/batch=<id>``.

    ``stream`` names the checkpoint that batch ids belong to. A batch that runs again after a
    failure does not see its own earlier output and replaces it. Streams that share a path run
    one after another."""
    keys = ["ecosystem", "name"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        names = batch.select(*keys).distinct().withColumn(
            "bucket", F.pmod(F.xxhash64(*keys), F.lit(NAME_BUCKETS)).cast("int")).persist()
        touched = [r[0] for r in names.select("bucket").distinct().collect()]
        own = (F.col("stream") == stream) & (F.col("batch") >= batch_id)
        known = known_names(spark, path).filter(F.col("bucket").isin(touched) & ~own)
        same = [names[k].eqNullSafe(known[k]) for k in ("bucket", *keys)]
        names.join(known, same, "left_anti").write.mode("overwrite").partitionBy("bucket") \
            .parquet(f"{path}/stream={stream}/batch={batch_id}")
        names.unpersist()

    return write


def recurrence_sink(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """The run indexes of each micro-batch of run records, as bits: what each name
    appeared in (``path/mentions``) and what each cell ran (``path/cells``), in folders named
    by stream and batch. A batch that runs again replaces its folders."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        part = f"{stream}-{batch_id}"
        INC.mention_bits(R.explode_packages(batch)).write.mode("overwrite").parquet(
            f"{path}/mentions/{part}")
        INC.cell_bits(batch).write.mode("overwrite").parquet(f"{path}/cells/{part}")
        batch.unpersist()

    return write


def read_recurrence(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Recurrence of all batches that both tables have, whole: a batch whose second write has
    not ended yet counts in neither half."""
    parts = sorted(set(FS.written_parts(spark, f"{path}/mentions"))
                   & set(FS.written_parts(spark, f"{path}/cells")))
    if not parts:
        raise ValueError(f"no complete batch in {path}")
    mentions, cells = (spark.read.parquet(*(f"{path}/{kind}/{p}" for p in parts))
                       for kind in ("mentions", "cells"))
    return INC.recurrence_of_bits(mentions, cells, registry)


def run_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """A stateless stream into a batch sink, processing what is available now."""
    (df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def resume_sink(plan_keys: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """T5: each batch's completed task keys land in ``path/batch=<id>``; rewriting a batch
    after a failure replaces only its own folder, so every key is recorded once per
    batch whatever the retries."""
    keys = ["prompt_id", "model_id", "run_index"]

    def write(batch: DataFrame, batch_id: int) -> None:
        done = batch.filter(F.col("ok")).select(*keys).distinct()
        done.join(plan_keys, keys, "left_semi").write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}")

    return write
