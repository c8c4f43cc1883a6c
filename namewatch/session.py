"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the engine's plans assume (AQE re-plans joins from measured sizes and splits
# skewed partitions; UTC keeps timestamps comparable with the SQL oracle).
ENGINE_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state (dedupe keys, per-cell counts) in RocksDB: off-heap, spills to local
    # disk, checkpointed incrementally, so state sized by distinct names does not live in
    # executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# What a task reads of a shuffle, in MB at most as far as the shuffle has partitions for it. A
# join's and an aggregate's sorted rows take ten to twenty times their compressed size in
# memory, several of them in one stage. Sessions that ask for less keep it.
TASK_READ_MB = 8
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

# What may become a broadcast join, in MB at most. Spark goes by compressed files: a registry of
# 6 MB there was about 500 MB as a hash table, held beside every task's own rows.
BROADCAST_MB = 1
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
_AQE_BROADCAST = "spark.sql.adaptive.autoBroadcastJoinThreshold"
_UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def _bytes(size: str) -> int:
    """Bytes of a size as Spark's settings state it (``64m``, ``16 KB``, ``1024``)."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([bkmgt]?)b?", size.strip().lower()).groups()
    return int(number) << _UNITS[unit]


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "namewatch",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session for tests, benches and local runs. On a cluster, use the cluster's own
    session and call :func:`apply_engine_conf` on it."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("NAMEWATCH_DRIVER_MEMORY", "16g"))
    )
    for key, value in {**ENGINE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_engine_conf(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings the plans rely on, and see that they took effect
    (idempotent). Settings that a running session cannot change must already be right."""
    for key, value in ENGINE_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    if _bytes(spark.conf.get(_ADVISORY)) > TASK_READ_MB << 20:
        spark.conf.set(_ADVISORY, f"{TASK_READ_MB}m")
    for key, held in ((_BROADCAST, spark.conf.get(_BROADCAST)),
                      (_AQE_BROADCAST, spark.conf.get(_AQE_BROADCAST, None))):
        if held and _bytes(held) > BROADCAST_MB << 20:
            spark.conf.set(key, f"{BROADCAST_MB}m")
    strict = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    if strict != ENGINE_CONF["spark.sql.variant.allowDuplicateKeys"]:
        raise RuntimeError("spark.sql.variant.allowDuplicateKeys must be true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables, from ``spark.checkpoint.dir``.

    Where it is unset, a local master (one machine: tests, benches) gets a folder of its own;
    on a cluster that is an error, as executors would not see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="namewatch-ckpt-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch
