"""The registry cache as a stored table with keyed upserts.

Rows lie in folders by the hash of their key. A put reads and rewrites only the buckets that its
names fall into, under a folder of its own, and then commits a manifest that says which folder
holds which bucket. Buckets without a new name keep their files. Readers follow the last manifest
whose write ended, so a put that fails leaves them with what they had.

The manifest has one row per bucket (``BUCKETS`` at most); it and the numbers of the touched
buckets are all that the driver sees. One writer at a time: a second one that commits the same
version fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namewatch.operators import lookups as L
from namewatch.sources import files as FS

BUCKETS = 64
COLUMNS = ["ecosystem", "name", "status", "http_status", "detail", "checked_at"]
_MANIFEST = "bucket int, folder string, buckets int"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*L.KEY), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, base: str) -> tuple[int, int | None, dict[int, str]]:
    """``(version, number of buckets, folder of each bucket)``; version 0 before the first put."""
    done = FS.written_parts(spark, f"{base}/manifests")
    if not done:
        return 0, None, {}
    rows = spark.read.schema(_MANIFEST).parquet(f"{base}/manifests/{done[-1]}").collect()
    return int(done[-1]), rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows}


def _rows(spark: SparkSession, base: str, held: dict[int, str]) -> DataFrame:
    return spark.read.parquet(*(f"{base}/{folder}/bucket={b}" for b, folder in held.items()))


def read_cache(spark: SparkSession, base: str) -> DataFrame:
    """The cache after the last put that was committed."""
    _, _, held = manifest(spark, base)
    if not held:
        raise ValueError(f"{base} holds no cache yet")
    return _rows(spark, base, held).select(*COLUMNS)


def put(results: DataFrame, base: str, buckets: int = BUCKETS) -> int:
    """Put the definitive ones of ``results`` into the cache at ``base``, by the rules of
    ``lookups.cache_put``; the number of buckets that were rewritten. ``buckets`` counts for a
    new table only. Null names and ecosystems are keys like others. The results are written to
    the scratch folder first, so that what they derive from is computed once."""
    spark = results.sparkSession
    version, held_buckets, held = manifest(spark, base)
    buckets = held_buckets or buckets
    new = FS.stored(results.filter(L.is_definitive(F.col("status"))).select(*COLUMNS), "cache-put")
    touched = sorted(r[0] for r in new.select(_bucket(buckets).alias("b")).distinct().collect())
    if not touched:
        return 0
    known = {b: held[b] for b in touched if b in held}
    old = _rows(spark, base, known).select(*COLUMNS) if known else new.limit(0)
    folder = f"data/{uuid.uuid4().hex}"
    L.cache_put(old, new).withColumn("bucket", _bucket(buckets)).write.partitionBy("bucket") \
        .parquet(f"{base}/{folder}")
    held.update({b: folder for b in touched})
    spark.createDataFrame([(b, f, buckets) for b, f in sorted(held.items())], _MANIFEST) \
        .coalesce(1).write.parquet(f"{base}/manifests/{version + 1:010d}")
    return len(touched)
