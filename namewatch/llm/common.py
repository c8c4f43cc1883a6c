"""Helpers shared by the corpus operators: words, scratch tables, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namewatch.session import checkpoint_dir

# A word is a maximal run of characters other than these ASCII whitespace characters.
# ``bytes.split()`` without arguments splits on exactly the same set.
SPACES = r"[\x20\x09-\x0D]+"

# A-Z to a-z, every other byte unchanged (valid on UTF-8: multi-byte characters have no
# byte below 0x80).
LOWER_AZ = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

# Python objects made from text at one time, in bytes of text. It bounds worker memory
# whatever the Arrow batch size is; no result depends on it.
CHUNK_BYTES = 4 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, unless ``PYTHONPATH`` does.

    The driver's copy is sent with ``addPyFile``, once for each application.
    """
    package = Path(__file__).resolve().parents[1]
    root, sc = package.parent, spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if sc.applicationId in _shipped or any(p and Path(p).resolve() == root for p in paths):
        return
    archive = Path(tempfile.mkdtemp()) / "namewatch.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(root))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage with files that every executor can read, so the loss of an executor costs
    no recomputation. The shuffle files of the finished job are dropped at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/namewatch-llm/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(names: Sequence[str], *wanted: str) -> list[str]:
    """Column names built from ``wanted`` that clash with none of ``names`` (Spark's column
    names ignore case)."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(text_col: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def words_of(text_col: str) -> Column:
    """Words of a text as an array (null: none)."""
    return F.array_remove(F.split(text_of(text_col), SPACES), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ``[start, end)`` ranges of ``texts`` of about ``limit`` characters each;
    a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of undirected ``edges (a, b)`` of longs; root is the
    smallest node of the component.

    Alternating large-star and small-star steps: each step is one aggregate and one join on
    a node, so no component is ever gathered in one place, and the number of rounds grows
    with the logarithm of a component's size. Each round is written out. Self loops and
    repeated edges are allowed; nulls are not.
    """
    pairs = (edges.where("a <> b")
             .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    pairs = materialise(pairs, label)
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # large star: every larger neighbour of v is linked to the smallest node around v
        large = (both.join(low, "v").where(F.col("u") > F.col("v"))
                 .select(F.col("u").alias("v"), F.col("m").alias("u")))
        large = materialise(large.where("u < v").distinct(), label)
        # small star: every smaller neighbour of v, and v, are linked to the smallest one
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(
            F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
                              F.struct(F.col("v"), F.col("m").alias("u")))).alias("e")
        ).select("e.v", "e.u").where("u < v").distinct()
        pairs = materialise(small, label)
        now = tuple(pairs.agg(F.count(F.lit(1)),
                              F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


