"""Secret scans over an incremental blob ledger.

Every historical version of a text is a blob, named by its content (SHA-256). The ledger says
which blob was scanned with which version of the rules and what was found. A run scans only
the pairs of blob and rule version that the ledger lacks, each blob once however many paths
hold it, appends them to the ledger, and joins the findings back to all paths.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from namewatch.llm.common import materialise, text_of

# Fixed patterns. Letters outside classes match in either case where marked (?i).
RULES: dict[str, tuple[re.Pattern, int, int]] = {
    # kind: (pattern, group whose length counts, least length)
    "assign": (re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
        r"([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
    # spans beyond the base rules
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    "slack": (re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    # three runs with dots between, see _triples: [A-Za-z0-9_-]*eyJ<8+>.eyJ<8+>.<8+>
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+"), 0, 30),
    "pem": (re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"), 0, 20),
}
BASE = ("assign", "access", "hex")
TRIPLES = {"jwt": ("eyJ", 8)}     # kinds read by _triples: start of two runs, characters after it

_SPANS = "array<struct<kind:string,start:int,stop:int>>"


def rule_version(rules: dict = RULES) -> str:
    """The content of the rules: other patterns, bounds or order give another version."""
    said = repr([(kind, pattern.pattern, pattern.flags, group, least, TRIPLES.get(kind))
                 for kind, (pattern, group, least) in rules.items()])
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def _triples(chain: re.Match, start: str, least: int) -> Iterator[tuple[int, int]]:
    """Spans in runs joined by dots: from ``start`` in one run, over a run that begins with
    it, to the end of the next, each with ``least`` or more characters after ``start`` (the
    last one: in all). What a pattern of three unbounded runs finds, in one pass."""
    at, runs = chain.start(), []
    for run in chain.group().split("."):
        runs.append((at, run))
        at += len(run) + 1
    i = 0
    while i + 2 < len(runs):
        (at, first), (_, second), (last, third) = runs[i:i + 3]
        k = first.find(start)
        if k >= 0 and len(first) - k >= len(start) + least and second.startswith(start) \
                and len(second) >= len(start) + least and len(third) >= least:
            yield at + k, last + len(third)
            i += 3
        else:
            i += 1


def find_spans(text: str | None, rules: dict = RULES) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then in the order of the rules; offsets are code points.

    Per kind, matches are leftmost and non-overlapping; those too short are dropped without
    another try. (A run of 16 hex digits starts where the run starts, so the pattern for runs
    of any length and the one for 16 or more find the same spans.)
    """
    if not text:
        return []
    out = []
    for order, (kind, (pattern, group, least)) in enumerate(rules.items()):
        for m in pattern.finditer(text):
            if kind in TRIPLES:
                out += [(a, order, kind, b) for a, b in _triples(m, *TRIPLES[kind])
                        if b - a >= least]
            elif m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


LEDGER = f"blob binary, rules string, spans {_SPANS}"
TEXTS_PER_FILE = 16   # partitions of texts whose spans go into one file, see gathered


def empty_ledger(spark: SparkSession) -> DataFrame:
    """No rows, known to Spark as such: a join with it is planned away, and no Python worker
    starts for it (``createDataFrame`` of a list reads it in workers)."""
    return spark.range(0).where(F.lit(False)).select(
        *(F.lit(None).cast(field.dataType).alias(field.name)
          for field in StructType.fromDDL(LEDGER)))


def _committed(spark: SparkSession, folder: str) -> list[str]:
    """Parts of a stored ledger whose write ended (Spark's own marker lies in them)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(path)
                  if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The stored ledger: all parts whose write ended, one row per blob and rule version
    (parts of runs that overlapped may repeat one). A folder that does not exist yet is empty."""
    parts = _committed(spark, folder)
    if not parts:
        return empty_ledger(spark)
    return spark.read.schema(LEDGER).parquet(*parts).dropDuplicates(["blob", "rules"])


def append_ledger(new: DataFrame, folder: str) -> None:
    """Store new rows as a part of their own. Until its write ends, readers do not see it; a
    run that fails leaves nothing that counts."""
    gathered(new.select("blob", "rules", "spans")).write.option("compression", "zstd").parquet(
        f"{folder}/part-{uuid.uuid4().hex}")


def gathered(derived: DataFrame) -> DataFrame:
    """``derived``, rows of about a tenth of their texts or less, in one partition for every
    ``TEXTS_PER_FILE`` of a shuffle of texts (by the session's setting, and one for each core at
    least), so in fewer files.

    On a local file system without native code, an executor starts ``chmod`` for each file it
    writes, for its checksum and for their folder. Until its program starts, such a child
    shares all of the executor's memory and is counted with it.
    """
    spark = derived.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return derived.repartition(
        min(tasks, max(-(-tasks // TEXTS_PER_FILE), spark.sparkContext.defaultParallelism)))


def with_blobs(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with the content address of the text (null counts as the empty text)."""
    return docs.withColumn(out, F.unhex(F.sha2(text_of(text_col), 256)))


def scan_unseen(paths: DataFrame, ledger: DataFrame, rules: dict = RULES) -> DataFrame:
    """New ledger rows: each blob of ``paths (blob, text)`` that the ledger lacks for these
    rules, scanned once."""
    version = rule_version(rules)
    seen = ledger.where(F.col("rules") == version).select("blob")
    unseen = paths.select("blob", "text").dropDuplicates(["blob"]).join(seen, "blob", "left_anti")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[{"kind": k, "start": s, "stop": e} for k, s, e in find_spans(t, rules)]
                     for t in batch["text"]]
            yield pd.DataFrame({"blob": batch["blob"], "rules": version, "spans": spans})

    return unseen.select("blob", "text").mapInPandas(
        scan, f"blob binary, rules string, spans {_SPANS}")


def _with_paths(paths: DataFrame, ledger: DataFrame, rules: dict, id_col: str) -> DataFrame:
    current = ledger.where(F.col("rules") == rule_version(rules)).select("blob", "spans")
    return paths.select("id", "blob").join(current, "blob").select(
        F.col("id").alias(id_col), "blob", "spans")


def _paths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_blobs(docs.select(F.col(id_col).alias("id"),
                                  text_of(text_col).alias("text")), "text", "blob")


def scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id",
         text_col: str = "text", rules: dict = RULES) -> tuple[DataFrame, DataFrame]:
    """``(findings, ledger)``: the spans of every row of ``docs`` as ``(id, blob, spans)``,
    and the ledger with the newly scanned blobs.

    Rows that repeat, share a text or have a null id all come back, each once. Null and empty
    texts have no spans.
    """
    known = ledger.dropDuplicates(["blob", "rules"]) if ledger is not None \
        else empty_ledger(docs.sparkSession)
    paths = _paths(docs, id_col, text_col)
    full = known.unionByName(materialise(scan_unseen(paths, known, rules), "ledger"))
    return _with_paths(paths, full, rules, id_col), full


def scan_stored(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                rules: dict = RULES) -> DataFrame:
    """Findings of every row of ``docs``, as :func:`scan` gives them, through the ledger stored
    in ``folder``: blobs that it lacks for these rules are scanned and appended, all others
    are read from it."""
    spark = docs.sparkSession
    paths = _paths(docs, id_col, text_col)
    append_ledger(scan_unseen(paths, read_ledger(spark, folder), rules), folder)
    return _with_paths(paths, read_ledger(spark, folder), rules, id_col)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per path: counts of the base kinds, a hash of the base spans, all spans."""
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return findings.select(
        id_col, *(of(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
