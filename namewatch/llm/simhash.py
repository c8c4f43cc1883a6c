"""SimHash near-dedup with Golay-code keys.

Fingerprints are 64 bits; two link when at most three bits differ. The candidate search is
Golay-code fuzzy hashing:

* The binary Golay code (23, 12, 7) is perfect: every 23-bit word has exactly one codeword
  within distance 3. If a segment x of one fingerprint and the same segment y of another
  differ in at most one bit, the codeword nearest to x is within distance 4 of y.
* A word has one codeword within distance 4 if its nearest is at distance 2 or less, and six
  otherwise (the nearest and the five weight-7 neighbours that cover its three wrong bits).
* The 64 bits are cut into segments of 21, 21 and 22 bits. At most three wrong bits leave at
  least two segments with at most one wrong bit each (pigeonhole), so for one of the three
  pairs of segments both codeword indices meet.

A fingerprint is filed under the nearest codewords of each pair of segments (three keys) and
looks under all near codewords of each pair (about 84 keys). The join checks the bit distance
itself, so nothing but true links leaves it, and none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from namewatch.llm.common import LOWER_AZ, connected_components, fresh, materialise

MAX_BITS = 3
SHINGLE = 3
SEED = 42

# Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary Golay code.
GOLAY = 0b110001110101
SEGMENTS = ((0, 21), (21, 21), (42, 22))   # (first bit, bits), each at most 23 bits
PAIRS = ((0, 1), (0, 2), (1, 2))
_BLOCK = 1 << 15                           # hashes counted at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text; zero for a text without words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER_AZ).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _BLOCK):
        k = min(_BLOCK, n - start)
        h = np.fromiter((digest(next(grams), SEED) for _ in range(k)), np.uint64, k)
        ones += np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text_col: str, shingle: int = SHINGLE):
    """Signed 64-bit fingerprint of a text column (the same bits as :func:`fingerprint`)."""

    @F.pandas_udf(LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts],
                                  np.uint64).view(np.int64))

    return fingerprints(F.col(text_col).cast("string"))


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``parity`` of each 12-bit message, nearest ``error`` of each syndrome, and ``others``:
    per syndrome the indices of the five weight-7 codewords over a three-bit error (else -1).
    A codeword's index is its message, so indices add like codewords."""
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    parity = np.array([remainder(m << 11) for m in range(4096)], np.int64)
    words = (np.arange(4096, dtype=np.int64) << 11) | parity
    weight = np.bitwise_count(words)
    error = np.zeros(2048, np.int64)
    bits = [1 << i for i in range(23)]
    triples = [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i])
               for c in bits[:j]]
    pairs = [a | b for i, a in enumerate(bits) for b in bits[:i]]
    patterns = np.array([0, *bits, *pairs, *triples], np.int64)
    syndrome = (patterns & 2047) ^ parity[patterns >> 11]
    error[syndrome] = patterns
    others = np.full((2048, 5), -1, np.int64)
    blocks = words[weight == 7]
    for s, e in zip(syndrome[-len(triples):], patterns[-len(triples):]):
        others[s] = blocks[(blocks & e) == e] >> 11
    return parity, error, others


def near_codewords(segment: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each segment: the nearest first, then
    five more or -1."""
    parity, error, others = golay_tables()
    syndrome = (segment & 2047) ^ parity[segment >> 11]
    nearest = (segment ^ error[syndrome]) >> 11
    more = others[syndrome]
    return np.hstack([nearest[:, None], np.where(more < 0, -1, more ^ nearest[:, None])])


def _keys(fps: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of the filing keys, or with ``every`` of the search keys."""
    u = fps.view(np.uint64)
    near = [near_codewords(((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64))
            for at, n in SEGMENTS]
    rows, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        a, b = (near[i], near[j]) if every else (near[i][:, :1], near[j][:, :1])
        key = (p << 24) | (a[:, :, None] << 12) | b[:, None, :]
        row, x, y = np.nonzero((a >= 0)[:, :, None] & (b >= 0)[:, None, :])
        rows.append(row)
        keys.append(key[row, x, y])
    return np.concatenate(rows), np.concatenate(keys)


def _with_keys(fps: DataFrame, every: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(values), 2048):
                part = values[at:at + 2048]
                row, key = _keys(part, every)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])],
                                                 names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Every pair ``(a, b)``, a < b, of distinct fingerprints in ``fps (fp)`` that differ in
    at most ``max_bits`` (1 to 3) bits."""
    if not 1 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be between 1 and {MAX_BITS}: {max_bits}")
    filed = _with_keys(fps, every=False).select("key", F.col("fp").alias("a"))
    sought = _with_keys(fps, every=True).select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return filed.join(sought, (filed["key"] == sought["key"]) & near).select("a", "b").distinct()


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, component_id, keep_fp)`` for each distinct fingerprint of ``prints (id, fp)``:
    the smallest id of its component and the fingerprint which that id has there.

    Equal fingerprints collapse into one row first, so a group of copies of any size costs
    one row in the search. Null ids are passed over; a component of null ids only has a null
    id.
    """
    firsts = materialise(prints.groupBy("fp").agg(F.min("id").alias("id")), "simhash-fp")
    roots = connected_components(links(firsts, max_bits), "simhash-cc")
    member = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root"))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("fp"))
    best = member.groupBy("root").agg(F.min(rank).alias("best"))
    return member.join(best, "root").select(
        "fp", F.col("best.id").alias("component_id"), F.col("best.fp").alias("keep_fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row ``(id, fingerprint, component_id)`` per document.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows
    come back once each, with the same component. A null id keeps its row; it is never a
    component id unless the component has no other.
    """
    prints = materialise(docs.select(F.col(id_col).alias("id"),
                                     fingerprint_column(text_col, shingle).alias("fp")),
                         "simhash")
    found = groups(prints, max_bits).select("fp", "component_id")
    return prints.join(found, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (of rows
    that repeat this id and fingerprint, one)."""
    fp, rid = fresh(docs.columns, "nw_fp", "nw_rid")
    marked = materialise(docs.withColumns({
        fp: fingerprint_column(text_col, shingle), rid: F.monotonically_increasing_id()}),
        "simhash-docs")
    slim = marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"),
                         F.col(rid).alias("row"))
    keep = groups(slim, max_bits).select(
        F.col("component_id").alias("kid"), F.col("keep_fp").alias("kfp")).distinct()
    # only row numbers meet the documents, so their texts move once
    chosen = slim.join(keep, slim["id"].eqNullSafe(keep["kid"]) & (slim["fp"] == keep["kfp"])) \
        .groupBy("kid", "kfp").agg(F.min("row").alias(rid)).select(rid)
    return marked.join(chosen, rid, "left_semi").select(*docs.columns)
