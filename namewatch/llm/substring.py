"""Substring dedup with difference-cover anchors.

A window is 35 consecutive words; each word inside a window whose sequence also starts
somewhere else is removed. Windows are not compared one by one:

* Positions whose remainder modulo 21 is in a difference cover are anchors (5 of 21). For any
  two positions some shift below 21 takes both to anchors, so two equal windows share an
  aligned anchor of 15 words (21 + 15 - 1 = 35).
* Each anchor carries a hash of its 15 words and one of its context: all words that a window
  around the anchor can reach, 20 to the left and 35 from the anchor on. An anchor whose words
  occur once needs nothing more. Anchors that agree in their context extend to all of it, so
  every window around them is repeated.
* Where a match ends inside the context, the windows around one anchor of each context are
  hashed and compared. These are the edges of matches only.

Equal anchors meet by an aggregation of their hash, never as pairs. A chunk of texts reports a
hash and context once however often it saw them. A hash that a chunk saw in several contexts is
certainly repeated; its contexts then travel by hash and context, and only one mark by the hash
alone. So passages that very many documents share are spread, and cost one row for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namewatch.llm.common import chunks, materialise

WINDOW = 35
PERIOD = 21
COVER = (3, 6, 7, 12, 14)       # differences give every remainder modulo 21
ANCHOR = WINDOW - PERIOD + 1

_BASE1, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


class Hasher:
    """Hashes of word ranges of one list of words, from prefix sums of a polynomial."""

    def __init__(self, words: list[bytes], base: int):
        digest = xxhash.xxh3_64_intdigest
        n = len(words)
        codes = np.fromiter((digest(w) for w in words), np.uint64, n)
        self.power = np.empty(n + 1, np.uint64)
        self.power[0] = 1
        self.power[1:] = np.uint64(base)
        np.multiply.accumulate(self.power, out=self.power)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.add.accumulate(codes * self.power[:n], out=self.prefix[1:])
        self.inverse = np.empty(n + 1, np.uint64)
        self.inverse[0] = 1
        self.inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def _batches(frames: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Columns of each batch, a chunk of texts (``names[0]``) at a time."""
    for batch in frames:
        columns = [batch.column(n).to_pylist() for n in names]
        for start, end in chunks(columns[0]):
            yield tuple(c[start:end] for c in columns)


def anchor_rows(texts: list[str | None], rids: list[int]) -> tuple[np.ndarray, ...]:
    """``(hash, context, rid, position)`` of every anchor of the texts."""
    words: list[bytes] = []
    bounds = [0]
    for text in texts:
        mine = split_words(text)
        if len(mine) >= WINDOW:     # a shorter text has no window
            words += mine
        bounds.append(len(words))
    bound = np.array(bounds, np.int64)
    sizes = np.diff(bound)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(words)) - bound[owner]
    left = sizes[owner] - place
    at = np.flatnonzero((left >= ANCHOR) & np.isin(place % PERIOD, COVER))
    owner, place, left = owner[at], place[at], left[at]
    hasher = Hasher(words, _BASE1)
    before, after = np.minimum(place, PERIOD - 1), np.minimum(left, WINDOW)
    context = hasher.ranges(at - before, at + after)
    # equal contexts have equal extents on both sides
    context = (context + (before * 64 + after).astype(np.uint64)) * np.uint64(_BASE2)
    return hasher.ranges(at, at + ANCHOR), context, np.array(rids, np.int64)[owner], place


# How an anchor's row travels.
BY_HASH, KNOWN, BY_CONTEXT = 0, 1, 2


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Marks the first row of each run of equal values in sorted columns."""
    first = np.ones(len(columns[0]), bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


def _run_lengths(first: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.flatnonzero(first), len(first)))


def _anchors(docs: DataFrame) -> DataFrame:
    """Anchors of ``docs (rid, text)`` as rows ``(key, way, ctx, rid, at, n)``.

    In a chunk of texts the first anchor of each hash and context has their number n; the
    others are known to be repeated. The first ones travel by hash, or, if the chunk saw the
    hash in several contexts, by hash and context, with one mark (no rid) by the hash.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rids in _batches(frames, "text", "rid"):
            h, ctx, rid, at = anchor_rows(texts, rids)
            if not len(h):
                continue
            order = np.lexsort((at, rid, ctx, h))
            h, ctx, rid, at = h[order], ctx[order], rid[order], at[order]
            first = _first_of(h, ctx)
            n = np.zeros(len(h), np.int32)
            n[first] = _run_lengths(first)
            top = _first_of(h)
            contexts = np.add.reduceat(first.astype(np.int32), np.flatnonzero(top))
            several = np.repeat(contexts > 1, _run_lengths(top))
            way = np.where(first, np.where(several, BY_CONTEXT, BY_HASH), KNOWN).astype(np.int8)
            spread = (h ^ ctx) * np.uint64(_BASE2)
            own = (rid.view(np.uint64) * np.uint64(_BASE1) + at.astype(np.uint64)) \
                * np.uint64(_BASE2)
            key = np.choose(way, [h, own, spread])
            yield _anchor_batch(key, way, ctx, rid, at, n)
            marks = h[top & several]
            if len(marks):
                zero = np.zeros(len(marks), np.int64)
                yield _anchor_batch(marks, zero.astype(np.int8), zero.view(np.uint64), None,
                                    zero, zero.astype(np.int32))

    return docs.select("rid", "text").mapInArrow(
        run, "key long, way byte, ctx long, rid long, at int, n int")


def _anchor_batch(key, way, ctx, rid, at, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(way), pa.array(ctx.view(np.int64)),
         pa.nulls(len(key), pa.int64()) if rid is None else pa.array(rid),
         pa.array(at.astype(np.int32)), pa.array(n)],
        names=["key", "way", "ctx", "rid", "at", "n"])


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """``(rid, sure, edge)`` for texts with repeated anchors: positions whose whole context is
    repeated, and positions around which windows must be compared.

    An anchor is sure if its context occurs again. Otherwise its windows are compared with
    those of one anchor of every other context of its hash.
    """
    rows = _anchors(docs).repartition("key", "way")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    same = Window.partitionBy("key", "way", "ctx").orderBy("rid", "at")
    rows = rows.withColumns({"alike": F.sum("n").over(same.rowsBetween(*whole)),
                             "turn": F.row_number().over(same)})
    group = Window.partitionBy("key", "way")
    mark = F.col("rid").isNull()
    rows = rows.withColumns({
        "total": F.sum(F.when(mark, 2).otherwise(F.col("n"))).over(group),
        "unsure": F.max(mark | (F.col("alike") == 1)).over(group)}).where(~mark)
    by_hash = F.col("way") == BY_HASH
    sure = (F.col("way") == KNOWN) | (F.col("alike") > 1)
    edge = (F.col("turn") == 1) & ((F.col("way") == BY_CONTEXT) | (
        by_hash & F.col("unsure") & (F.col("total") > 1)))
    rows = rows.where(sure | edge).select(
        "rid", F.when(sure, F.col("at")).alias("sure"), F.when(edge, F.col("at")).alias("edge"))
    return rows.groupBy("rid").agg(F.collect_list("sure").alias("sure"),
                                   F.collect_list("edge").alias("edge"))


def _edge_windows(docs: DataFrame) -> DataFrame:
    """Windows around the ``edge`` anchors of ``docs (rid, text, edge)``: ``(h1, h2, rid, at,
    n)``, n being the number of equal windows in a chunk at the first and null at the others."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rids, edges in _batches(frames, "text", "rid", "edge"):
            words: list[bytes] = []
            starts, owners, places = [], [], []
            for text, rid, edge in zip(texts, rids, edges):
                mine = split_words(text)
                place = window_starts(np.array(edge, np.int64), len(mine))
                starts.append(place + len(words))
                places.append(place)
                owners.append(np.full(len(place), rid, np.int64))
                words += mine
            start, rid, at = map(np.concatenate, (starts, owners, places))
            if not len(start):
                continue
            h1 = Hasher(words, _BASE1).ranges(start, start + WINDOW)
            h2 = Hasher(words, _BASE2).ranges(start, start + WINDOW)
            order = np.lexsort((at, rid, h2, h1))
            h1, h2, rid, at = h1[order], h2[order], rid[order], at[order]
            first = _first_of(h1, h2)
            count = np.zeros(len(h1), np.int32)
            count[first] = _run_lengths(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(rid),
                 pa.array(at.astype(np.int32)), pa.array(count, mask=~first)],
                names=["h1", "h2", "rid", "at", "n"])

    return docs.select("rid", "text", "edge").mapInArrow(
        run, "h1 long, h2 long, rid long, at int, n int")


def window_starts(anchors: np.ndarray, n_words: int) -> np.ndarray:
    """Sorted starts of the windows that contain one of the anchors."""
    starts = (anchors[:, None] - np.arange(PERIOD)).ravel()
    return np.unique(starts[(starts >= 0) & (starts <= n_words - WINDOW)])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(rid, starts)``: starts of the repeated ones among the edge windows."""
    known = F.col("n").isNull()
    rows = _edge_windows(docs).select(
        F.when(known, F.xxhash64("rid", "at")).otherwise(F.col("h1")).alias("k1"),
        F.when(known, F.lit(0)).otherwise(F.col("h2")).alias("k2"), known.alias("known"),
        "rid", "at", "n")
    same = Window.partitionBy("k1", "k2", "known")
    rows = rows.withColumn("alike", F.sum("n").over(same)).where("known OR alike > 1")
    return rows.groupBy("rid").agg(F.collect_list("at").alias("starts"))


def keep_mask(n_words: int, sure, starts) -> np.ndarray:
    """Which words of a text stay."""
    change = np.zeros(n_words + 1, np.int64)
    if sure is not None and len(sure):
        at = np.asarray(sure, np.int64)
        np.add.at(change, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(change, np.minimum(at + WINDOW, n_words), -1)
    if starts is not None and len(starts):
        at = np.asarray(starts, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change[:-1]) == 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, n_words, n_removed, kept)``, kept being the words that
    stay, joined by one space.

    Null, empty and short texts (under 35 words) keep all their words. Repeated rows are
    texts like any other: both lose what they share.
    """
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("rid"),
                                   F.col(id_col).alias("id"),
                                   F.col(text_col).cast("string").alias("text")), "substr-docs")
    anchors = materialise(repeated_anchors(rows), "substr-anchors")
    edges = rows.join(anchors.where(F.size("edge") > 0).select("rid", "edge"), "rid")
    windows = materialise(repeated_windows(edges), "substr-windows")
    marks = anchors.where(F.size("sure") > 0).select("rid", "sure").join(
        windows, "rid", "full_outer")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, sure: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, sure, starts):
            words = split_words(text)
            if a is None and b is None:
                stay = words
            else:
                mask = keep_mask(len(words), a, b)
                stay = [w for w, m in zip(words, mask) if m]
            out.append((len(words), len(words) - len(stay),
                        b" ".join(stay).decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return rows.join(marks, "rid", "left").select(
        F.col("id").alias(id_col), cut("text", "sure", "starts").alias("c")).select(
        id_col, "c.n_words", "c.n_removed", "c.kept")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_removed",
                        F.sha2(F.col("kept"), 256).alias("kept_sha256"))
