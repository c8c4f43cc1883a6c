"""Byte-level dedup by distributed suffix sorting with a difference cover.

A string of 100 bytes that also starts earlier (in an earlier document, or earlier in the same
one) is a repeat; its bytes go. Equal strings are neighbours in the suffix array, so suffixes
are sorted, not compared in pairs:

* **Discard.** Text that holds no repeat is not sorted. Every 100-byte string has a block that
  its content alone chooses (the 60 bytes of the smallest fingerprint in it), so equal strings
  have equal blocks at equal places. Strings whose block occurs once are done.
* **Sort sampled tuples.** Of what is left, suffixes at positions whose remainder modulo 57 is
  in a difference cover (8 of 57) are sampled: any two positions have a shift below 57 that
  takes both to sampled ones, so two equal strings share an aligned sampled suffix with 44
  bytes or more to go. Those 44 bytes, a tuple, get a name.
* **Recurse on names.** The names of what stands before a tuple (56 bytes), of the tuple, and
  of what follows (56 bytes) form a triple, which is named in turn: it covers all strings that
  contain the tuple. Where a triple occurs again, all its strings do, and all its occurrences
  but the first lose their bytes. A tuple whose occurrences have one triple is settled.
* **Merge the remaining suffixes.** Where a tuple is followed or preceded by different text (the
  edges of matches), the suffixes between the sampled ones are put in: those whose first 100
  bytes contain the tuple of the first occurrence of each triple and are not known to be
  repeats (the first occurrence of a string never is, so every string keeps its witness).
* **Compare adjacent prefixes.** They are sorted by their first 100 bytes; of equal neighbours
  the first in document order stays and the others are repeats.

Names are fingerprints (64 bits; 128 for a triple with its tuple, 96 for a whole string): equal
strings get equal names in every task, so no names are numbered or sent back between the
levels. Only the order of equal names matters, so names are sorted by value. The period is 57
and not 3: sorting two thirds of all byte suffixes would write 16 bytes for each of them, over
ten times the text.

A slice of text reports a name once however often it holds it, with its first place; the rest is
known to be repeated there and travels with its text, not by name. Whole texts that equal an
earlier one are repeats at once; one of each is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namewatch.llm.common import materialise, text_of

LENGTH = 100            # bytes of a string
BLOCK = 60              # bytes of the block that a string's content chooses
PERIOD = 57
COVER = (1, 2, 4, 14, 33, 37, 44, 53)   # differences give every remainder modulo 57
TUPLE = LENGTH - PERIOD + 1
REACH = PERIOD - 1      # bytes before a tuple that a string containing it can start
SLICE = 2 << 20         # bytes worked on at one time; no result depends on it

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0x94D049BB133111EB), np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= _M1
    return h ^ (h >> np.uint64(29))


# one 64-bit code for each byte value
_CODES = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
    power[1:], inverse[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    return power, inverse


class Names:
    """Fingerprints of ranges of some bytes, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        room = max(SLICE + 4 * LENGTH, len(data)) + 1
        self.power, self.inverse = _powers(room)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.add.accumulate(_CODES[data] * self.power[:len(data)], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])

    def all_of(self, size: int) -> np.ndarray:
        """Of every range of ``size`` bytes, in order of position."""
        n = len(self.prefix) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return _mix((self.prefix[size:] - self.prefix[:n]) * self.inverse[:n])


class Texts:
    """The texts of a batch as one run of bytes, cut into slices with margins."""

    def __init__(self, column: pa.Array):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[
            column.offset:column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.data = whole[offsets[0]:offsets[-1]]
        self.bounds = offsets - offsets[0]

    def slices(self) -> Iterator[tuple[int, int]]:
        for start in range(0, len(self.data), SLICE):
            yield start, min(start + SLICE, len(self.data))

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The text each place lies in."""
        return np.searchsorted(self.bounds, places, "right") - 1

    def string_starts(self, start: int, end: int) -> np.ndarray:
        """Marks the places of ``[start, end)`` where a whole string starts."""
        first, last = self.owner(np.array([start, max(end - 1, start)]))
        change = np.zeros(end - start + 1, np.int32)
        opens = self.bounds[first:last + 1]
        closes = np.maximum(self.bounds[first + 1:last + 2] - LENGTH + 1, opens)
        np.add.at(change, np.clip(opens - start, 0, end - start), 1)
        np.add.at(change, np.clip(closes - start, 0, end - start), -1)
        return np.cumsum(change[:-1]) > 0


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Marks the first row of each run of equal values in sorted columns."""
    first = np.ones(len(columns[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


def _counts(first: np.ndarray) -> np.ndarray:
    """At the first row of each run its length, at the others 0."""
    out = np.zeros(len(first), np.int32)
    at = np.flatnonzero(first)
    out[at] = np.diff(np.append(at, len(first)))
    return out


def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


# -- discard -------------------------------------------------------------------------------------

def chosen_blocks(texts: Texts, start: int, end: int) -> tuple[np.ndarray, ...]:
    """``(name, place, size)``: for each run of strings starting in ``[start, end)`` that choose
    one block, the block's name, the first string's start, and how many strings there are."""
    data = texts.data[start:end + LENGTH - 1]
    marks = texts.string_starts(start, end)
    names = Names(data).all_of(BLOCK)
    width = LENGTH - BLOCK + 1
    if len(names) < width:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty
    # the leftmost block of the least fingerprint
    chosen = (_least((names & ~_LOW) | np.arange(len(names), dtype=np.uint64), width)
              & _LOW).astype(np.int64)
    at = np.flatnonzero(marks[:len(chosen)])
    block = chosen[at]
    fresh = np.ones(len(at), bool)
    if len(at):
        fresh[1:] = (np.diff(at) != 1) | (np.diff(block) != 0)
    size = np.diff(np.append(np.flatnonzero(fresh), len(at)))
    return names[block[fresh]], at[fresh] + start, size


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs (rid, text)``: ``(key, known, rid, at, size, n)``, n being the number of
    equal names in the slice at the first, and ``known`` set at the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column("text"))
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            for start, end in texts.slices():
                name, place, size = chosen_blocks(texts, start, end)
                order = np.argsort(name, kind="stable")
                name, place, size = name[order], place[order], size[order]
                owner = texts.owner(place)
                rid, at = rids[owner], place - texts.bounds[owner]
                first = _firsts(name)
                yield pa.RecordBatch.from_arrays(
                    [_long(np.where(first, name, rid.view(np.uint64))), pa.array(~first),
                     pa.array(rid), _int(at), _int(size), _int(_counts(first))],
                    names=["key", "known", "rid", "at", "size", "n"])

    return docs.select("rid", "text").mapInArrow(
        run, "key long, known boolean, rid long, at int, size int, n int")


def repeated_blocks(docs: DataFrame) -> DataFrame:
    """``(rid, runs)``: the runs ``(at, size)`` of strings whose chosen block occurs again."""
    rows = _blocks(docs)
    same = Window.partitionBy("key", "known")
    rows = rows.withColumn("alike", F.sum("n").over(same)).where("known OR alike > 1")
    return rows.groupBy("rid").agg(F.collect_list(F.struct("at", "size")).alias("runs"))


class Candidates:
    """Strings of a batch's texts that may be repeated, from the runs of their blocks."""

    def __init__(self, texts: Texts, runs: pa.Array):
        lists = runs.flatten()
        owner = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy(
            zero_copy_only=False))
        at = lists.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
        at = at + texts.bounds[owner]
        order = np.argsort(at, kind="stable")
        self.at = at[order]
        self.size = lists.field("size").to_numpy(zero_copy_only=False)[order]

    def marks(self, start: int, end: int) -> np.ndarray:
        """Marks those that start in ``[start, end)``."""
        a, b = np.searchsorted(self.at, [start - LENGTH, end])
        change = np.zeros(end - start + 1, np.int32)
        at, size = self.at[a:b], self.size[a:b]
        np.add.at(change, np.clip(at - start, 0, end - start), 1)
        np.add.at(change, np.clip(at + size - start, 0, end - start), -1)
        return np.cumsum(change[:-1]) > 0


# -- sampled tuples and their triples --------------------------------------------------------------

def sampled(texts: Texts, candidates: Candidates, start: int, end: int) -> tuple:
    """``(tuple name, triple name, text, place in it)`` of the sampled suffixes in
    ``[start, end)`` that a candidate string contains."""
    low = max(start - REACH, 0)
    marks = candidates.marks(low, end)
    total = np.concatenate([[0], np.cumsum(marks)])
    here = np.arange(start, end)
    owner = texts.owner(here)
    place = here - texts.bounds[owner]
    left = texts.bounds[owner + 1] - here
    keep = np.isin(place % PERIOD, COVER) & (left >= TUPLE)
    here, owner, place, left = here[keep], owner[keep], place[keep], left[keep]
    before, after = np.minimum(place, REACH), np.minimum(left, LENGTH)
    keep = total[here + 1 - low] > total[here - before - low]
    here, owner, place = here[keep], owner[keep], place[keep]
    before, after = before[keep], after[keep]
    names = Names(texts.data[low:end + LENGTH])
    at = here - low
    middle = names.of(at, at + TUPLE)
    extent = (before * 256 + after).astype(np.uint64)    # equal triples have equal extents
    triple = _mix((names.of(at - before, at) * _M1 + middle) * _M2
                  + names.of(at + TUPLE, at + after) + extent * np.uint64(_BASE))
    return middle, triple, owner, place


# How a sampled suffix travels: by its tuple's name, on its own (known to be repeated), or, if
# its slice saw the tuple in several triples, by tuple and triple.
BY_TUPLE, KNOWN, BY_TRIPLE = 0, 1, 2


def _suffixes(docs: DataFrame) -> DataFrame:
    """Sampled suffixes of ``docs (rid, text, runs)``: ``(key, way, triple, rid, at)``. The
    first of each tuple and triple in a slice travels by name; a tuple that the slice saw in
    several triples leaves one mark (no rid) by its name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column("text"))
            candidates = Candidates(texts, batch.column("runs"))
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            for start, end in texts.slices():
                name, triple, owner, at = sampled(texts, candidates, start, end)
                if not len(name):
                    continue
                rid = rids[owner]
                order = np.lexsort((at, rid, triple, name))
                name, triple, rid, at = name[order], triple[order], rid[order], at[order]
                first, top = _firsts(name, triple), _firsts(name)
                heads = np.flatnonzero(top)
                several = np.repeat(np.add.reduceat(first.astype(np.int32), heads) > 1,
                                    np.diff(np.append(heads, len(name))))
                way = np.where(first, np.where(several, BY_TRIPLE, BY_TUPLE), KNOWN)
                key = np.choose(way, [name, rid.view(np.uint64), _mix(name ^ (triple * _M2))])
                yield _suffix_batch(key, way, np.where(way == KNOWN, np.uint64(0), triple),
                                    pa.array(rid), at)
                marks = name[top & several]
                if len(marks):
                    zero = np.zeros(len(marks), np.int64)
                    yield _suffix_batch(marks, zero, zero.view(np.uint64),
                                        pa.nulls(len(marks), pa.int64()), zero)

    return docs.select("rid", "text", "runs").mapInArrow(
        run, "key long, way byte, triple long, rid long, at int")


def _suffix_batch(key, way, triple, rid, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [_long(key), pa.array(way.astype(np.int8)), _long(triple), rid, _int(at)],
        names=["key", "way", "triple", "rid", "at"])


def repeated_triples(docs: DataFrame) -> DataFrame:
    """``(rid, sure, edge)``: places of sampled suffixes whose triple occurs earlier, and of the
    first ones of each triple whose tuple has several."""
    rows = _suffixes(docs).repartition("key", "way")
    same = Window.partitionBy("key", "way", "triple").orderBy("rid", "at")
    group = Window.partitionBy("key", "way")
    mark = F.col("rid").isNull()
    rows = rows.withColumn("turn", F.row_number().over(same)).withColumn(
        "several", (F.min("triple").over(group) != F.max("triple").over(group))
        | F.max(mark).over(group)).where(~mark)
    sure = (F.col("way") == KNOWN) | (F.col("turn") > 1)
    edge = ~sure & ((F.col("way") == BY_TRIPLE) | F.col("several"))
    return rows.where(sure | edge).groupBy("rid").agg(
        F.collect_list(F.when(sure, F.col("at"))).alias("sure"),
        F.collect_list(F.when(edge, F.col("at"))).alias("edge"))


# -- the remaining suffixes ------------------------------------------------------------------------

class Places:
    """Places in a batch's texts, from one list per text, in order."""

    def __init__(self, texts: Texts, lists: pa.Array):
        of = np.repeat(np.arange(len(lists)),
                       lists.value_lengths().to_numpy(zero_copy_only=False))
        at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.sort(at + texts.bounds[of])

    def before(self, start: int, end: int) -> np.ndarray:
        """Marks the starts in ``[start, end)`` of strings that contain the tuple at one."""
        a, b = np.searchsorted(self.at, [start, end + REACH])
        near = self.at[a:b]
        change = np.zeros(end - start + 1, np.int32)
        np.add.at(change, np.clip(near - REACH - start, 0, end - start), 1)
        np.add.at(change, np.clip(near + 1 - start, 0, end - start), -1)
        return np.cumsum(change[:-1]) > 0


def _edge_strings(docs: DataFrame) -> DataFrame:
    """Candidate strings around the ``edge`` tuples and not around the ``sure`` ones of ``docs
    (rid, text, runs, sure, edge)``, as three numbers each: ``h1``; ``low``, the second name's 32
    bits and the place; ``who``, the row number. All equal ones of a slice but the first are
    known to be repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column("text"))
            candidates = Candidates(texts, batch.column("runs"))
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            edge, sure = (Places(texts, batch.column(n)) for n in ("edge", "sure"))
            for start, end in texts.slices():
                # reaching into the text before does not matter: no whole string starts in
                # the last REACH bytes of a text
                marks = (candidates.marks(start, end) & edge.before(start, end)
                         & ~sure.before(start, end))
                place = start + np.flatnonzero(marks)
                if not len(place):
                    continue
                names = Names(texts.data[start:end + LENGTH])
                at = place - start
                half = LENGTH // 2
                h1 = names.of(at, at + LENGTH)
                h2 = _mix(names.of(at, at + half) * _M2 + names.of(at + half, at + LENGTH)) & _LOW
                owner = texts.owner(place)
                rid, at = rids[owner], place - texts.bounds[owner]
                order = np.lexsort((at, rid, h2, h1))
                h1, h2, rid, at = h1[order], h2[order], rid[order], at[order]
                first = _firsts(h1, h2)
                # a known one keeps with its text; its row number is complemented
                low = (h2 << np.uint64(32)) | at.astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [_long(np.where(first, h1, rid.view(np.uint64))), _long(low),
                     pa.array(np.where(first, rid, ~rid))], names=["h1", "low", "who"])

    return docs.select("rid", "text", "runs", "sure", "edge").mapInArrow(
        run, "h1 long, low long, who long")


def repeated_strings(docs: DataFrame) -> DataFrame:
    """``(rid, starts)``: starts of the strings among them that also start earlier."""
    packed = _edge_strings(docs).repartition("h1")
    known = F.col("who") < 0
    rows = packed.select(
        "h1", F.shiftright("low", 32).alias("h2"), known.alias("known"),
        F.when(known, F.bitwise_not("who")).otherwise(F.col("who")).alias("rid"),
        F.col("low").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("at"))
    same = Window.partitionBy("h1", "h2", "known").orderBy("rid", "at")
    rows = rows.withColumn("turn", F.row_number().over(same))
    return rows.where("known OR turn > 1").groupBy("rid").agg(
        F.collect_list("at").alias("starts"))


# -- documents -------------------------------------------------------------------------------------

def keep_mask(n_bytes: int, sure, starts) -> np.ndarray:
    """Which bytes of a text stay."""
    change = np.zeros(n_bytes + 1, np.int64)
    if sure is not None and len(sure):
        at = np.asarray(sure, np.int64)
        np.add.at(change, np.maximum(at - REACH, 0), 1)
        np.add.at(change, np.minimum(at + LENGTH, n_bytes), -1)
    if starts is not None and len(starts):
        at = np.asarray(starts, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[:-1]) == 0


def _in_order(docs: DataFrame) -> DataFrame:
    """``(rid, row)`` of the first of equal texts of ``docs (row, id, text)``, texts of a
    string's length and more; rid rises in document order: by id, null first, and for rows that
    repeat an id by the MD5 of the text. Only ids and digests move."""
    first = docs.where(F.octet_length("text") >= LENGTH).select(
        F.md5("text").alias("digest"), F.xxhash64("text").alias("also"),
        F.struct("id", "row").alias("first")).groupBy("digest", "also").agg(
        F.min("first").alias("first"))
    return first.orderBy(F.col("first.id").asc_nulls_first(), "digest", "also").select(
        F.monotonically_increasing_id().alias("rid"), F.col("first.row").alias("row"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, n_bytes, n_removed, n_spans, kept)``, kept being the bytes
    that stay.

    Null and empty texts have no bytes; texts under 100 bytes keep all. Documents are ordered by
    id, null first, and rows that repeat an id by the MD5 of their text; of equal rows one keeps
    its bytes. A longer text that equals an earlier one is a repeat as a whole and is not
    sorted. An empty table gives no rows.
    """
    docs = materialise(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        text_of(text_col).cast("binary").alias("text")), "suffix-docs")
    order = materialise(_in_order(docs), "suffix-order")
    blocks = materialise(repeated_blocks(docs.join(order, "row")), "suffix-blocks")
    found = order.join(blocks, "rid")
    triples = materialise(repeated_triples(docs.join(found, "row")), "suffix-triples")
    edges = found.join(triples.where(F.size("edge") > 0).select("rid", "sure", "edge"), "rid")
    strings = materialise(repeated_strings(docs.join(edges, "row")), "suffix-strings")
    marks = order.join(triples.where(F.size("sure") > 0).select("rid", "sure"), "rid", "left") \
        .join(strings, "rid", "left")

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, sure: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, sure, starts):
            data = np.frombuffer(text, np.uint8)
            stay = keep_mask(len(data), a, b)
            gone = np.concatenate([[False], ~stay])
            out.append((len(data) - int(stay.sum()), int((gone[1:] & ~gone[:-1]).sum()),
                        data[stay].tobytes()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    size = F.octet_length("text").cast("long")
    sorted_ = docs.join(marks, "row").select(
        "id", size.alias("n_bytes"), cut("text", "sure", "starts").alias("c")).select(
        "id", "n_bytes", "c.n_removed", "c.n_spans", "c.kept")
    short = F.col("n_bytes") < LENGTH
    rest = docs.select("row", "id", size.alias("n_bytes"), F.when(
        size < LENGTH, F.col("text")).alias("text")).join(order, "row", "left_anti").select(
        "id", "n_bytes", F.when(short, F.lit(0)).otherwise(F.col("n_bytes")).alias("n_removed"),
        F.when(short, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_spans"),
        F.coalesce("text", F.lit(b"")).alias("kept"))
    return sorted_.unionByName(rest).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", "n_spans",
                        F.sha2("kept", 256).alias("kept_sha256"))
