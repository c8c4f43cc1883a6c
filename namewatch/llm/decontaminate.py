"""Benchmark decontamination with a generalised suffix automaton.

The words of the test items go into one automaton of all their word sequences. A document is
streamed through it word by word; the automaton's state gives the longest run of words ending
here that occurs in any item. Wherever that run reaches the window length, a window of an item
ends, and the state tells which items have it.

The items are a stated query set. Spark deals them into blocks of at most ``BLOCK_WORDS`` words
(a longer item goes into several, with a window less a word of overlap), and each block's
automaton is built in a task and written to the shared folder. The documents are then matched
with one block at a time: its automaton, about ``BLOCK_WORDS`` states times two, is broadcast
and dropped before the next. A larger benchmark takes more passes over the documents, never a
larger broadcast; the driver holds one block's bytes at most.

Documents are dropped by coverage, and hit spans are cut out of the others.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch.llm.common import fresh, materialise

WINDOW = 13
# A document is contaminated when hit words make at least one part in COVER_PARTS.
COVER_PARTS = 20
# Benchmark words in one automaton. It bounds the broadcast, not the benchmark.
BLOCK_WORDS = 200_000

# Everything but 0-9, a-z and non-ASCII separates words, after lower-casing A-Z.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))

_HITS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text, normalised: lower-case runs of letters, digits and non-ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over words, with the windows of each item marked.

    ``hits(words)`` returns the merged ranges of hit words and the ids of the items with an
    occurring window. An item without words has no window; items without an id count as hits
    but are not named.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: list[str | None] = []
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        rows = []
        for item_id, words in items:
            if words:
                vocabulary = self.vocabulary
                row = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                rows.append(row)
                self.ids.append(item_id)
                state = 0
                for w in row:
                    state = self._extend(state, w)
        self._mark(rows)

    def _extend(self, last: int, w: int) -> int:
        """Append word ``w`` to the sequence of state ``last``."""
        nexts, link, length = self.next, self.link, self.length
        old = nexts[last].get(w)
        if old is not None:
            if length[old] == length[last] + 1:
                return old
            return self._split(last, w, old)
        state = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and w not in nexts[at]:
            nexts[at][w] = state
            at = link[at]
        if at >= 0:
            q = nexts[at][w]
            link[state] = q if length[q] == length[at] + 1 else self._split(at, w, q)
        return state

    def _split(self, at: int, w: int, old: int) -> int:
        """Give the sequences of ``old`` no longer than ``at`` and ``w`` their own state."""
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[old]))
        link.append(link[old])
        length.append(length[at] + 1)
        link[old] = copy
        while at >= 0 and nexts[at].get(w) == old:
            nexts[at][w] = copy
            at = link[at]
        return copy

    def _mark(self, rows: list[list[int]]) -> None:
        """``full[s]``: the state of the last ``window`` words of state s, or -1.
        ``whole[s]``: states on s's suffix path where a shorter item ends, longest first."""
        n, window = len(self.next), self.window
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.full = [-1] * n
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.full[s] = self.full[up] if self.length[up] >= window else s
        self.windows: dict[int, set[int]] = {}
        short: dict[int, tuple[int, set[int]]] = {}
        for i, row in enumerate(rows):
            state = 0
            if len(row) < window:
                for w in row:
                    state = self.next[state][w]
                short.setdefault(state, (len(row), set()))[1].add(i)
                continue
            for w in row:
                state = self.next[state][w]
                # the state reached by an item's own prefix may hold longer sequences, but
                # its window of the last words is the item's
                if self.full[state] >= 0 and self.length[state] >= window:
                    self.windows.setdefault(self.full[state], set()).add(i)
        self.whole: list[list[int]] = [[] for _ in range(n)]
        for s in order:
            own = [s] if s in short else []
            up = self.whole[self.link[s]]
            self.whole[s] = own + up if own else up
        self.short = short
        self.least = min([len(r) for r in rows] + [window]) if rows else 0

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int], set[int]]:
        nexts, link, length = self.next, self.link, self.length
        full, whole, short, window, least = (self.full, self.whole, self.short, self.window,
                                             self.least)
        starts: list[int] = []
        ends: list[int] = []
        found: set[int] = set()
        state = run = 0
        for at, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = run = 0
                continue
            to = nexts[state].get(w)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nexts[state].get(w)
            if to is None:
                run = 0
                continue
            state = to
            run += 1
            if run < least:
                continue
            reach = 0
            if run >= window:
                reach = window
                found |= self.windows.get(full[state], _NONE)
            for s in whole[state]:
                size, items = short[s]
                if size <= run:
                    reach = max(reach, size)
                    found |= items
            if reach:
                start = at + 1 - reach
                # the new range ends last, so it can swallow ranges that start later
                while starts and starts[-1] >= start:
                    starts.pop()
                    ends.pop()
                if starts and ends[-1] >= start:
                    ends[-1] = at + 1
                else:
                    starts.append(start)
                    ends.append(at + 1)
        return starts, ends, found


_NONE: set[int] = set()


def pieces(words: list[bytes], window: int, limit: int) -> Iterator[list[bytes]]:
    """The words in pieces of at most ``limit`` (never below the window) with all their
    windows: each piece but the first begins ``window - 1`` words before the last one's end."""
    limit = max(limit, window)
    if len(words) <= limit:
        yield words
        return
    for start in range(0, len(words) - window + 1, limit - window + 1):
        yield words[start:start + limit]


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int,
                block_words: int) -> DataFrame:
    """``(block, n_words, machine)``: the items in blocks of at most ``block_words`` words, with
    the automaton of each, built where its items are."""
    rows = items.select(F.col(id_col).cast("string").alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[str | None, list[bytes]]] = []
        held, made, part = 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            machine = pickle.dumps(Automaton(block, window), pickle.HIGHEST_PROTOCOL)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([machine], pa.binary())], names=["block", "n_words", "machine"])

        for batch in batches:
            for item_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for words in pieces(normal_words(text), window, block_words):
                    if block and held + len(words) > block_words:
                        yield flush()
                        block, held, made = [], 0, made + 1
                    if words:
                        block.append((item_id, words))
                        held += len(words)
        if block:
            yield flush()

    # about as many tasks as blocks: a word has some bytes
    tasks = max(1, math.ceil(size / (6 * block_words)))
    return materialise(rows.repartition(tasks).mapInArrow(
        build, "block long, n_words long, machine binary"), "items-blocks")


_loaded: dict[str, Automaton] = {}


def _machine(key: str, payload: bytes) -> Automaton:
    """The automaton of a broadcast block, unpacked once in a worker; only the last one is
    kept."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(payload)
    return _loaded[key]


def _hits_column(text_col: str, automaton) -> Column:
    key = uuid.uuid4().hex

    @F.pandas_udf(_HITS)
    def match(texts: pd.Series) -> pd.DataFrame:
        machine = _machine(key, automaton.value)
        rows = []
        for text in texts:
            words = normal_words(text)
            starts, ends, found = machine.hits(words)
            names = {machine.ids[i] for i in found} - {None}
            rows.append((len(words), starts, ends, sorted(names)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return match(F.col(text_col).cast("string"))


def _merge_hits(n_words: pd.Series, starts: pd.Series, ends: pd.Series,
                items: pd.Series) -> pd.DataFrame:
    """Hits of several blocks as one: ranges merged, item ids united."""
    rows = []
    for n, s, e, names in zip(n_words, starts, ends, items):
        out_s: list[int] = []
        out_e: list[int] = []
        for a, b in sorted((int(a), int(b)) for xs, ys in zip(s, e) for a, b in zip(xs, ys)):
            if out_s and a <= out_e[-1]:
                out_e[-1] = max(out_e[-1], b)
            else:
                out_s.append(a)
                out_e.append(b)
        rows.append((n, out_s, out_e, sorted({x for part in names for x in part})))
    return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])


def with_hits(docs: DataFrame, items: DataFrame, out: str, text_col: str = "text",
              item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
              block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct column ``out (n_words, starts, ends, items)``: the number of
    words, the ranges of words inside any window of an item, and those items' ids (distinct,
    sorted as strings).

    Null and empty texts have no words; an empty benchmark hits nothing. Items that repeat an
    id count once.
    """
    return _with_hits(docs, item_blocks(items, item_id_col, item_text_col, window, block_words),
                      out, text_col, window)


def _with_hits(docs: DataFrame, blocks: DataFrame, out: str, text_col: str,
               window: int) -> DataFrame:
    spark = docs.sparkSession
    every = sorted(r[0] for r in blocks.select("block").collect())

    def share(block: int):
        return spark.sparkContext.broadcast(
            blocks.where(F.col("block") == block).select("machine").first()[0])

    if len(every) <= 1:
        only = share(every[0]) if every else spark.sparkContext.broadcast(
            pickle.dumps(Automaton([], window)))
        return docs.withColumn(out, _hits_column(text_col, only))
    rid, hit = fresh([*docs.columns, out], "nw_rid", "nw_hit")
    base = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "items-docs")
    slim = None
    for block in every:
        machine = share(block)
        part = materialise(base.select(F.col(rid), _hits_column(text_col, machine).alias(hit)),
                           "items-hits")
        machine.destroy()
        slim = part if slim is None else slim.unionByName(part)
    merge = F.pandas_udf(_merge_hits, _HITS)
    # one entry for each block and document
    joined = slim.groupBy(rid).agg(F.collect_list(hit).alias(hit)).select(
        rid, merge(F.col(f"{hit}.n_words")[0], f"{hit}.starts", f"{hit}.ends",
                   f"{hit}.items").alias(out))
    return base.join(joined, rid).drop(rid)


def n_hit_of(hit: str) -> Column:
    size = F.zip_with(f"{hit}.ends", f"{hit}.starts", lambda e, s: (e - s).cast("long"))
    return F.aggregate(size, F.lit(0).cast("long"), lambda acc, x: acc + x)


def is_contaminated(n_words: Column, n_hit: Column, parts: int = COVER_PARTS) -> Column:
    return (n_hit > 0) & (n_hit * parts >= n_words)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW,
                  parts: int = COVER_PARTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: ``(id, n_words, n_hit, n_items, items_sha256, contaminated)``.

    Null and empty texts have no words and are not contaminated; repeated rows are judged each;
    items without an id hit but are not counted as items; an empty table gives no rows.
    """
    hit = "hit"
    rows = with_hits(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                     items, hit, "text", item_id_col, item_text_col, window, block_words)
    rows = rows.select("id", F.col(f"{hit}.n_words").alias("n_words"),
                       n_hit_of(hit).alias("n_hit"), F.col(f"{hit}.items").alias("items"))
    return rows.select(
        F.col("id").alias(id_col), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit"), parts).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text",
                      **options) -> DataFrame:
    """``docs`` without the contaminated documents; the others are kept as they are, null and
    empty texts and repeated rows included."""
    parts = options.pop("parts", COVER_PARTS)
    hit, = fresh(docs.columns, "nw_hits")
    rows = with_hits(docs, items, hit, text_col, **options)
    return rows.where(~is_contaminated(F.col(f"{hit}.n_words"), n_hit_of(hit), parts)) \
        .select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text",
                 min_span: int = 1, **options) -> DataFrame:
    """``docs`` with every hit range of ``min_span`` or more words cut out of the text. Ranges
    shorter than the window are whole items of fewer words.

    The text between the cuts is kept as written; a cut becomes one space. Null and empty texts
    stay; repeated rows are cut each.
    """
    hit, = fresh(docs.columns, "nw_hits")
    rows = with_hits(docs, items, hit, text_col, **options)
    return rows.withColumn(text_col, _cut(text_col, hit, min_span)).select(*docs.columns)


def _cut(text_col: str, hit: str, min_span: int) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, s, e, min_span)
                          for t, s, e in zip(texts, starts, ends)], dtype=object)

    return cut(text_col, f"{hit}.starts", f"{hit}.ends")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text",
                  size_col: str | None = None, item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, parts: int = COVER_PARTS,
                  min_span: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the contaminated documents (coverage limit) and with every hit range of
    ``min_span`` or more words cut out of the others (length limit; ``size_col``, if given,
    follows the new length). With the default limit no text of the result holds a window: words
    that a cut brings together are matched again, in the texts that were cut.

    Null and empty texts are kept as they are; repeated rows are judged and cut each; an empty
    table gives an empty table.
    """
    hit, again = fresh(docs.columns, "nw_hits", "nw_cut")
    blocks = item_blocks(items, item_id_col, item_text_col, window, block_words)
    done, rest, first = None, docs, True
    while True:
        rows = _with_hits(rest, blocks, hit, text_col, window)
        n_hit = n_hit_of(hit)
        if first:
            rows = rows.where(~is_contaminated(F.col(f"{hit}.n_words"), n_hit, parts))
        longest = F.exists(F.zip_with(f"{hit}.ends", f"{hit}.starts", lambda e, s: e - s),
                           lambda n: n >= min_span)
        rows = rows.withColumn(again, longest)
        text = F.when(F.col(again), _cut(text_col, hit, min_span)).otherwise(F.col(text_col))
        rows = rows.withColumn(text_col, text)
        if size_col:
            rows = rows.withColumn(size_col, F.when(F.col(again), F.length(text_col)).otherwise(
                F.col(size_col)).cast(docs.schema[size_col].dataType))
        rows = materialise(rows.select(*docs.columns, again), "items-cut")
        whole = rows.where(~F.col(again)).select(*docs.columns)
        done = whole if done is None else done.unionByName(whole)
        rest, first = rows.where(again).select(*docs.columns), False
        if rest.limit(1).count() == 0:
            return done


def cut_words(text: str | None, starts, ends, min_span: int = 1) -> str | None:
    """``text`` without the normalised words ``[start, end)`` of each range."""
    spans = [(int(s), int(e)) for s, e in zip(starts, ends) if e - s >= min_span]
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "replace")
    flat = raw.translate(_WORD_BYTES)
    bounds, at = [], 0
    for word in flat.split():
        at = flat.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    out, done = [], 0
    for s, e in spans:
        out.append(raw[done:bounds[s][0]].rstrip())
        done = bounds[e - 1][1]
    out.append(raw[done:].lstrip())
    return b" ".join(x for x in out if x).decode("utf-8", "replace")

