"""Spelling variant grouping with an index of variable-length grams.

* A word stands between sentinels (``^word$``). At every position it has one gram: the
  shortest one of two or more characters that the dictionary does not call frequent, four
  characters at most. The dictionary holds the frequent grams only: a gram of a level is kept
  if it occurs more than total / ``DICTIONARY`` times, so a level has fewer than
  ``DICTIONARY`` entries whatever the vocabulary is, and the dictionary can be broadcast.
* An edit changes only grams that contain its place. A word's bound is the number of its grams
  that the worst single edit leaves alone; two near words share at least the larger of their
  bounds, a run of grams from the start and a run of grams from the end.
* List merging: with ``t`` grams shared there is a split ``r`` such that the first r and the
  last t - r grams agree. Both lists are merged into one key, so a word is looked up in the
  intersection of its gram lists and never in one list alone. A word is indexed under its own
  bound; it is looked up under every bound that a word one edit away, of a bound not above its
  own, can have. Long words look at every (slack + 1)-th split, and the last one, with
  ``slack`` grams fewer agreeing, which finds the same pairs with a few keys.
* Every candidate is verified with the edit distance.

No list is cut and no pair is lost: bounds hold for every word of ``LEAST`` characters.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch.llm.common import LOWER_AZ, materialise, text_of

LEAST = 5               # code points of a word
TIMES = 3               # occurrences of a word
SHORTEST, LONGEST = 2, 4    # characters of a gram
DICTIONARY = 20_000     # the share of all grams that makes one frequent; entries of a level
HELD_WORDS = 200_000    # words counted in a task before they are passed on

_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LONG_TEXT = 1 << 20    # runs of a longer text are read one by one, not listed


def _misspelt(run: bytes, crc: int) -> bytes:
    """The run, without one code point if the checksum says so."""
    if crc % 97:
        return run
    letters = run.decode("utf-8")
    at = crc % len(letters)
    return (letters[:at] + letters[at + 1:]).encode("utf-8")


def text_words(doc_id: str | None, text: str | None) -> Iterator[tuple[bytes, int]]:
    """Words of one text with their numbers, short ones left out; a word may come twice."""
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    text = text or ""
    runs = _RUNS.findall(text) if len(text) <= _LONG_TEXT else (
        m.group() for m in _RUNS.finditer(text))
    lowered: Counter[bytes] = Counter()
    for run, n in Counter(runs).items():
        if len(run) >= LEAST:
            lowered[run.encode("utf-8").translate(LOWER_AZ)] += n
    for run, n in lowered.items():
        word = _misspelt(run, zlib.crc32(run, start))
        if len(word) >= LEAST and len(word.decode("utf-8")) >= LEAST:
            yield word, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: words of at least ``LEAST`` code points with ``TIMES`` or more
    occurrences. Words are counted in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8") for w in held], pa.string()),
                 pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for word, n in text_words(doc_id, text):
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(id_col).cast("string").alias("id"),
                          text_of(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def _padded(word: Column) -> Column:
    return F.concat(F.lit("^"), word, F.lit("$"))


def frequent_grams(vocab: DataFrame, dictionary: int = DICTIONARY) -> frozenset[str]:
    """The dictionary: grams that are too frequent to stand alone. Below ``dictionary``
    entries for each length, as each has more than that share of all grams."""
    words = vocab.select(_padded(F.col("word")).alias("p"))
    total = words.agg(F.sum(F.length("p") - 1)).first()[0] or 0
    kept: set[str] = set()
    level: list[str] | None = None
    for q in range(SHORTEST, LONGEST):
        grams = words.select(F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("p") - q + 1, F.lit(1))),
            lambda i: F.substring(F.col("p"), i, F.lit(q)))).alias("gram"))
        counts = grams.groupBy("gram").count().where(F.col("count") > total / dictionary)
        level = [r[0] for r in counts.collect()
                 if level is None or r[0][:-1] in kept]
        kept.update(level)
    return frozenset(kept)


def gram_ends(padded: str, frequent: frozenset[str]) -> list[int]:
    """For each gram, where the grams up to it end at the latest."""
    ends, reach, n = [], 0, len(padded)
    for j in range(n - 1):
        q = SHORTEST
        while q < LONGEST and j + q < n and padded[j:j + q] in frequent:
            q += 1
        reach = max(reach, j + q)
        ends.append(reach)
    return ends


def shared_bound(ends: list[int]) -> int:
    """Grams that any one edit of the word leaves alone, at both ends together."""
    n = len(ends)
    worst = 0
    for place in range(1, n + 1):
        before = bisect_right(ends, place)
        after = n - 1 - place if place < n else 0      # a character at ``place`` is edited
        worst = max(worst, n - before - max(after, 0))
    return n - worst


def merged_lists(padded: str, ends: list[int], t: int, length: int) -> Iterator[int]:
    """Keys of the merged gram lists for ``t`` shared grams of a word of ``length``."""
    slack = t // 6
    agree = t - slack
    n = len(ends)
    for r in [*range(0, agree, slack + 1), agree]:
        left = padded[:ends[r - 1]] if r else ""
        right = padded[n - (agree - r):] if agree > r else ""
        digest = xxhash.xxh3_64_intdigest(f"{length}|{t}|{r}|{left}|{right}")
        yield digest - (1 << 64) if digest >> 63 else digest


def _bounds_of(length: int) -> range:
    """The bounds that a word of ``length`` characters can have: an edit touches from two to
    ``LONGEST`` of its ``length + 1`` grams."""
    return range(length + 1 - LONGEST, length)


def index_keys(word: str, frequent: frozenset[str]) -> Iterator[int]:
    padded = f"^{word}$"
    ends = gram_ends(padded, frequent)
    return merged_lists(padded, ends, shared_bound(ends), len(word))


def lookup_keys(word: str, frequent: frozenset[str]) -> Iterator[int]:
    """Keys under which words one edit away, with no larger bound, are indexed."""
    padded = f"^{word}$"
    ends = gram_ends(padded, frequent)
    bound = shared_bound(ends)
    for length in (len(word) - 1, len(word), len(word) + 1):
        for t in _bounds_of(length):
            if 0 < t <= bound and length >= LEAST:
                yield from merged_lists(padded, ends, t, length)


def _keyed(vocab: DataFrame, keys, frequent, names: tuple[str, str]) -> DataFrame:
    shared = vocab.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            found, rows = [], []
            for i, word in enumerate(words):
                for key in keys(word, shared.value):
                    found.append(key)
                    rows.append(i)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), batch.column("word").take(at),
                 batch.column("n").take(at)], names=["key", *names])

    return vocab.select("word", "n").mapInArrow(
        run, f"key long, {names[0]} string, {names[1]} long")


def near_pairs(vocab: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """``(a, n_a, b, n_b)``, a < b: every two words that differ by exactly one inserted,
    deleted or replaced code point, once."""
    frequent = frequent_grams(vocab, dictionary)
    index = _keyed(vocab, index_keys, frequent, ("x", "n_x"))
    look = _keyed(vocab, lookup_keys, frequent, ("y", "n_y"))
    met = index.join(look, "key").where(
        (F.col("x") != F.col("y")) & (F.levenshtein("x", "y", 1) == 1))
    first = F.col("x") < F.col("y")
    return met.select(
        F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"),
        F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"),
        F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"),
        F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b")).distinct()


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of ``links (word, up)``: links followed to the last, by doubling. Each
    link at least doubles n, so a chain has fewer than 64 links and this at most 7 rounds."""
    while True:
        above = links.select(F.col("word").alias("up"), F.col("up").alias("higher"))
        links = materialise(links.join(above, "up", "left").select(
            "word", F.coalesce("higher", "up").alias("up"),
            F.col("higher").isNotNull().alias("moved")), "spelling-roots")
        moved = links.where("moved").limit(1).count()
        links = links.select("word", "up")
        if not moved:
            return links.select("word", F.col("up").alias("root"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   dictionary: int = DICTIONARY) -> DataFrame:
    """One row per word: ``(word, form, root, n, n_near, form_n)``.

    Null texts have no words; a null id counts as the empty text in the checksum that
    misspells runs. Repeated rows are counted each. Of near words with equal n the smallest is
    the form. An empty table, or one without words, gives no rows.
    """
    vocab = materialise(vocabulary(docs, id_col, text_col), "spelling-words")
    pairs = materialise(near_pairs(vocab, dictionary), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"),
                        F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"),
                     F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    counts = -F.col("best.less") >= 2 * F.col("n")
    near = materialise(best.select(
        "word", "n_near", F.when(counts, F.col("best.other")).alias("form"),
        F.when(counts, -F.col("best.less")).alias("form_n")), "spelling-near")
    roots = _roots(near.where("form IS NOT NULL").select("word", F.col("form").alias("up")))
    return vocab.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
