"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams (1 to 3 characters) of every labelled training text by
language, in numpy inside the tasks; the counts of all tasks are added up by Spark. The
log-probability matrix has ``BUCKETS`` rows and one column for each language and is
broadcast. Scoring hashes a chunk of texts at a time and sums matrix rows by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
BITS = 15
BUCKETS = 1 << BITS
SMOOTHING = 0.5
# Languages in the broadcast matrix: 1024 columns of floats are 128 MB.
MAX_LANGUAGES = 1024
UNDETERMINED = "und"
_BLOCK = 512            # counts in one row of the training result
_CHARS = 1 << 19        # characters hashed at a time


def held_out(doc_id) -> bool:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text index, bucket)`` arrays of all n-grams, by order.

    Texts are lower-cased; a run of anything but letters counts as one space, and a space
    stands before and after each text. No n-gram crosses from one text to another.
    """
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32)
             for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    chars = np.concatenate(parts)
    chars = np.where(_letters()[chars], chars, 32)
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32) | (owner[1:] != owner[:-1])
    chars, owner = chars[keep].astype(np.uint64), owner[keep]
    mixed = np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(chars) < n:
            break
        # hash of the n characters from each place on
        mixed = (mixed[:len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15)
                 + chars[n - 1:] + np.uint64(n))
        if n in ORDERS:
            h = mixed ^ (mixed >> np.uint64(29))
            h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
            whole = owner[:len(h)] == owner[n - 1:]
            yield owner[:len(h)][whole], h[whole].astype(np.int64)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """``(text indices, texts)`` of at most ``_CHARS`` characters at a time; a longer text
    comes in pieces."""
    owners: list[int] = []
    some: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), _CHARS):
            piece = text[at:at + _CHARS]
            if some and size + len(piece) > _CHARS:
                yield np.array(owners), some
                owners, some, size = [], [], 0
            owners.append(i)
            some.append(piece)
            size += len(piece)
    if some:
        yield np.array(owners), some


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of every language in ``docs``; rows without text or language teach nothing."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).dropna()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the place after the buckets counts the texts
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang")["text"]:
                texts = part.tolist()
                total = counts.setdefault(lang, np.zeros(BUCKETS + _BLOCK, np.int64))
                total[BUCKETS] += len(texts)
                for _, some in _pieces(texts):
                    for _, bucket in gram_buckets(some):
                        total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        for lang, total in counts.items():
            yield pd.DataFrame({"lang": lang, "block": range(BUCKETS // _BLOCK + 1),
                                "counts": list(total.reshape(-1, _BLOCK))})

    parts = rows.mapInPandas(count, "lang string, block int, counts array<long>")
    flat = parts.select("lang", "block", F.posexplode("counts").alias("at", "n")).where("n > 0")
    sums = flat.groupBy("lang", "block", "at").agg(F.sum("n").alias("n"))
    table = sums.groupBy("lang", "block").agg(
        F.collect_list(F.struct("at", "n")).alias("cells"))     # _BLOCK cells at most
    counts: dict[str, np.ndarray] = {}
    for r in table.toLocalIterator():
        total = counts.setdefault(r["lang"], np.zeros(BUCKETS + _BLOCK, np.int64))
        if len(counts) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: raise MAX_LANGUAGES")
        for at, n in r["cells"]:
            total[r["block"] * _BLOCK + at] = n
    return Model({lang: total[:BUCKETS] for lang, total in counts.items()},
                 {lang: int(total[BUCKETS]) for lang, total in counts.items()})


class Model:
    """Languages in code point order, their log priors and the log-probability matrix."""

    def __init__(self, counts: dict[str, np.ndarray], texts: dict[str, int]):
        self.langs = sorted(counts)
        if counts:
            n = np.array([counts[x] for x in self.langs], np.float64) + SMOOTHING
            self.matrix = np.log(n / n.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
            t = np.array([texts[x] for x in self.langs], np.float64)
            self.prior = np.log(t / t.sum())

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``(language, probability)`` of each text; ties go to the first language.

        A text that is null or has no letter is ``und`` with score 0, as is every text if
        nothing was learned.
        """
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.langs:
            return out
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        log = np.tile(self.prior, (len(known), 1))
        for owners, some in _pieces([texts[i] for i in known]):
            for owner, bucket in gram_buckets(some):
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                if len(starts):
                    sums = np.add.reduceat(self.matrix[bucket], starts, axis=0,
                                           dtype=np.float64)
                    np.add.at(log, owners[owner[starts]], sums)
        if known:
            best = log.argmax(axis=1)
            share = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
            for k, i in enumerate(known):
                out[i] = (self.langs[best[k]], float(share[k]))
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, lang_pred, score)``.

    Null texts and texts without a letter (Unicode categories L; number signs such as a
    superscript or a Roman numeral sign are none) are ``und`` with score 0. Of equally likely
    languages the first by code point is predicted. Repeated rows are predicted each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(texts.tolist()),
                            columns=["lang_pred", "score"])

    return docs.select(F.col(id_col), classify(F.col(text_col).cast("string")).alias("p")) \
        .select(id_col, "p.lang_pred", "p.score")
