"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. A lexicon is induced from the training texts: words, and word beginnings (stems), that
   toxic texts have far more often than others by a likelihood-ratio test. A short fixed list
   of insults is always in it.
2. Every text becomes a few dense numbers: lexicon and stem hits and their density, hits near
   second-person words, and rates of capitals, punctuation, repetition and obfuscation.
3. Boosted trees are fitted on one part of the labelled rows, and an isotonic regression on
   another part turns their output into a calibrated score.

Only the fit uses a sample of the labelled rows (``TRAIN_ROWS``); scoring reads every text
whole.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch.llm.common import materialise

# Labelled rows that the model is fitted on: those whose hashed id comes first.
TRAIN_ROWS = 20_000
# Entries of the induced lexicon, best first.
LEXICON_ENTRIES = 2_000
STEMS = (4, 5, 6)
MIN_G2 = 20.0           # likelihood-ratio statistic of an entry
MIN_LIFT = 8.0          # how much more often toxic texts have it
TREES = 20
DEPTH = 3
SEED = 20240307

# Fixed word lists.
INSULTS = ("bastard", "clown", "creep", "disgusting", "dumb", "dumbass", "filth", "fool",
           "freak", "garbage", "idiot", "idiots", "imbecile", "jerk", "loser", "losers",
           "moron", "morons", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin",
           "worthless")
SECOND_PERSON = ("you", "your", "yours", "yourself", "ur", "u", "du", "dich", "dir", "dein",
                 "ihr", "euch", "tu", "toi", "te", "ton", "vous", "votre", "usted", "ustedes",
                 "ti", "tus")
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
             "!": "i"}
FEATURES = ("lex_hits", "lex_density", "lex_distinct", "stem_hits", "stem_density",
            "stem_distinct", "weight", "near_you", "you_density", "hidden_hits", "caps_rate",
            "shout_rate", "punct_rate", "exclaim_rate", "repeat_rate", "odd_rate", "log_words")

_WORD = re.compile(r"[^\W\d_]+")
# What stands between two letters of one word written with digits or signs.
_GAP = re.compile(r"(?<=[^\W\d_])[\d_@$!*]++(?=[^\W\d_])")
_ENDS = ".,;:!?()\"'"
_SIGNS = b"0123456789@$!*"
_CAPITALS = string.ascii_uppercase.encode()
_PUNCTUATION = string.punctuation.encode()
_ENTRY_ROWS = 50_000    # lexicon candidates in one Arrow batch
_REACH = 5              # words between a hit and a second-person word
_FROM_LOOKALIKE = str.maketrans(LOOKALIKE)


@dataclass
class Lexicon:
    """Weights of words and of word beginnings, which are a hyphen short of ``entries``."""

    words: dict[str, float]
    stems: dict[str, float]

    @cached_property
    def begins(self) -> frozenset[str]:
        return frozenset(s[:STEMS[0]] for s in self.stems)

    def stem_weight(self, word: str) -> float:
        return max(self.stems.get(word[:n], 0.0) if len(word) > n else 0.0 for n in STEMS)


def entries(text: str) -> set[str]:
    """Lexicon candidates of a text: its words, and word beginnings marked by a hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}


def induce(train: DataFrame) -> Lexicon:
    """Lexicon of ``train (text, label)``: entries by document counts in either class."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for batch in batches:
            for text, label in zip(*(batch.column(n).to_pylist() for n in ("text", "label"))):
                (toxic if label == 1 else clean).update(entries(text or ""))
        every = list(toxic.keys() | clean.keys())
        for at in range(0, len(every), _ENTRY_ROWS):
            part = every[at:at + _ENTRY_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([toxic[e] for e in part], pa.int64()),
                 pa.array([clean[e] for e in part], pa.int64())],
                names=["entry", "toxic", "clean"])

    t, c = train.agg(F.count_if(F.col("label") == 1),
                     F.count_if(F.col("label") == 0)).first()
    sums = train.select("text", "label").mapInArrow(
        count, "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a >= 3")
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    lift = (a / (t + 1)) / (b / (c + 1))
    n, x = F.col("a") + F.col("b"), F.lit(t / max(1, t + c))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g2 = (part(F.col("a"), n * x) + part(F.col("b"), n * (1 - x))) * 2
    best = sums.select("entry", lift.alias("lift"), g2.alias("g2")).where(
        (F.col("g2") >= MIN_G2) & (F.col("lift") >= MIN_LIFT)
    ).orderBy(F.desc("g2"), "entry").limit(LEXICON_ENTRIES)
    words = {w: 3.0 for w in INSULTS}
    stems = {}
    for r in best.collect():
        entry, weight = r["entry"], math.log(r["lift"])
        if entry.endswith("-"):
            stems[entry[:-1]] = weight
        else:
            words[entry] = max(weight, words.get(entry, 0.0))
    return Lexicon(words, stems)


def is_odd(text: str) -> bool:
    """Whether two letters stand around digits or signs (digits and underscores may stand on
    either side of the signs). One pass, however the characters repeat."""
    for m in _GAP.finditer(text):
        gap = m.group()
        first = min((k for c in "@$!*" if (k := gap.find(c)) >= 0), default=-1)
        if first < 0:
            if gap.strip("_"):
                return True
        elif "_" not in gap[first:max(gap.rfind(c) for c in "@$!*")]:
            return True
    return False


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``; all zero if null."""
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    distinct = set(words)
    n = max(1, len(words))
    known = distinct & lexicon.words.keys()
    begun = {w for w in distinct if w[:STEMS[0]] in lexicon.begins}
    stemmed = {w: x for w in begun if (x := lexicon.stem_weight(w)) > 0}
    lex = [i for i, w in enumerate(words) if w in known] if known else []
    stem = [i for i, w in enumerate(words) if w in stemmed] if stemmed else []
    you = [i for i, w in enumerate(words) if w in _YOU] if distinct & _YOU else []
    weight = sum(lexicon.words[words[i]] for i in lex) + sum(stemmed[words[i]] for i in stem)
    near = sum(_is_near(you, i) for i in {*lex, *stem}) if you else 0
    raw = text.encode("utf-8", "replace")
    signs = len(raw) - len(raw.translate(None, _SIGNS))
    odd = [t for t in lower.split() if is_odd(t.strip(_ENDS))] \
        if signs and is_odd(lower) else []
    hidden = sum(any(w in lexicon.words for w in _plain(t)) for t in odd)
    tokens = text.split()
    size = max(1, len(raw))
    same = np.frombuffer(raw, np.uint8)
    runs = int(((same[2:] == same[1:-1]) & (same[1:-1] == same[:-2])).sum())
    return [float(len(lex)), len(lex) / n, float(len(known)),
            float(len(stem)), len(stem) / n, float(len(stemmed)),
            weight, float(near), len(you) / n, float(hidden),
            (len(raw) - len(raw.translate(None, _CAPITALS))) / size,
            sum(map(str.isupper, tokens)) / max(1, len(tokens)),
            (len(raw) - len(raw.translate(None, _PUNCTUATION))) / size,
            raw.count(b"!") / size, runs / size, len(odd) / n, math.log1p(len(words))]


_YOU = frozenset(SECOND_PERSON)


def _is_near(places: list[int], at: int) -> bool:
    k = bisect_left(places, at)
    return any(abs(at - p) <= _REACH for p in places[max(0, k - 1):k + 1])


def _plain(token: str) -> list[str]:
    """Readings of an obfuscated token: look-alikes replaced, and signs left out."""
    token = token.strip(_ENDS)
    replaced = token.translate(_FROM_LOOKALIKE)
    return [*_WORD.findall(replaced), "".join(_WORD.findall(token)),
            "".join(_WORD.findall(replaced))]


def with_features(docs: DataFrame, lexicon: Lexicon, text_col: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        found = shared.value
        return pd.Series([features(t, found) for t in texts], dtype=object)

    out = docs.select(*keep, dense(F.col(text_col).cast("string")).alias("nw_x"))
    return out.select(*keep, *(F.col("nw_x")[i].alias(f) for i, f in enumerate(FEATURES)))


@dataclass
class Model:
    """A fitted model; without both classes in the training rows, only their toxic share."""

    base: float
    lexicon: Lexicon | None = None
    trees: object = None
    calibration: object = None


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic",
                  limit: int = TRAIN_ROWS) -> DataFrame:
    """``(id, text, label)`` of the labelled documents outside the held-out fold: the
    ``limit`` labels whose hashed id comes first, with every row of their documents."""
    key = F.col(id_col)
    chosen = labels.where(key.isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col) != 0)) \
        .groupBy(key.alias("id")).agg(F.max(label_col).cast("double").alias("label")) \
        .orderBy(F.xxhash64(F.lit(SEED), F.col("id").cast("string")), "id").limit(limit)
    texts = docs.select(key.alias("doc"), F.col(text_col).cast("string").alias("text"))
    # at most ``limit`` rows
    return texts.join(F.broadcast(chosen), texts["doc"] == chosen["id"]).select(
        F.col("id").cast("string").alias("id"), "text", "label")


def fit(rows: DataFrame) -> Model:
    """Fit on rows ``(id, text, label 0 or 1)``, as :func:`training_rows` gives them.

    Folds 1 to 3 of the hashed id give the lexicon and train the trees, fold 4 the
    calibration, which so sees only texts that neither was made from (all rows do all of it if
    a part lacks a class).
    """
    rows = materialise(rows, "tox-train")
    n, positive = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    base = (positive or 0) / max(1, n)
    if not 0 < base < 1:
        return Model(base)
    rows = rows.withColumn("fold", fold("id"))
    parts = {r["fold"] for r in rows.groupBy("fold").agg(
        F.countDistinct("label").alias("n")).where("n > 1").collect()}
    apart = 4 in parts and bool({1, 2, 3} & parts)
    lexicon = induce(rows.where("fold <> 4") if apart else rows)
    table = materialise(_assembled(with_features(rows, lexicon, "text", ["fold", "label"])),
                        "tox-features")
    first = table.where("fold <> 4") if apart else table
    last = table.where("fold = 4") if apart else table
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.3,
                          seed=SEED, cacheNodeIds=False).fit(first)
    calibration = IsotonicRegression(featuresCol="p").fit(_probability(trees, last, "label"))
    return Model(base, lexicon, trees, calibration)


def _assembled(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in FEATURES]
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features") \
        .transform(rows).select(*rest, "features")


def _probability(trees, rows: DataFrame, keep: str) -> DataFrame:
    return trees.transform(rows).select(keep, vector_to_array("probability")[1].alias("p"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, score, predicted)``.

    Null and empty texts are scored like any other (all features zero). Without both classes
    in the training rows every score is the toxic share of those rows (0 without rows).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model.trees is None:
        out = rows.select("id", F.lit(float(model.base)).alias("score"))
    else:
        table = _assembled(with_features(rows, model.lexicon, "text", ["id"]))
        out = model.calibration.transform(_probability(model.trees, table, "id")).select(
            "id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")).alias("score"))
    return out.select(F.col("id").alias(id_col), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
