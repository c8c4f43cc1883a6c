"""Suffix dedup, spelling variants and the prefix trie against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from namewatch.llm import catalog, spelling, suffixes, trie
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import rows_of, same

SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
SPELL = ("word", "form", "root", "n", "n_near", "form_n")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
            .select("doc_id", "text").collect()]


# -- suffix dedup ----------------------------------------------------------------------------------

def _ordered(spark, rows):
    """Rows in document order."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in df.orderBy(
        F.col("doc_id").asc_nulls_first(),
        F.md5(F.coalesce("text", F.lit("")).cast("binary"))).collect()]


def _check_suffixes(spark, docs, rows):
    got = suffixes.digest(suffixes.dedup(docs))
    same(rows_of(got, *SUFFIX), brute.suffixes(_ordered(spark, rows)))


def test_suffix_hostile(spark, hostile, hostile_docs):
    _check_suffixes(spark, hostile_docs, hostile)


def test_suffix_small(spark, small):
    got = catalog.QUERIES["op11_suffix_dedup"](spark, SF_SMALL)
    same(rows_of(got, *SUFFIX), brute.suffixes(_ordered(spark, small)))


@pytest.mark.parametrize("seed", range(3))
def test_suffix_random(spark, seed, monkeypatch):
    """Texts of few letters, with matches from 95 bytes on, cut anywhere; overlaps; slices
    smaller than a text."""
    rng = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdefgh é"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [make(rng.randrange(95, 400)) for _ in range(6)] + ["ab" * 80, "x" * 130]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            text = rng.choice(pool)
            a = rng.randrange(0, len(text) - 90)
            parts += [make(rng.randrange(0, 40)), text[a:a + rng.randrange(90, 300)]]
        rows.append((rng.randrange(0, 60), "".join(parts)))
    monkeypatch.setattr(suffixes, "SLICE", 700 if seed == 1 else 1 << 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _check_suffixes(spark, docs, rows)


def test_slices_agree(hostile):
    """What a slice finds does not depend on where slices are cut."""
    column = pa.array([(t or "").encode() for _, t in hostile], pa.binary())
    texts = suffixes.Texts(column)

    def found(size):
        out = set()
        for start in range(0, len(texts.data), size):
            end = min(start + size, len(texts.data))
            _, place, n = suffixes.chosen_blocks(texts, start, end)
            out |= {p + k for p, m in zip(place.tolist(), n.tolist()) for k in range(m)}
        return out

    want = {int(b) + i for b, e in zip(texts.bounds, texts.bounds[1:])
            for i in range(int(e - b) - suffixes.LENGTH + 1)}
    assert found(1 << 20) == want and found(997) == want


def test_cover():
    period = suffixes.PERIOD
    assert {(a - b) % period for a in suffixes.COVER for b in suffixes.COVER} == set(range(period))
    mask = suffixes.keep_mask(300, np.array([150]), np.array([5]))
    assert np.flatnonzero(~mask).tolist() == [*range(5, 105), *range(94 + 11, 250)]


def test_suffix_edges(spark, no_docs):
    assert suffixes.dedup(no_docs).count() == 0
    docs = spark.createDataFrame(
        [(3, "k" * 99), (3, "k" * 99), (None, "q" * 100), (1, "q" * 100), (2, "q" * 101)],
        "id long, body string")
    got = suffixes.dedup(docs, "id", "body")
    assert {(r.id, r.n_removed, r.n_spans, len(r.kept)) for r in got.collect()} == {
        (3, 0, 0, 99), (None, 0, 0, 100), (1, 100, 1, 0), (2, 101, 1, 0)}


# -- spelling variants -----------------------------------------------------------------------------

def _check_spelling(docs, rows, **options):
    got = spelling.group_variants(docs, **options)
    words = brute.spelling_words(rows)
    same(rows_of(got, *SPELL), brute.spelling(words))
    return words


@pytest.mark.parametrize("dictionary", [spelling.DICTIONARY, 20])
def test_spelling_hostile(spark, hostile, hostile_docs, no_docs, dictionary):
    _check_spelling(hostile_docs, hostile, dictionary=dictionary)
    assert spelling.group_variants(no_docs).count() == 0


def test_spelling_variants(spark):
    """Chains of forms, ties, long words, words that differ at either end, repeated rows."""
    counts = {"amount": 40, "amont": 20, "amon": 9, "amomt": 10, "amout": 20, "bmount": 4,
              "amounts": 3, "zamount": 3, "Überraum": 8, "Überaum": 4, "ueberraum": 4,
              "abcde": 3, "abcdf": 3, "abced": 3, "bcdef": 3, "x" * 4000: 7,
              "x" * 4001: 3, "x" * 2000 + "y" + "x" * 1999: 3, "kahn": 50, "kahns": 3, "kahnt": 6}
    rows = [(i % 7, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    rows += rows[:2] + [(None, "amount,amount;AMOUNT"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = _check_spelling(docs, rows, dictionary=30)
    assert len(words) > 15


def test_spelling_random(spark):
    rng = random.Random(5)
    syllables = ["er", "th", "tion", "an", "é", "of", "ung", "ba"]
    rows = []
    for i in range(300):
        rows.append((i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
                                 for _ in range(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _check_spelling(docs, rows)
    _check_spelling(docs, rows, dictionary=10)


def test_bounds_hold():
    """Two words one edit apart always share a merged list, and as many grams as promised."""
    rng = random.Random(9)
    for _ in range(3000):
        letters = "ab" if rng.random() < 0.5 else "abcdeé"
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 30)))
        at, kind = rng.randrange(len(a) + 1), rng.randrange(3)
        b = (a[:at] + rng.choice(letters) + a[at:] if kind == 0 else
             a[:at] + a[at + 1:] if kind == 1 else a[:at] + rng.choice(letters) + a[at + 1:])
        if len(b) < 5 or not brute.one_edit(a, b):
            continue
        grams = ["^" + a, a + "$", "^" + b]
        frequent = frozenset(g for p in grams for q in (2, 3) for g in
                             (p[i:i + q] for i in range(len(p))) if rng.random() < 0.4)
        ends = spelling.gram_ends(f"^{a}$", frequent)
        assert 2 <= len(a) - spelling.shared_bound(ends) + 1 <= spelling.LONGEST
        ab = set(spelling.index_keys(a, frequent)) & set(spelling.lookup_keys(b, frequent))
        ba = set(spelling.index_keys(b, frequent)) & set(spelling.lookup_keys(a, frequent))
        assert ab or ba


# -- prefix trie -----------------------------------------------------------------------------------

def _turns(seed: int):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 230), 300, 400, 401, 402]:
        depth = rng.randrange(1, 9)
        for t in range(depth):
            text = rng.choice(["a", "b", "hello there", None, "é🎉"])
            rows.append((c, None if t == 0 and c % 3 == 0 else t,
                         rng.choice(["user", "assistant", None]), text))
    # a hot conversation, and one that is a prefix of it
    for c in range(1000, 1040):
        rows += [(c, t, "user", f"turn {t}") for t in range(5 if c % 4 else 3)]
    rows += [(None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("container", [trie.CONTAINER, 20, 3, 1])
def test_trie_random(spark, container):
    rows = _turns(container)
    turns = spark.createDataFrame(rows, TURNS).withColumn("path", F.lit("x")).repartition(3)
    got = trie.nodes(turns, container)
    same(rows_of(got, *NODE), brute.prefix_trie(rows))


def test_trie_small(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = catalog.QUERIES["op13_prefix_trie"](spark, SF_SMALL)
    same(rows_of(got, *NODE), brute.prefix_trie(rows))


def test_trie_edges(spark):
    """No rows; ties in turn go by role; repeated rows are turns; turnless conversations."""
    assert trie.nodes(spark.createDataFrame([], TURNS)).count() == 0
    ties = [(7, 1, "b", "one"), (7, 1, "a", "two"), (7, 1, "a", "two")]
    plain = [(7, 1, "a", "two"), (7, 2, "a", "two"), (7, 3, "b", "one")]
    got = trie.nodes(spark.createDataFrame(ties, TURNS))
    same(rows_of(got, *NODE), brute.prefix_trie(plain))
    # shorter than the turns it would share, and no head conversation: only the root has it
    alone = next(c for c in range(101, 200) if trie_heads(c) > 1)
    got = trie.nodes(spark.createDataFrame([(alone, 0, "user", "hi")], TURNS))
    assert rows_of(got, *NODE) == [(alone, 0, None, 1, 0, 1, 0, brute.sha(str(alone)))]


def trie_heads(c: int) -> int:
    import zlib

    return zlib.crc32(str(c).encode()) % 6
