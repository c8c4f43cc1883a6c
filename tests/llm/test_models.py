"""Mixing, sharding, the trained operators and the pipeline."""

from __future__ import annotations

import random
import re
import time
from collections import Counter
from fractions import Fraction
from itertools import product

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from namewatch.llm import catalog, langid, mixing, sharding, toxicity
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import brute
from tests.llm.conftest import rows_of, same

# -- mixing ----------------------------------------------------------------------------------


def test_targets_fill_up_and_share_the_excess():
    got = mixing.targets({"a": 10, "b": 1000, "c": 90, None: 500})
    # weights 5, 2, 1, 5; a and c stop at three times their size, then nothing is above
    assert got["a"] == 30 and sum(got.values()) == 1600
    assert got["c"] <= 270 and got[None] <= 1500
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0, "b": 7}) == {"a": 0, "b": 7}
    even = mixing.targets({"x": 800, "y": 800, "z": 800})
    assert even == {"x": Fraction(1500), "y": Fraction(600), "z": Fraction(300)}


def test_knapsack_is_nearest():
    rng = random.Random(4)
    for _ in range(200):
        lengths = rng.sample(range(0, 30), rng.randrange(1, 5))
        counts = [rng.randrange(0, 4) for _ in lengths]
        budget = rng.randrange(0, 90)
        got = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= g <= c for g, c in zip(got, counts))
        best = min(abs(budget - s) for s in (
            sum(n * k for n, k in zip(lengths, ks))
            for ks in product(*(range(c + 1) for c in counts))))
        assert abs(budget - sum(n * g for n, g in zip(lengths, got))) == best


def test_allocation_comes_near_and_stays_in_bounds():
    rng = random.Random(6)
    for top in (40, 3_000, 20_000):
        for _ in range(25):
            lengths = sorted(rng.sample(range(1, top), rng.randrange(1, 30)))
            counts = [rng.randrange(1, 400) for _ in lengths]
            total = sum(n * c for n, c in zip(lengths, counts))
            budget = rng.randrange(0, 3 * total + 1)
            got = mixing.allocate(lengths, counts, budget)
            assert all(0 <= g <= 3 * c for g, c in zip(got, counts))
            assert abs(budget - sum(n * g for n, g in zip(lengths, got))) <= max(
                lengths[0], budget // 10_000)
    assert mixing.allocate([], [], 0) == [] and mixing.allocate([0], [4], 0) == [0]
    assert mixing.allocate([5], [2], 30) == [6]


def test_share_out_is_proportional():
    assert mixing.share_out([1, 10, 100], [50, 50, 50], 555) == [5, 5, 5]
    assert mixing.share_out([0, 10], [3, 2], 20) == [0, 2]


def _check_mix(rows, max_epochs=3):
    """rows: (doc_id, source, text, size, source_size, target, taken)"""
    words: Counter = Counter()
    for _, source, text, size, *_ in rows:
        assert size == len(brute.words(text))
        words[source] += size
    goal = mixing.targets(dict(words))
    taken: Counter = Counter()
    for _, source, _, size, source_size, target, took in rows:
        assert source_size == words[source] and target == pytest.approx(float(goal[source]))
        assert took % size == 0 if size else took == 0
        assert 0 <= took <= max_epochs * size
        taken[source] += took
    return words, goal, taken


def test_mix_hostile(hostile_docs, no_docs):
    texts = rows_of(hostile_docs, "n_chars", "source", "text")
    by_row = hostile_docs.select(F.col("n_chars").alias("doc_id"), "text", "source")
    got = {r[0]: r[1:] for r in rows_of(mixing.mix(by_row), "doc_id", "size", "source_size",
                                         "target", "taken")}
    rows = [(i, s, t, *got[i]) for i, s, t in texts]
    words, goal, taken = _check_mix(rows)
    # few documents of very uneven size: half of the largest is the most that can be missing
    largest = {s: max(len(brute.words(t)) for _, q, t in texts if q == s) for s in words}
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1 for s in words)
    again = rows_of(mixing.mix(by_row.repartition(3)), "doc_id", "taken")
    assert again == sorted(((i, v[3]) for i, v in got.items()), key=repr)
    assert mixing.mix(no_docs).count() == 0
    # repeated and null ids come back once for each row
    assert mixing.mix(hostile_docs).count() == hostile_docs.count()


def test_mix_small(spark):
    got = catalog.QUERIES["op9_mixing"](spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source", "text")
    rows = rows_of(docs.join(got, "doc_id"), "doc_id", "source", "text", "size", "source_size",
                   "target", "taken")
    words, goal, taken = _check_mix(rows)
    assert len(rows) == docs.count()
    assert sum(abs(taken[s] - goal[s]) for s in words) < 0.002 * sum(words.values())


def test_mix_hot_length(spark):
    """One source whose documents all have one length, with thousands of documents."""
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 6000, "hot").otherwise("z")
        .alias("source"), F.concat(F.lit("w x y "), F.col("id").cast("string")).alias("text"))
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    total = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"))
    assert all(0 <= r["g"] - r["t"] < 4.5 for r in total.collect())


def test_mix_takes_some_of_equal_rows(spark):
    """Rows that repeat id and text are taken as often as the target needs, not all or none."""
    rows = [(None, "w x y z", "a", i) for i in range(300)]
    rows += [(7, "v w x", None, i) for i in range(200)] + [(i, f"w x {i}", "b", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, l long")
    goal = mixing.targets({"a": 1200, "b": 900, None: 600})
    for table in (docs.repartition(7), docs.coalesce(1)):
        got = mixing.mix(table)
        assert got.count() == 800
        sums = dict(rows_of(got.groupBy("source_size").agg(F.sum("taken").alias("t")),
                            "source_size", "t"))
        out = mixing.apply_mix(table)
        assert out.columns == docs.columns
        words = Counter(r[0] for r in rows_of(out, "source"))
        for name, size, n in (("a", 1200, 4), ("b", 900, 3), (None, 600, 3)):
            assert abs(sums[size] - goal[name]) <= n / 2 and words[name] * n == sums[size]


def test_applied_mix_repeats_documents(hostile_docs, no_docs):
    by_row = hostile_docs.withColumn("doc_id", F.col("n_chars"))
    took = {r[0]: r[2] // r[1] for r in rows_of(mixing.mix(by_row), "doc_id", "size", "taken")
            if r[1]}
    out = mixing.apply_mix(by_row)
    assert out.columns == hostile_docs.columns
    assert Counter(r[0] for r in rows_of(out, "doc_id")) == {k: v for k, v in took.items() if v}
    assert mixing.apply_mix(no_docs).count() == 0


# -- sharding --------------------------------------------------------------------------------


def test_hypergeometric_follows_its_law():
    import math

    rng = random.Random(9)
    good, bad, draws, n = 7, 11, 6, 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(7):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(seen[k] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1
    big = sharding.hypergeometric(rng, 10**10, 10**11, 10**9)
    assert abs(big - 10**9 / 11) < 10**5


def test_matrix_has_its_margins():
    rows = [(0, 5), (1, 0), (2, 17), (7, 1)]
    sizes = sharding.shard_sizes(23, 4)
    lines = dict(sharding.matrix(rows, sizes, 3))
    assert {p: sum(line) for p, line in lines.items()} == dict(rows)
    assert [sum(c) for c in zip(*lines.values())] == sizes == [6, 6, 6, 5]


def _check_shards(rows, docs, shards=16):
    """rows: (doc_id, size, crc, shard, slot)"""
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=repr) == sorted(
        ((d, len((t or "").encode()) + 1, brute.crc(t or "")) for d, t in docs), key=repr)
    slots: dict[int, list] = {}
    for *_, shard, slot in rows:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert sum(sizes) == len(docs) and max(sizes) - min(sizes) <= 1
    assert set(slots) <= set(range(shards))


def test_shards_hostile(hostile, hostile_docs, no_docs, monkeypatch):
    columns = ("doc_id", "size", "text_crc32", "shard", "slot")
    _check_shards(rows_of(sharding.shard(hostile_docs), *columns), hostile)
    monkeypatch.setattr(sharding, "ORDER_GROUP", 2)
    monkeypatch.setattr(sharding, "BROADCAST_LINES", 0)
    _check_shards(rows_of(sharding.shard(hostile_docs.repartition(7)), *columns), hostile)
    assert sharding.shard(no_docs).count() == 0
    placed = sharding.write_order(hostile_docs)
    assert placed.columns == [*hostile_docs.columns, "shard", "slot"]
    assert placed.count() == len(hostile)
    clash = hostile_docs.withColumns({"SIZE": F.lit(0), "slot": F.lit("x"), "nw_at": F.lit(1)})
    corpus = sharding.sharded_corpus(clash)
    ours = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert corpus.columns == ours + [c for c in hostile_docs.columns if c != "doc_id"] + ["nw_at"]
    _check_shards(rows_of(corpus, *columns), hostile)
    same(rows_of(corpus, *hostile_docs.columns), rows_of(hostile_docs, *hostile_docs.columns))
    assert sharding.sharded_corpus(no_docs).count() == 0


def test_sharded_corpus_has_the_places_of_the_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    same(rows_of(sharding.sharded_corpus(docs), "doc_id", "shard", "slot"),
         rows_of(sharding.shard(docs), "doc_id", "shard", "slot"))


def test_shards_small(spark):
    got = catalog.QUERIES["op10_sharding"](spark, SF_SMALL)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
            .select("doc_id", "text").collect()]
    assert {tuple(r) for r in got.select("law", "grown_shard").distinct().collect()} == {
        ("rows", None)}
    _check_shards(rows_of(got, "doc_id", "size", "text_crc32", "shard", "slot"), docs)


def test_shuffle_is_uniform(spark):
    """Over many seeds a row of one partition lands in each shard equally often."""
    docs = spark.range(24, numPartitions=3).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    seen: Counter = Counter()
    first: Counter = Counter()
    for seed in range(40):
        for d, s, slot in rows_of(sharding.shard(docs, shards=4, seed=seed * 10),
                                  "doc_id", "shard", "slot"):
            seen[d // 8, s] += 1
            first[slot] += d < 8
    # 40 runs x 8 rows over 4 shards: 80 expected, standard deviation about 6
    assert all(50 < seen[p, s] < 110 for p in range(3) for s in range(4))
    assert all(30 < first[slot] < 78 for slot in range(6))


# -- language identification -----------------------------------------------------------------


def test_languages_held_out(spark):
    got = catalog.QUERIES["op3_language_id"](spark, SF_CHECK)
    truth = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang")
    rows = rows_of(got.join(truth, "doc_id"), "doc_id", "held_out", "lang_pred", "lang", "score")
    assert all(r[1] == (brute.crc(r[0]) % 3 == 1) for r in rows)
    held = [r for r in rows if r[1]]
    assert sum(r[2] == r[3] for r in held) / len(held) > 0.97
    assert all(0 <= r[4] <= 1 for r in rows)


def test_bayes_by_hand():
    """The model's posterior against a dictionary of n-gram counts (no bucket is shared)."""
    import math

    train = {"de": ["der ab", "ba"], "en": ["the cat"]}
    grams = {k: [g for t in v for g in _grams(t)] for k, v in train.items()}
    every = {g for v in grams.values() for g in v}
    counts, texts = {}, {k: len(v) for k, v in train.items()}
    import numpy as np

    for lang, lines in train.items():
        counts[lang] = np.zeros(langid.BUCKETS, np.int64)
        for _, bucket in langid.gram_buckets(lines):
            counts[lang] += np.bincount(bucket, minlength=langid.BUCKETS)
    assert {k: int(v.sum()) for k, v in counts.items()} == {k: len(v) for k, v in grams.items()}
    model = langid.Model(counts, texts)
    text = "the ab, 12 THE"
    log = {}
    for lang in train:
        c, n = Counter(grams[lang]), len(grams[lang])
        log[lang] = math.log(texts[lang] / 3) + sum(
            math.log((c[g] + .5) / (n + .5 * langid.BUCKETS)) for g in _grams(text))
    assert len(every) < 60
    best = max(log, key=log.get)
    want = 1 / sum(math.exp(v - log[best]) for v in log.values())
    (lang, score), none, blank, digits = model.predict([text, None, "", "12 !?"])
    assert lang == best and score == pytest.approx(want, rel=1e-4)
    assert none == blank == digits == ("und", 0.0)


def _grams(text):
    flat = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    while "  " in flat:
        flat = flat.replace("  ", " ")
    return [flat[i:i + n] for n in langid.ORDERS for i in range(len(flat) - n + 1)]


def test_languages_hostile(spark, hostile, hostile_docs, no_docs):
    model = langid.train(hostile_docs)
    got = langid.predict(hostile_docs, model)
    rows = rows_of(got, "doc_id", "lang_pred", "score")
    assert len(rows) == len(hostile)
    blank = {d for d, t in hostile if d is not None and not any(c.isalpha() for c in t or "")}
    assert {d for d, p, s in rows if p == "und" and d is not None} == blank
    signs = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["②", "½ 12", "²", "Ⅷ", "\u0301\u0302", "_", "١٢"])], "doc_id long, text string")
    assert {r[0] for r in rows_of(langid.predict(signs, model), "lang_pred")} == {"und"}
    nothing = langid.train(no_docs)
    assert {r[0] for r in rows_of(langid.predict(hostile_docs, nothing), "lang_pred")} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


def test_long_text_in_pieces():
    texts = ["a" * 5, "bc" * langid._CHARS, "", "d"]
    got: dict[int, int] = {}
    for owners, some in langid._pieces(texts):
        assert sum(map(len, some)) <= langid._CHARS
        for o, p in zip(owners, some):
            got[int(o)] = got.get(int(o), 0) + len(p)
    assert got == {i: len(t) for i, t in enumerate(texts)}


# -- toxicity --------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    got = catalog.QUERIES["op1_toxicity"](spark, SF_CHECK)
    truth = spark.read.parquet(f"{SF_CHECK}/labels.parquet").select("doc_id", "toxic")
    rows = rows_of(got.join(truth, "doc_id", "left"), "doc_id", "held_out", "score", "predicted",
                   "toxic")
    assert all(r[1] == (brute.crc(r[0]) % 5 == 0) for r in rows)
    assert all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.5) for r in rows)
    held = [r for r in rows if r[1] and r[4] is not None]
    assert sum(r[3] == r[4] for r in held) / len(held) > 0.95
    assert sum(r[3] for r in held if r[4] == 1) / sum(r[4] for r in held) > 0.6


def test_toxicity_recall(spark):
    """Held out at the larger scale: recall, false alarms and calibration."""
    folder = SF_CHECK.replace("sf0.01", "sf0.1")
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = catalog.QUERIES["op1_toxicity"](spark, folder).where("held_out").join(truth, "doc_id")
    rows = rows_of(got, "score", "predicted", "toxic")
    assert sum(r[1] for r in rows if r[2] == 1) >= 0.9 * sum(r[2] for r in rows)
    assert sum(r[1] for r in rows if r[2] == 0) <= 0.01 * len(rows)
    assert sum((r[0] - r[2]) ** 2 for r in rows) / len(rows) < 0.02


def test_toxicity_hostile(spark, hostile, hostile_docs, no_docs):
    ids = [d for d, _ in hostile if d is not None]
    labels = spark.createDataFrame([(d, int(d % 2)) for d in ids] + [(None, 1)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(hostile_docs, labels))
    got = rows_of(toxicity.score(hostile_docs, model), "doc_id", "score", "predicted")
    assert len(got) == len(hostile) and all(0 <= r[1] <= 1 for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    one = toxicity.fit(toxicity.training_rows(hostile_docs, labels.where("toxic = 1")))
    assert {r[1] for r in rows_of(toxicity.score(hostile_docs, one), "doc_id", "score")} == {1.0}
    none = toxicity.fit(toxicity.training_rows(no_docs, labels))
    assert {r[1] for r in rows_of(toxicity.score(hostile_docs, none), "doc_id", "score")} == {0.0}


def test_training_leaves_the_held_out_fold(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    ids = [int(r[0]) for r in rows_of(toxicity.training_rows(docs, labels), "id")]
    assert sorted(ids) == [i for i in range(500) if brute.crc(i) % 5]
    assert toxicity.training_rows(docs, labels, limit=20).count() == 20


PLAIN_ODD = re.compile(r"[^\W\d_]\w*[\d@$!*]+\w*[^\W\d_]")


def test_odd_words_equal_the_plain_pattern():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1_$!é٣ -") for _ in range(rng.randrange(0, 12)))
        assert toxicity.is_odd(text) == bool(PLAIN_ODD.search(text)), text


@pytest.mark.parametrize("piece", ["a", "1", "a1", "_", "$", "a_", "1_$", "é9!", "a$_$"])
def test_toxic_features_are_linear(piece):
    lexicon = toxicity.Lexicon({"idiot": 2.0}, {"lowe": 1.5})
    began = time.perf_counter()
    toxicity.features("a" + piece * (200_000 // len(piece)) + "1" * 400 + "!", lexicon)
    toxicity.features("a" * 400 + "1" * 400, lexicon)
    assert time.perf_counter() - began < 2


def test_features_by_hand():
    lexicon = toxicity.Lexicon({"idiot": 2.0}, {"lowe": 1.5})
    f = dict(zip(toxicity.FEATURES, toxicity.features(
        "You 1d10t, an IDIOT! Loweish thing id!ot idiot", lexicon)))
    assert f["lex_hits"] == 2 and f["lex_distinct"] == 1
    assert f["stem_hits"] == 1 and f["stem_distinct"] == 1
    assert f["weight"] == pytest.approx(2 * 2.0 + 1.5)
    assert f["hidden_hits"] == 2 and f["near_you"] >= 1
    assert set(toxicity.features(None, lexicon)) == {0.0}


# -- the pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark):
    """Each stage on the output of the one before, against brute force."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
             .select("item_id", "text").collect()]
    ids = lambda df: sorted(r[0] for r in rows_of(df, "doc_id"))
    texts = lambda df: rows_of(df, "doc_id", "text")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, SF_SMALL), "test")
        out[name] = docs
        if name != "sharding":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if name == "quality":
            judged = catalog.QUERIES["op8_quality"](spark, SF_SMALL)
            assert ids(docs) == ids(judged.where("kept"))
        elif name == "near_dedup":
            assert set(ids(docs)) == {r[2] for r in brute.simhash(texts(before))}
            assert len(ids(docs)) == len(set(ids(docs)))
        elif name == "decontamination":
            assert ids(docs) == sorted(r[0] for r in brute.decontamination(texts(before), items)
                                       if not r[5])
            left = rows_of(docs, "doc_id", "text", "n_chars")
            assert not any(r[2] for r in brute.decontamination([r[:2] for r in left], items))
            same = set(texts(before))
            assert all(r[:2] in same or r[2] == len(r[1]) for r in left)
        elif name == "mixing":
            took = mixing.mix(before)
            want = Counter({r[0]: r[2] // r[1] for r in rows_of(took, "doc_id", "size", "taken")
                            if r[1]})
            assert Counter(ids(docs)) == +want
        else:
            _check_shards(rows_of(docs, "doc_id", "size", "text_crc32", "shard", "slot"),
                          texts(before))
            assert rows_of(docs, *corpus_pipeline.COLUMNS) == rows_of(
                before, *corpus_pipeline.COLUMNS)
            assert docs.where("grown_shard IS NOT NULL OR law <> 'rows' OR text_crc32 <> "
                              "crc32(coalesce(text, ''))").count() == 0
    same = rows_of(corpus_pipeline.run(spark, SF_SMALL), "doc_id", "size", "text_crc32")
    assert same == rows_of(out["sharding"], "doc_id", "size", "text_crc32")


def test_pipeline_on_hostile_documents(spark, hostile_docs, tmp_path):
    """Nulls, repeats and clashing columns pass through every stage."""
    hostile_docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark", "conversations"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(
            f"{tmp_path}/{name}.parquet")
    got = rows_of(corpus_pipeline.run(spark, str(tmp_path)), "shard", "slot")
    assert got and len(set(got)) == len(got)
    n = hostile_docs.count()
    for name, query in catalog.QUERIES.items():
        out = query(spark, str(tmp_path))
        if name not in ("op12_spelling", "op13_prefix_trie"):   # words, nodes
            assert out.count() == n, name
        if "held_out" in out.columns:
            assert out.where("held_out IS NULL").count() == 0
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(
            f"{tmp_path}/none/{name}.parquet")
    spark.read.parquet(f"{SF_SMALL}/conversations.parquet").limit(0).write.parquet(
        f"{tmp_path}/none/conversations.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    for name, query in catalog.QUERIES.items():
        assert query(spark, f"{tmp_path}/none").count() == 0, name

