"""Quality rules: text statistics and a hashed n-gram likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials are
counted over whole texts: the trusted target (documents marked good) and the raw corpus (all
documents). A document's score is the mean, over its n-grams, of the log ratio of the two
bucket probabilities; one fixed threshold decides every document.

No text takes part in the counts that score it: texts fall into ``FOLDS`` folds by their hash
(copies into the same one), both multinomials are counted without each fold in turn, and a
text is scored by the ratios that leave its fold out.

A bucket's ratio is shrunk towards zero by its counts: the target's observed n-grams over
those that the corpus's share lets expect, with ``PRIOR`` n-grams added to both. So a small
target or a rare bucket says little.

Built-in functions only: n-grams are made and counted inside the JVM with partial
aggregation. Broadcast are the table of bucket ratios (``BUCKETS`` rows at most) and the bits
that pick the target's documents (``_FILTER_BITS``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch.llm.common import fresh, let, materialise, text_of, words_of

BUCKETS = 1 << 14
SMOOTHING = 0.5         # n-grams that the corpus is given in each bucket
PRIOR = 5.0             # n-grams, expected and observed alike, that the target is given there
FOLDS = 5
# Bits by hashed id that tell which documents may be in the target: 262,144 words at most are
# broadcast. Other documents that share a bit are taken out by an exact join.
_FILTER_BITS = 1 << 24
# Mean log ratio below which a document is rejected. Ordinary prose scores near zero (above
# -0.11 for every good document of the test tables, its fold left out); text of n-grams that
# the target hardly has scores below -0.2.
THRESHOLD = -0.15
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
_WINDOW = 5
_LONG = "bigint"


def _repeated_words(hashes: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, from the words' hashes.

    Only a text with a repeated window pays for finding the positions: windows are sorted
    with their positions, equal neighbours give the repeated positions, and each position
    adds the words up to the next one.
    """
    n = F.size(hashes)
    windows = F.when(n < _WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - _WINDOW + 1, F.lit(1))),
                    lambda i: F.xxhash64(*(F.element_at(hashes, i + k)
                                           for k in range(_WINDOW)))))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (
                (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"])))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(
                p, F.struct(F.lit(0).cast("int").alias("sum"),
                            F.lit(-_WINDOW).cast("int").alias("last")),
                lambda acc, x: F.struct(
                    (acc["sum"] + F.least(F.lit(_WINDOW), x - acc["last"])).alias("sum"),
                    x.alias("last")),
                lambda acc: acc["sum"])

        return let(pairs, lambda s: let(positions(s), total))

    return let(windows, lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the
    words' hashes in ``word_hashes`` (each name after ``prefix``). A null text has no words."""
    text = text_of(text_col)
    words, hashes = f"{prefix}words", f"{prefix}word_hashes"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({
        words: words_of(text_col),
        f"{prefix}n_symbols": F.length(
            F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast(_LONG),
        f"{prefix}n_dup_lines": let(
            lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast(_LONG),
    })
    out = out.withColumns({
        f"{prefix}n_words": F.size(words).cast(_LONG),
        f"{prefix}word_chars": F.length(F.array_join(words, "")).cast(_LONG),
        hashes: F.transform(words, lambda w: F.xxhash64(w)),
    }).drop(words)
    return out.withColumn(f"{prefix}n_repeat_words",
                          let(F.col(hashes), _repeated_words).cast(_LONG))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * MAX_REPEAT_PERCENT)


def _ngrams(rows: DataFrame, hashes: str, *keep: str) -> DataFrame:
    """One row for each word of ``rows``: the buckets of the word (``b1``) and of the bigram
    that it starts (``b2``, null for the last word). A text without words gives one row of
    nulls."""
    shifted = F.slice(hashes, F.lit(2), F.greatest(F.size(hashes), F.lit(0)))
    pairs = F.arrays_zip(F.col(hashes).alias("x"), shifted.alias("y"))
    flat = rows.select(*keep, F.inline_outer(pairs).alias("x", "y"))
    return flat.select(
        *keep, F.pmod("x", F.lit(BUCKETS)).cast("int").alias("b1"),
        F.when(F.col("y").isNotNull(),
               F.pmod(F.xxhash64("x", "y"), F.lit(BUCKETS)).cast("int")).alias("b2"))


def _fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def _bucket_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """``(bucket, fold, n)``: n-grams of the texts of a fold in a bucket."""
    hashes = texts.select(_fold(text_of(text_col)).alias("fold"), F.transform(
        words_of(text_col), lambda w: F.xxhash64(w)).alias("h"))
    grams = _ngrams(hashes, "h", "fold").select("fold", F.explode(F.array("b1", "b2")).alias(
        "bucket")).where("bucket IS NOT NULL")
    return grams.groupBy("bucket", "fold").agg(F.count(F.lit(1)).alias("n"))


def bucket_ratios(corpus: DataFrame, target: DataFrame, text_col: str = "text") -> DataFrame:
    """``(bucket, ratios)``: for each fold, the log of the target's over the corpus's share of
    the bucket, both counted without the fold.

    Every n-gram of every row counts; ``BUCKETS`` rows. Where the target has no n-gram outside
    a fold, that fold's ratios are zero.
    """
    both = _bucket_counts(corpus, text_col).select("bucket", "fold", F.col("n").alias("raw"),
                                                   F.lit(0).cast(_LONG).alias("good"))
    both = both.unionByName(_bucket_counts(target, text_col).select(
        "bucket", "fold", F.lit(0).cast(_LONG).alias("raw"), F.col("n").alias("good")))
    names = [f"{c}{f}" for f in range(FOLDS) for c in ("raw", "good")]
    sums = both.groupBy("bucket").agg(*(
        F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
        for f in range(FOLDS) for c in ("raw", "good")))
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    # written, as the sums over all buckets read it twice
    counts = materialise(every.join(sums, "bucket", "left").na.fill(0, names), "quality-counts")
    totals = counts.agg(*(F.sum(n).alias(f"all_{n}") for n in names))
    # one row of totals beside BUCKETS rows
    shares = counts.join(F.broadcast(totals))
    for f in range(FOLDS):
        p = (F.col(f"raw{f}") + SMOOTHING) / (F.col(f"all_raw{f}") + SMOOTHING * BUCKETS)
        shares = shares.withColumn(f"p{f}", p).withColumn(
            f"lift{f}", (F.col(f"good{f}") + PRIOR) / (F.col(f"all_good{f}") * p + PRIOR))
    # the shrunk target adds up to this, not quite to one
    norms = shares.agg(*(F.sum(F.col(f"p{f}") * F.col(f"lift{f}")).alias(f"norm{f}")
                         for f in range(FOLDS)))
    return shares.join(F.broadcast(norms)).select("bucket", F.array(*(
        F.when(F.col(f"all_good{f}") > 0, F.log(F.col(f"lift{f}") / F.col(f"norm{f}")))
        .otherwise(0.0) for f in range(FOLDS))).alias("ratios"))


def target_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document has some label of quality 1.

    Only documents whose hashed id has its bit set are exchanged for the exact join, so other
    texts stay where they are. Null ids are in no target; repeated labels count once, repeated
    rows each.
    """
    good, word, bits, at = fresh(docs.columns, "nw_good", "nw_word", "nw_bits", "nw_at")
    place = lambda c: F.pmod(
        F.xxhash64(F.col(c).cast("string")), F.lit(_FILTER_BITS))
    marked = labels.where(F.col("quality") == 1).where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias(good))
    at_bit = lambda name, *cols: F.call_function(name, *cols)
    words = marked.select(place(good).alias(at)).groupBy(
        F.shiftright(at, 6).alias(word)).agg(F.bit_or(at_bit(
            "shiftleft", F.lit(1).cast(_LONG), F.col(at).bitwiseAND(63).cast("int"))).alias(bits))
    near = docs.where(F.col(id_col).isNotNull()).withColumn(at, place(id_col))
    # at most _FILTER_BITS / 64 rows
    near = near.join(F.broadcast(words), F.shiftright(at, 6) == F.col(word)).where(at_bit(
        "shiftright", F.col(bits), F.col(at).bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
    # labels grow with the documents: the same plan at every size, never a broadcast
    near = near.select(*docs.columns)
    # an inner join of distinct ids: a semi join would be moved below the bits
    marked = marked.distinct()
    return near.hint("merge").join(marked, near[id_col] == marked[good]).drop(good)


def quality(docs: DataFrame, ratios: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``(id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept)``.

    A text is scored by the ratios that leave its fold out. A null or empty text fails the
    base rules and has score zero. Repeated rows, null ids and equal texts are judged one by
    one, each alike.
    """
    rows = with_statistics(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
        F.col(text_col).alias("text"))).withColumn("fold", _fold(text_of("text"))).drop("text")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    grams = _ngrams(rows, "word_hashes", "rid", "id", "fold", *measures)
    one = ratios.select(F.col("bucket").alias("b1"), F.col("ratios").alias("r1"))
    two = ratios.select(F.col("bucket").alias("b2"), F.col("ratios").alias("r2"))
    # at most BUCKETS rows each
    scored = grams.join(F.broadcast(one), "b1", "left").join(F.broadcast(two), "b2", "left")
    sums = scored.groupBy("rid").agg(
        F.first("id").alias("id"), *(F.first(m).alias(m) for m in measures),
        F.sum(F.coalesce(F.get("r1", F.col("fold")), F.lit(0.0))
              + F.coalesce(F.get("r2", F.col("fold")), F.lit(0.0))).alias("total"))
    # n words make n unigrams and n - 1 bigrams
    score = F.when(F.col("n_words") > 0, F.col("total") / (F.col("n_words") * 2 - 1))
    out = sums.select(
        F.col("id").alias(id_col), *measures,
        base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"),
        F.coalesce(score, F.lit(0.0)).alias("score"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def drop_low_quality(docs: DataFrame, ratios: DataFrame, text_col: str = "text",
                     threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rejected documents (the judgement of :func:`quality`).

    The documents are written out with row numbers first, so that repeated rows and null ids
    each get their own verdict.
    """
    rid, = fresh(docs.columns, "nw_rid")
    rows = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "quality-docs")
    kept = quality(rows, ratios, rid, text_col, threshold).where("kept").select(rid)
    return rows.join(kept, rid, "left_semi").select(*docs.columns)
