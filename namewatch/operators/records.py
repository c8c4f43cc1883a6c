"""Run records: assembly from model calls, and re-extraction of stored ones.

Both run the extraction over the responses of successful calls and fold its mentions into the
record as ``packages`` (first-seen order) and ``extraction_notes``, inside the record's row.
A record's key is any column that tells records apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewatch import fixed_values as V
from namewatch import schemas
from namewatch.operators import extract as X

SCHEMA_VERSION = 1
_NO_PACKAGES = f"array<{schemas.PACKAGE.simpleString()}>"


def reextract(records: DataFrame, vocab: X.Vocabulary, key: str = "response_id") -> DataFrame:
    """``records`` with ``packages`` and ``extraction_notes`` rewritten from the stored
    text. Failed records, and successful ones without a text, pass through untouched.

    Everything happens inside the row. Only a vocabulary too large for an expression is
    joined; then the mentions (not the texts) are gathered by ``key`` and joined back.
    """
    again = F.coalesce(F.col("ok") & (F.col("response_text") != ""), F.lit(False))
    text, found = "nw_text", "nw_found"
    known = vocab.inline()
    if known is not None:
        out = X.with_found(records.withColumn(text, F.when(again, F.col("response_text"))),
                           known, text, "ecosystem", found)
        packages, prose = X.packages_of(F.col(found)), X.has_prose(F.col(found))
    else:
        mentions = X.mentions_of(X.extract_resolved(records.filter(again).select(
            F.col(key).alias("response_id"), "ecosystem", "response_text"), vocab))
        gathered = X.packages_per_response(mentions).select(
            F.col("response_id").alias(key), F.col("packages").alias(found))
        out = records.join(gathered, key, "left")
        packages = F.coalesce(found, F.array().cast(_NO_PACKAGES))
        prose = F.exists(packages, lambda p: p["origin"] == "prose")
    notes = F.when(prose, F.array(F.lit(V.PROSE_NOTE))).otherwise(
        F.array().cast("array<string>"))
    return out.withColumns({
        "packages": F.when(again, packages).otherwise(F.col("packages")),
        "extraction_notes": F.when(again, notes).otherwise(F.col("extraction_notes")),
    }).select(*records.columns)


# ------------------------------------------------------------------ after a vocabulary change
def vocabulary_index(records: DataFrame, key: str = "response_id") -> DataFrame:
    """``(language, word, key)``: the words that the extraction of each record looks up in a
    vocabulary, whatever the vocabulary holds. Stored next to the records, it tells which of
    them a change of the vocabulary can concern."""
    texts = records.filter(F.col("ok") & (F.col("response_text") != "")).select(
        F.col(key).alias("response_id"), "ecosystem", "response_text")
    return X.looked_up(texts).select(
        "language", "word", F.col("response_id").alias(key)).distinct()


def changed_words(old: X.Vocabulary, new: X.Vocabulary) -> DataFrame:
    """``(language, word)`` that the two vocabularies answer differently."""
    names = lambda v: v.module_names.select(
        F.col("language"), F.col("name").alias("word"), F.lit("").alias("answer"))
    aliases = lambda v: v.aliases.select(
        F.lit("python").alias("language"), F.col("import_name").alias("word"),
        F.concat(F.lit("="), "dist_name").alias("answer"))
    both = [names(v).unionByName(aliases(v)).distinct().withColumn("of", F.lit(i))
            for i, v in enumerate((old, new))]
    return both[0].unionByName(both[1]).groupBy("language", "word", "answer").agg(
        F.count(F.lit(1)).alias("n")).filter("n = 1").select("language", "word").distinct()


def touched_records(index: DataFrame, old: X.Vocabulary, new: X.Vocabulary,
                    key: str = "response_id") -> DataFrame:
    """``(key)`` of the records that hold a word which ``new`` answers differently."""
    return index.join(changed_words(old, new), ["language", "word"], "left_semi").select(
        key).distinct()


def reextract_touched(records: DataFrame, index: DataFrame, old: X.Vocabulary,
                      new: X.Vocabulary, key: str = "response_id") -> DataFrame:
    """S8 after a change of the vocabulary: ``(key, packages, extraction_notes)`` of the records
    it can concern, extracted with ``new``; all others have what they had. ``index`` is
    :func:`vocabulary_index` of the records, made once."""
    touched = records.join(touched_records(index, old, new, key), key, "left_semi")
    return reextract(touched.select(*records.columns), new, key).select(
        key, "packages", "extraction_notes")


def with_changes(results: DataFrame, changes: DataFrame, key: str = "response_id") -> DataFrame:
    """Results ``(key, packages, extraction_notes)`` with the changed ones in place of theirs;
    no text is needed."""
    columns = [key, "packages", "extraction_notes"]
    return results.select(*columns).join(changes.select(key), key, "left_anti").unionByName(
        changes.select(*columns))


def build_records(calls: DataFrame, prompts: DataFrame, models: DataFrame, vocab: X.Vocabulary,
                  key: str = "response_id") -> DataFrame:
    """The full record of each model call: cell, outcome, packages, notes and text, in the
    order of the record schema after ``key``.

    Prompt and model attributes come from their tables (NULL where the corpus no longer has
    them). Failed calls and empty responses have no packages and no notes.
    """
    p = prompts.select(F.col("id").alias("prompt_id"), "ecosystem", "domain", "specificity")
    m = models.select(F.col("id").alias("model_id"), F.col("model").alias("model_alias"))
    cells = calls.join(p, "prompt_id", "left").join(m, "model_id", "left").withColumns({
        "schema_version": F.lit(SCHEMA_VERSION),
        "latency_s": F.round("latency_s", 3),
        "packages": F.array().cast(_NO_PACKAGES),
        "extraction_notes": F.array().cast("array<string>"),
    })
    return reextract(cells.select(key, *schemas.RUNS.names), vocab, key)


def reextraction_diff(before: DataFrame, after: DataFrame, key: str = "response_id") -> DataFrame:
    """Records, how many changed their packages, and packages before and after (of the
    records that were extracted again)."""
    # digests and sizes move, not packages and texts
    of = lambda name: F.struct(F.md5(F.to_json("packages").cast("binary")).alias("id"),
                               F.size("packages").alias("size")).alias(name)
    pairs = before.select(key, (F.col("ok") & (F.col("response_text") != "")).alias("again"),
                          of("old")).join(after.select(key, of("new")), key)
    again = F.col("again")
    return pairs.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(again & ~F.col("old.id").eqNullSafe(F.col("new.id"))).alias("changed"),
        F.sum(F.when(again, F.col("old.size")).otherwise(0)).alias("packages_before"),
        F.sum(F.when(again, F.col("new.size")).otherwise(0)).alias("packages_after"),
    )
