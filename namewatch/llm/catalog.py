"""Registered queries of the corpus operators: each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namewatch.llm import (
    decontaminate,
    langid,
    mixing,
    pii,
    quality,
    secrets,
    sharding,
    simhash,
    spelling,
    substring,
    suffixes,
    toxicity,
    trie,
)
from namewatch.llm.common import materialise, ship
from namewatch.session import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _is(condition: Column) -> Column:
    """The condition, false where it is null (a document without an id)."""
    return F.coalesce(condition, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    return toxicity.score(docs, model).select(
        "doc_id", _is(toxicity.fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                       _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = _is(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    model = langid.train(docs.where(~held))
    return langid.predict(docs, model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(
        substring.dedup(_table(spark, sf_dir, "documents", "doc_id", "text")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{checkpoint_dir(spark)}/namewatch-llm/secret-ledger-{uuid.uuid4().hex}"
    return secrets.gathered(secrets.digest(secrets.scan_stored(
        _table(spark, sf_dir, "documents", "doc_id", "text"), ledger)))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents", "doc_id", "text")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.quality(docs, ratios_from(docs, labels))


def ratios_from(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket ratios with the documents of quality 1 as target."""
    texts = docs.select("doc_id", "text")
    return materialise(quality.bucket_ratios(texts, quality.target_documents(texts, labels)),
                       "quality-ratios")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup(_table(spark, sf_dir, "documents", "doc_id", "text")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(trie.nodes(
        _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def _ready(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _ready(f) for f in (
        op1_toxicity, op2_decontamination, op3_language_id, op4_substring_dedup,
        op5_secret_scan, op6_pii, op7_simhash, op8_quality, op9_mixing, op10_sharding, op11_suffix_dedup,
        op12_spelling, op13_prefix_trie)}
