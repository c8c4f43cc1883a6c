"""Prompt-corpus checks as queries (Q1-Q4) and the corpus summary.

Each check returns the violating rows (empty means valid) instead of raising on the
first one, so a whole corpus is checked in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewatch import fixed_values as V
from namewatch.functions.text import ustrip

REQUIRED = ("id", "ecosystem", "domain", "specificity", "text")


def dq_prompts(corpus: DataFrame) -> DataFrame:
    """Q1-Q4: (file, id, check, detail) for every violation.

    Q1 a required field is missing; Q2 an id used by more than one entry (a hard error:
    results reference prompts by id); Q3 ecosystem or specificity outside its enum; Q4
    text that is blank after stripping. Per-entry checks are one pass (each entry yields
    the array of its violations, exploded once); the duplicate check is one aggregate."""

    def violation(cond, check: str, detail):
        v = F.struct(F.lit(check).alias("check"), detail.cast("string").alias("detail"))
        return F.when(cond, v)

    per_entry = [violation(F.col(f).isNull(), "missing_field", F.lit(f)) for f in REQUIRED]
    per_entry += [
        violation(F.col("ecosystem").isNotNull() & ~F.col("ecosystem").isin(*V.VALID_ECOSYSTEMS),
                  "bad_ecosystem", F.col("ecosystem")),
        violation(F.col("specificity").isNotNull()
                  & ~F.col("specificity").isin(*V.VALID_SPECIFICITY),
                  "bad_specificity", F.col("specificity")),
        violation(F.col("text").isNotNull() & (ustrip(F.col("text")) == ""),
                  "empty_text", F.lit("")),
    ]
    found = F.filter(F.array(*per_entry), lambda v: v.isNotNull())
    entries = corpus.select("file", "id", F.explode(found).alias("v")).select(
        "file", "id", "v.check", "v.detail")
    dup = corpus.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("file").alias("file"))
    dups = dup.filter(F.col("n") > 1).select(
        "file", "id", F.lit("duplicate_id").alias("check"),
        F.concat(F.col("n").cast("string"), F.lit(" entries")).alias("detail"))
    return entries.unionByName(dups)


def load_prompts(corpus: DataFrame, ecosystems: list[str] | None = None) -> DataFrame:
    """S3: entries in file-then-entry order with text stripped, optionally one or more
    ecosystems."""
    out = corpus.select("id", "ecosystem", "domain", "specificity",
                        ustrip(F.col("text")).alias("text"), "file", "ord")
    if ecosystems:
        out = out.filter(F.col("ecosystem").isin(*ecosystems))
    return out.orderBy("file", "ord")


def corpus_summary(prompts: DataFrame) -> DataFrame:
    """Counts by ecosystem and specificity, distinct domains, niche share."""
    eco = F.col("ecosystem")
    spec = F.col("specificity")
    return prompts.agg(
        F.count(F.lit(1)).alias("prompts"),
        F.count_if(eco == "python").alias("python"),
        F.count_if(eco == "javascript").alias("javascript"),
        F.count_if(spec == "vague").alias("vague"),
        F.count_if(spec == "detailed").alias("detailed"),
        F.count_if(spec == "niche").alias("niche"),
        F.count_distinct("domain").alias("domains"),
    ).select("*", F.try_divide(F.col("niche"), F.col("prompts")).alias("niche_share"))
