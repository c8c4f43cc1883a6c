"""Recurrence that merges: run indexes as bits, so parts are added up without reading old mentions.

A part (a batch, a backfill, a micro-batch) is two small tables: the run indexes that each
(model, prompt, ecosystem, name) appeared in, and those of each (model, prompt) cell, as 64-bit
words (``word`` = index / 64, one bit per index). Merging ORs the words, which may be done in any
order and any number of times: a run that is in two parts counts once. Appearances are counted
bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch.operators import report as R

NAME_KEY = [*R.CELL, "ecosystem", "name"]
_WORD_BITS = 64


def _bit(index: Column) -> Column:
    """The index's bit in its word; none for a null index."""
    place = F.pmod(index, F.lit(_WORD_BITS)).cast("int")
    return F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), place),
                      F.lit(0).cast("long"))


def _word(index: Column) -> Column:
    return F.coalesce(F.floor(index / _WORD_BITS), F.lit(0)).cast("long")


def mention_bits(mentions: DataFrame) -> DataFrame:
    """``(model_id, prompt_id, ecosystem, name, word, bits, unmapped)`` of mentions of ok runs,
    whatever their status: the registry is looked at when the table is read."""
    i = F.col("run_index")
    return mentions.groupBy(*NAME_KEY, _word(i).alias("word")).agg(
        F.bit_or(_bit(i)).alias("bits"),
        F.bool_or(F.col("alias_resolved").eqNullSafe(False)).alias("unmapped"))


def cell_bits(runs: DataFrame) -> DataFrame:
    """``(model_id, prompt_id, word, bits)`` of the ok runs."""
    i = F.col("run_index")
    return R.ok_runs(runs).groupBy(*R.CELL, _word(i).alias("word")).agg(
        F.bit_or(_bit(i)).alias("bits"))


def merged_mentions(parts: DataFrame) -> DataFrame:
    """Rows of any number of parts as one table of the same form."""
    return parts.groupBy(*NAME_KEY, "word").agg(
        F.bit_or("bits").alias("bits"), F.bool_or("unmapped").alias("unmapped"))


def merged_cells(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*R.CELL, "word").agg(F.bit_or("bits").alias("bits"))


def recurrence_of_bits(mentions: DataFrame, cells: DataFrame, registry: DataFrame,
                       ordered: bool = False) -> DataFrame:
    """A10 from bits (merged or not): same rows as ``report.recurrence``."""
    not_found = registry.filter(F.col("status") == "not_found").select("ecosystem", "name")
    names = merged_mentions(mentions).join(not_found, ["ecosystem", "name"], "left_semi") \
        .groupBy(*NAME_KEY).agg(F.sum(F.bit_count("bits")).cast("long").alias("appearances"),
                                F.bool_or("unmapped").alias("any_unmapped"))
    sizes = merged_cells(cells).groupBy(*R.CELL).agg(
        F.sum(F.bit_count("bits")).cast("long").alias("runs"))
    return R.recurrence_rows(names.join(sizes, R.CELL), ordered)
