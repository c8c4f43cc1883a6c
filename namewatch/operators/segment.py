"""Stage 1 of extraction: responses -> units (fenced blocks and the prose remainder).

One pass over each response text: the fences are found once (whole matches), the prose
remainder is the text split on the same pattern and re-joined with newlines, and the
tag and body of each block are read from its own (short) match. Nothing shuffles; the
text column is dropped as soon as the units exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch import fixed_values as V
from namewatch.functions import text as TX


def code_blocks(responses: DataFrame, text_col: str = "response_text") -> DataFrame:
    """X1 + X2 + X3: one row per fenced block: (response_id, block_idx, tag, lang, body),
    tag stripped and lower-cased, lang from the fixed map."""
    fences = responses.select(
        "response_id",
        F.regexp_extract_all(F.col(text_col), TX.lit_re(V.FENCE), F.lit(0)).alias("fences"),
    )
    return fences.select(
        "response_id", F.posexplode("fences").alias("block_idx", "fence")
    ).select(
        "response_id",
        F.col("block_idx").cast("int").alias("block_idx"),
        TX.normalise_tag(F.regexp_extract("fence", V.FENCE, 1)).alias("tag"),
        TX.block_lang(TX.normalise_tag(F.regexp_extract("fence", V.FENCE, 1))).alias("lang"),
        F.regexp_extract("fence", V.FENCE, 2).alias("body"),
    )


def units(
    responses: DataFrame,
    text_col: str = "response_text",
    scope_col: str | None = "ecosystem",
) -> DataFrame:
    """Responses -> one row per unit: every fenced block (section 0, in order) and the
    prose remainder (section 1). Carries the response's declared modules (X6) and the
    extraction scope (P6: one ecosystem, or NULL for both).

    Columns: response_id, scope, declared, section, block_idx, tag, kind, body, where
    kind is the content kind (X3, untagged blocks inferred by X5; NULL = skipped) and
    'prose' for the remainder.
    """
    step2 = sections(responses, text_col, scope_col, ["response_id"])
    step3 = step2.select("response_id", "scope", "declared", F.explode("sections").alias("u"))
    return step3.select(
        "response_id",
        "scope",
        "declared",
        F.col("u.section").alias("section"),
        F.col("u.block_idx").alias("block_idx"),
        TX.normalise_tag(F.col("u.tag")).alias("tag"),
        unit_kind(F.col("u")).alias("kind"),
        F.col("u.body").alias("body"),
    )


def unit_kind(u: Column) -> Column:
    """How a section's body is read: its content kind, or 'prose' for the remainder."""
    return F.when(u["section"] == 1, F.lit("prose")).otherwise(
        TX.effective_lang(u["tag"], u["body"]))


def sections(responses: DataFrame, text_col: str, scope_col: str | None,
              keep: list[str]) -> DataFrame:
    """``(keep, scope, declared, sections)``: every fenced block of a response, then its prose
    remainder, as structs (section, block_idx, tag, body) of one array."""
    text = F.col(text_col)
    scope = F.col(scope_col) if scope_col else F.lit(None).cast("string")
    step1 = responses.select(
        *keep,
        scope.alias("scope"),
        text.alias("text"),
        F.regexp_extract_all(text, TX.lit_re(V.FENCE), F.lit(0)).alias("fences"),
    )
    blocks = F.transform(
        "fences",
        lambda m, i: F.struct(
            F.lit(0).alias("section"),
            i.alias("block_idx"),
            F.regexp_extract(m, V.FENCE, 1).alias("tag"),
            F.regexp_extract(m, V.FENCE, 2).alias("body"),
        ),
    )
    step2 = step1.select(
        *keep,
        "scope",
        blocks.alias("blocks"),
        F.array_join(F.split(F.col("text"), V.FENCE, -1), "\n").alias("prose"),
        F.regexp_extract_all(F.col("text"), TX.lit_re(V.FILE_DECL), F.lit(1)).alias("decl"),
    )
    prose_unit = F.struct(
        F.lit(1).alias("section"),
        F.lit(0).alias("block_idx"),
        F.lit(None).cast("string").alias("tag"),
        F.col("prose").alias("body"),
    )
    declared = F.array_distinct(F.concat(
        TX.file_modules(F.col("decl")),
        TX.tag_modules(F.transform("blocks", lambda b: b["tag"])),
    ))
    return step2.select(*keep, "scope", declared.alias("declared"),
                        F.concat("blocks", F.array(prose_unit)).alias("sections"))


def declared_modules(responses: DataFrame, text_col: str = "response_text") -> DataFrame:
    """X6 as a table: (response_id, declared) with the sorted distinct module names."""
    text = F.col(text_col)
    return responses.select(
        "response_id",
        F.array_sort(TX.declared_modules(text, TX.fence_tags(text))).alias("declared"),
    )


def prose_remainder(responses: DataFrame, text_col: str = "response_text") -> DataFrame:
    """X4 as a table: (response_id, prose)."""
    return responses.select("response_id", TX.prose_text(F.col(text_col)).alias("prose"))


def untagged_inference(blocks: DataFrame) -> DataFrame:
    """X5 over the untagged blocks of ``code_blocks``: (response_id, block_idx, inferred)."""
    return blocks.filter(F.col("lang") == "untagged").select(
        "response_id", "block_idx", TX.infer_untagged(F.col("body")).alias("inferred")
    )
