"""Stage 2 of extraction: units -> candidate names (C1-C12, routed by X7-X10).

All generators are evaluated in one projection: each returns an array of candidate
structs for its unit (empty when the routing rule does not apply), the arrays are
concatenated in rule order and exploded once. So the text is read once and there is
no union of per-rule scans. Duplicates are kept: an import and an install of one name
are two mentions.

Candidate columns: response_id, scope, declared, ecosystem, eco_ord, section, block_idx,
rule, match_idx, item_idx, raw, source, origin, is_import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch import fixed_values as V
from namewatch.functions import cached_column
from namewatch.functions import text as TX

CAND_TYPE = (
    "array<struct<ecosystem:string,rule:int,match_idx:int,item_idx:int,"
    "raw:string,source:string,is_import:boolean>>"
)

# Rule ordinals fix the order candidates are met within one unit.
PY_RULES = {"import": 0, "from": 1, "install": 2, "requirements": 3}
JS_RULES = {"require": 0, "import_from": 1, "import_bare": 2, "import_dynamic": 3,
            "export_from": 4, "install": 5, "manifest": 6}


def _cand(eco: str, rule: int, mi: Column, ii: Column, raw: Column, source: str,
          is_import: bool) -> Column:
    return F.struct(
        F.lit(eco).alias("ecosystem"),
        F.lit(rule).alias("rule"),
        mi.cast("int").alias("match_idx"),
        ii.cast("int").alias("item_idx"),
        raw.alias("raw"),
        F.lit(source).alias("source"),
        F.lit(is_import).alias("is_import"),
    )


def _empty() -> Column:
    return F.array().cast(CAND_TYPE)


def import_targets(clause: Column) -> Column:
    """Split an import clause on commas, strip, cut at `` as ``, drop empties."""
    return F.filter(
        F.transform(
            F.split(clause, ","),
            lambda p: TX.ustrip(F.element_at(F.split(TX.ustrip(p), V.PY_AS_SPLIT), 1)),
        ),
        lambda x: x != "",
    )


def py_import_cands(body: Column) -> Column:
    """C1 + C2: ``import a, b as c``."""
    clauses = F.regexp_extract_all(body, TX.lit_re(V.PY_IMPORT), F.lit(1))
    return F.flatten(
        F.transform(
            clauses,
            lambda c, mi: F.transform(
                import_targets(c),
                lambda t, ii: _cand("python", PY_RULES["import"], mi, ii, t, "import", True),
            ),
        )
    )


def py_from_cands(body: Column) -> Column:
    """``from X import`` with leading dots kept."""
    mods = F.regexp_extract_all(body, TX.lit_re(V.PY_FROM), F.lit(1))
    return F.transform(
        mods, lambda m, mi: _cand("python", PY_RULES["from"], mi, F.lit(0), m, "import", True)
    )


def _install_cands(eco: str, rule: int, pattern: str, body: Column, prose: Column) -> Column:
    args = F.regexp_extract_all(body, TX.lit_re(pattern), F.lit(1))
    return F.flatten(
        F.transform(
            args,
            lambda a, mi: F.transform(
                TX.install_tokens(a, prose),
                lambda t, ii: _cand(eco, rule, mi, ii, t, "install", False),
            ),
        )
    )


def py_install_cands(body: Column, prose: Column) -> Column:
    """C4 + K1: pip / uv / poetry / pipenv / conda install arguments."""
    return _install_cands("python", PY_RULES["install"], V.PY_INSTALL, body, prose)


def js_install_cands(body: Column, prose: Column) -> Column:
    """C11 + K1: npm / yarn / pnpm / bun install arguments."""
    return _install_cands("javascript", JS_RULES["install"], V.JS_INSTALL, body, prose)


_LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def requirement_lines(body: Column) -> Column:
    """The leading name (with extras) of each requirements line that is not blank,
    a comment or an option."""
    lines = F.split(body, _LINE_BREAKS, -1)
    kept = F.filter(
        lines,
        lambda ln: (TX.ustrip(ln) != "")
        & ~TX.ustrip(ln).startswith("#")
        & ~TX.ustrip(ln).startswith("-"),
    )
    return F.filter(
        F.transform(kept, lambda ln: F.regexp_extract(ln, V.REQ_LINE, 1)), lambda x: x != ""
    )


def py_requirement_cands(body: Column) -> Column:
    """C5 + K1: names from a requirements block (source 'manifest')."""
    return F.flatten(
        F.transform(
            requirement_lines(body),
            lambda ln, mi: F.transform(
                TX.install_tokens(ln, F.lit(False)),
                lambda t, ii: _cand("python", PY_RULES["requirements"], mi, ii, t,
                                    "manifest", False),
            ),
        )
    )


def _js_import_cand(rule: int):
    return lambda s, mi: _cand("javascript", rule, mi, F.lit(0), s, "import", True)


def js_code_cands(body: Column) -> Column:
    """Require, import-from, side-effect import, dynamic import, export-from."""
    parts = []
    for key, pattern in (
        ("require", V.JS_REQUIRE),
        ("import_from", V.JS_IMPORT_FROM),
        ("import_bare", V.JS_IMPORT_BARE),
        ("import_dynamic", V.JS_IMPORT_DYNAMIC),
        ("export_from", V.JS_EXPORT_FROM),
    ):
        specs = F.regexp_extract_all(body, TX.lit_re(pattern), F.lit(1))
        parts.append(F.transform(specs, _js_import_cand(JS_RULES[key])))
    return F.concat(*parts)


# JSON text as tokens: string literals whole, stand-alone non-finite literals (which
# Python's json module accepts and Spark's parser does not), other runs, any character.
# Possessive, so that a long literal is matched without recursion; a literal without an end is
# one token too (the text is no JSON then), so that it is not tried again from inside.
_JSON_TOKENS = (r'(?s)"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?+'
                r"|(?<![\w.+-])(?:-?Infinity|NaN)(?![\w.])"
                r'|[^"NI-]+|.')
_NON_FINITE = ("NaN", "Infinity", "-Infinity")


def json_finite(body: Column) -> Column:
    """The body with stand-alone NaN / Infinity / -Infinity values replaced by 0, so a
    manifest Python would parse also parses here (values are never read, only keys and
    whether a value is an object)."""
    tokens = F.regexp_extract_all(body, F.lit(_JSON_TOKENS), F.lit(0))
    return F.array_join(
        F.transform(tokens, lambda t: F.when(t.isin(*_NON_FINITE), F.lit("0")).otherwise(t)), "")


def _equals(value: str):
    return lambda t: t == value


def manifest_dependency_names(body: Column) -> Column:
    """Keys of the dependency objects of a package.json-shaped block, as
    array<struct<k:int, names:array<string>>>. The block must be exactly one JSON value
    (wrapped in [...] so trailing text or a second value fails), whose top level is an
    object; non-object dependency values and malformed JSON give nothing."""
    body = json_finite(body)
    v = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    single = F.size(F.try_variant_get(v, "$", "array<variant>")) == 1
    no_names = F.array().cast("array<string>")
    out = []
    top_keys = F.coalesce(F.json_object_keys(body), no_names)
    for k, key in enumerate(V.DEP_KEYS):
        # The variant holds the value Python's dict keeps (the last of duplicate keys) and
        # says whether it is an object. Its keys are read from the object's text so they
        # keep document order; only when the section itself is duplicated (the text path
        # would find the first one) are they taken from the variant (sorted).
        as_map = F.try_variant_get(v, f"$[0].{key}", "map<string,variant>")
        in_order = F.array_distinct(F.json_object_keys(F.get_json_object(body, f"$.{key}")))
        repeated = F.size(F.filter(top_keys, _equals(key))) > 1
        keys = F.when(repeated, F.map_keys(as_map)).otherwise(in_order)
        names = F.when(as_map.isNotNull(), F.coalesce(keys, no_names)).otherwise(no_names)
        out.append(F.struct(F.lit(k).alias("k"), names.alias("names")))
    return F.when(single, F.array(*out)).otherwise(
        F.array().cast("array<struct<k:int,names:array<string>>>")
    )


def js_manifest_cands(body: Column) -> Column:
    """C12 as candidates (source 'manifest')."""
    return F.flatten(
        F.transform(
            manifest_dependency_names(body),
            lambda d: F.transform(
                d["names"],
                lambda n, ii: _cand("javascript", JS_RULES["manifest"], d["k"], ii, n,
                                    "manifest", False),
            ),
        )
    )


def candidates(units: DataFrame) -> DataFrame:
    """X7-X10 routing + C1-C12 generation, one explode per unit."""
    cands = cached_column("candidate_array", lambda: unit_candidates(
        F.col("kind"), F.col("body"), F.col("scope"), F.col("section") == 1))
    exploded = units.select(
        "response_id", "scope", "declared", "section", "block_idx",
        F.explode(cands).alias("c"),
    )
    return exploded.select(
        "response_id",
        "scope",
        "declared",
        F.col("c.ecosystem").alias("ecosystem"),
        F.when(F.col("c.ecosystem") == "python", 0).otherwise(1).alias("eco_ord"),
        "section",
        "block_idx",
        F.col("c.rule").alias("rule"),
        F.col("c.match_idx").alias("match_idx"),
        F.col("c.item_idx").alias("item_idx"),
        F.col("c.raw").alias("raw"),
        F.col("c.source").alias("source"),
        F.when(F.col("section") == 1, "prose").otherwise("code_block").alias("origin"),
        F.col("c.is_import").alias("is_import"),
    )


def unit_candidates(kind: Column, body: Column, scope: Column, prose: Column) -> Column:
    """All routed generators of one unit, concatenated in rule order."""
    want_py = scope.isNull() | (scope == "python")
    want_js = scope.isNull() | (scope == "javascript")
    text_gate = body.rlike(V.TEXT_REQ_GATE)

    def routed(cond: Column, gen: Column) -> Column:
        return F.when(cond, gen).otherwise(_empty())

    cands = F.concat(
        routed(want_py & (kind == "python"), py_import_cands(body)),
        routed(want_py & (kind == "python"), py_from_cands(body)),
        routed(want_py & kind.isin("python", "shell", "prose"), py_install_cands(body, prose)),
        routed(want_py & ((kind == "requirements") | ((kind == "text") & text_gate)),
               py_requirement_cands(body)),
        routed(want_js & (kind == "javascript"), js_code_cands(body)),
        routed(want_js & kind.isin("javascript", "shell", "prose"),
               js_install_cands(body, prose)),
        routed(want_js & (kind == "json"), js_manifest_cands(body)),
    )
    return cands
