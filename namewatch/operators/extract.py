"""Stage 3 of extraction: candidates -> mentions and the filtered audit.

As rows, vocabulary membership (standard library, Node built-ins, import aliases) is a left
join against dimension tables, broadcast or shuffled as their measured size demands, and the
declared-modules array travels with each candidate. What belongs to one response (its
packages, notes, audit) is worked out inside its row instead, with the vocabulary in the
expression: see ``with_found``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from namewatch import fixed_values as V
from namewatch import schemas
from namewatch.functions import text as TX
from namewatch.operators.candidates import candidates, unit_candidates
from namewatch.operators.segment import sections, unit_kind, units

POS = ["eco_ord", "section", "block_idx", "rule", "match_idx", "item_idx"]


# Entries of a vocabulary that go into an expression (set membership is hashed, an alias is
# looked up in a short map); larger ones are joined.
INLINE_WORDS = 5_000
INLINE_ALIASES = 1_000


@dataclass(frozen=True)
class Inline:
    """A vocabulary's entries as plain values."""

    python: frozenset[str]
    javascript: frozenset[str]
    aliases: dict[str, str]


@dataclass
class Vocabulary:
    """Dimension tables the extraction filters against. Keys are unique (``of`` sees to it)."""

    module_names: DataFrame  # (language, name): python stdlib and javascript built-ins
    aliases: DataFrame  # (import_name, dist_name)
    known: Inline | None = None  # the same entries, where they are at hand

    def inline(self) -> Inline | None:
        """The entries for use inside expressions, or None if there are more than
        ``INLINE_WORDS`` names or ``INLINE_ALIASES`` aliases (they then stay tables)."""
        if self.known is None:
            words = self.module_names.limit(INLINE_WORDS + 1).collect()
            pairs = self.aliases.limit(INLINE_ALIASES + 1).collect()
            if len(words) > INLINE_WORDS or len(pairs) > INLINE_ALIASES:
                return None
            of = lambda lang: frozenset(r["name"] for r in words if r["language"] == lang)
            self.known = Inline(of("python"), of("javascript"),
                                {r["import_name"]: r["dist_name"] for r in pairs})
        return self.known

    @classmethod
    def of(cls, python: DataFrame, javascript: DataFrame, aliases: DataFrame) -> Vocabulary:
        """From word lists ``(word)`` and an alias table, as the loaders return them."""
        names = python.select(F.lit("python").alias("language"), F.col("word").alias("name")) \
            .unionByName(javascript.select(F.lit("javascript").alias("language"),
                                           F.col("word").alias("name")))
        return cls(names.distinct(), aliases.select("import_name", "dist_name"))

    @classmethod
    def default(cls, spark: SparkSession) -> Vocabulary:
        """The fixed standard-library names, Node built-ins and import aliases."""
        return cls.small(spark, set(V.PYTHON_STDLIB), set(V.NODE_BUILTINS),
                         V.PYTHON_IMPORT_ALIASES)

    @classmethod
    def small(cls, spark: SparkSession, python: set[str], javascript: set[str],
              aliases: dict[str, str]) -> Vocabulary:
        mods = [("python", n) for n in sorted(python)] + [
            ("javascript", n) for n in sorted(javascript)
        ]
        known = Inline(frozenset(python), frozenset(javascript), dict(aliases))
        few = len(mods) <= INLINE_WORDS and len(aliases) <= INLINE_ALIASES
        return cls(_local(spark, mods, schemas.MODULE_NAMES),
                   _local(spark, list(aliases.items()), schemas.ALIASES), known if few else None)


def _local(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """Rows as a relation whose size the optimiser knows."""
    return spark.createDataFrame(pd.DataFrame(rows, columns=schema.names, dtype=object), schema)


def _keys(c: Column) -> Column:
    """The names a candidate is judged by: Python's top level, or JavaScript's package root
    and the root without ``node:``; NULL in the other language."""
    py = c["ecosystem"] == "python"
    root = F.when(~py, TX.js_package_root(c["raw"]))
    return F.struct(
        F.when(py, F.when(c["is_import"], TX.top_level(c["raw"])).otherwise(c["raw"]))
        .alias("py_raw"),
        root.alias("js_root"),
        F.when(root.startswith("node:"), F.substr(root, F.lit(6))).otherwise(root).alias("js_bare"))


def _judged(c: Column, k: Column, in_vocab: Column, dist: Column, declared: Column) -> dict:
    """Filter reason (NULL = kept), audit name and package fields.

    Python: relative (imports) -> malformed -> stdlib (any source; exact case; plus
    ``__future__``) -> declared (imports only); imports are aliased (true/false), other
    sources carry NULL. JavaScript: relative -> builtin (after dropping ``node:``, recorded
    with the prefix) -> malformed (on the bare name).
    """
    py, raw, is_import = c["ecosystem"] == "python", c["raw"], c["is_import"]
    p_raw, j_root, j_bare = k["py_raw"], k["js_root"], k["js_bare"]
    py_reason = (
        F.when(is_import & raw.startswith("."), "relative")
        .when(~TX.plausible_name(p_raw), "malformed")
        .when(in_vocab | (p_raw == "__future__"), "stdlib")
        .when(is_import & F.array_contains(declared, p_raw), "declared_in_response")
    )
    js_reason = (
        F.when(j_root.isNull(), "relative")
        .when(in_vocab, "builtin")
        .when(~TX.plausible_name(j_bare), "malformed")
    )
    return {
        "reason": F.when(py, py_reason).otherwise(js_reason),
        "audit_name": F.when(
            py, F.when(is_import & raw.startswith("."), raw).otherwise(p_raw)
        ).otherwise(F.when(in_vocab & j_root.isNotNull(), j_root).otherwise(raw)),
        "raw": F.when(py, p_raw).otherwise(raw),
        "name": F.when(py, TX.normalise_python(
            F.when(is_import, F.coalesce(dist, p_raw)).otherwise(p_raw)))
        .otherwise(TX.normalise_js(j_root)),
        "alias_resolved": F.when(py & is_import, dist.isNotNull()),
    }


def looked_up(responses: DataFrame, text_col: str = "response_text",
              scope_col: str | None = "ecosystem") -> DataFrame:
    """``(response_id, language, word)``: what extraction asks a vocabulary about, whatever
    the vocabulary holds; Python's import aliases go by the same word."""
    c = candidates(units(responses, text_col, scope_col))
    keys = _keys({n: F.col(n) for n in ("ecosystem", "raw", "is_import")})
    word = F.coalesce(F.col("k.py_raw"), F.col("k.js_bare"))
    return c.select("response_id", F.col("ecosystem").alias("language"), keys.alias("k")).select(
        "response_id", "language", word.alias("word")).filter(F.col("word").isNotNull())


def resolve(cands: DataFrame, vocab: Vocabulary) -> DataFrame:
    """K13-K17 as rows: vocabularies are joined, so they may have any size."""
    c = {n: F.col(n) for n in ("ecosystem", "raw", "is_import")}
    keyed = cands.withColumn("k", _keys(c))
    mods = vocab.module_names.select(
        F.col("language").alias("v_lang"), F.col("name").alias("v_name"))
    al = vocab.aliases.select(
        F.col("import_name").alias("a_import"), F.col("dist_name").alias("a_dist"))
    py = F.col("ecosystem") == "python"
    key = F.when(py, F.col("k.py_raw")).otherwise(F.col("k.js_bare"))
    joined = keyed.withColumn("vocab_key", key).join(
        mods, (F.col("v_lang") == F.col("ecosystem")) & (F.col("v_name") == F.col("vocab_key")),
        "left",
    ).join(al, py & F.col("is_import") & (F.col("a_import") == F.col("k.py_raw")), "left")
    judged = _judged(c, F.col("k"), F.col("v_name").isNotNull(), F.col("a_dist"),
                     F.col("declared"))
    return joined.select("response_id", *POS, "ecosystem", "source", "origin",
                         *(v.alias(n) for n, v in judged.items()))


# ------------------------------------------------------------------ inside the row
_FOUND = ("array<struct<ecosystem:string,source:string,origin:string,reason:string,"
          "audit_name:string,raw:string,name:string,alias_resolved:boolean>>")
REASONS = ("relative", "malformed", "stdlib", "declared_in_response", "builtin")


def _found(sections: Column, scope: Column, declared: Column, known: Inline) -> Column:
    """Every candidate of a response with its reason, in first-seen order (Python's before
    JavaScript's, then by place), as one array."""
    aliases = F.create_map(*(F.lit(x) for kv in sorted(known.aliases.items()) for x in kv)) \
        if known.aliases else F.lit(None).cast("map<string,string>")

    def member(key: Column, names: frozenset[str]) -> Column:
        return F.coalesce(key.isin(*sorted(names)), F.lit(False)) if names else F.lit(False)

    def judge(u: Column):
        origin = F.when(u["section"] == 1, "prose").otherwise("code_block")

        def one(c: Column) -> Column:
            py = c["ecosystem"] == "python"

            def with_keys(k: Column) -> Column:
                looked = F.struct(
                    F.when(py, member(k["py_raw"], known.python)).otherwise(
                        member(k["js_bare"], known.javascript)).alias("in_vocab"),
                    F.when(py & c["is_import"], F.element_at(aliases, k["py_raw"])).alias("dist"))
                return TX.let(looked, lambda v: F.struct(
                    c["ecosystem"].alias("ecosystem"), c["source"].alias("source"),
                    origin.alias("origin"),
                    *(x.alias(n) for n, x in
                      _judged(c, k, v["in_vocab"], v["dist"], declared).items())))

            return TX.let(_keys(c), with_keys)

        return one

    # each section's kind is worked out once
    units = F.transform(sections, lambda u: F.struct(
        u["section"].alias("section"), u["body"].alias("body"), unit_kind(u).alias("kind")))
    every = F.flatten(F.transform(units, lambda u: F.transform(
        unit_candidates(u["kind"], u["body"], scope, u["section"] == 1), judge(u))))
    return TX.let(every, lambda found: F.concat(
        F.filter(found, lambda c: c["ecosystem"] == "python"),
        F.filter(found, lambda c: c["ecosystem"] == "javascript")))


def with_found(rows: DataFrame, vocab: Inline, text_col: str = "response_text",
               scope_col: str | None = "ecosystem", out: str = "found") -> DataFrame:
    """``rows`` with everything found in the row's text as an array ``out`` (empty for a null
    text). One projection: nothing is exchanged and no text leaves its row."""
    keep = rows.columns
    row = rows.select(F.struct(*map(_quoted, keep)).alias("kept"),
                      *filter(None, (scope_col, text_col)))
    cut = sections(row, text_col, scope_col, ["kept"])
    found = cut.select("kept", _found(F.col("sections"), F.col("scope"), F.col("declared"), vocab)
                       .cast(_FOUND).alias("found"))
    return found.select(*(F.col("kept")[c].alias(c) for c in keep),
                        F.coalesce("found", F.array().cast(_FOUND)).alias(out))


def _quoted(name: str) -> str:
    return f"`{name}`"


def packages_of(found: Column) -> Column:
    """The mentions of a response as package structs, in first-seen order."""
    return F.transform(F.filter(found, lambda c: c["reason"].isNull()), lambda c: F.struct(
        *(c[n].alias(n) for n in ("raw", "name", "ecosystem", "source", "origin",
                                  "alias_resolved"))))


def has_prose(found: Column) -> Column:
    return F.exists(found, lambda c: c["reason"].isNull() & (c["origin"] == "prose"))


def audit_of(found: Column) -> Column:
    """K18 in the row: ``(reason, name, seen_order)``, the distinct filtered names of each
    reason in first-seen order."""
    end = F.lit("\0")     # in no reason
    keys = F.array_distinct(F.transform(
        F.filter(found, lambda c: c["reason"].isNotNull()),
        lambda c: F.concat(c["reason"], end, c["audit_name"])))

    def of_reason(ks: Column, reason: str) -> Column:
        return F.transform(
            F.filter(ks, lambda k: k.startswith(reason + "\0")),
            lambda k, i: F.struct(F.lit(reason).alias("reason"),
                                  F.substr(k, F.lit(len(reason) + 2)).alias("name"),
                                  (i + 1).alias("seen_order")))

    return TX.let(keys, lambda ks: F.flatten(F.array(*(of_reason(ks, r) for r in REASONS))))


def audit_rows(responses: DataFrame, vocab: Vocabulary, text_col: str = "response_text",
               scope_col: str | None = "ecosystem") -> DataFrame:
    """``(response_id, reason, name, seen_order)``. Worked out inside each row; only a
    vocabulary too large for that is joined, and then names meet by an exchange."""
    known = vocab.inline()
    if known is not None:
        slim = responses.select("response_id", *filter(None, (scope_col, text_col)))
        return with_found(slim, known, text_col, scope_col).select(
            "response_id", F.explode(audit_of(F.col("found"))).alias("a")).select(
            "response_id", "a.*")
    audit = filtered_audit(extract_resolved(responses, vocab, text_col, scope_col))
    order = Window.partitionBy("response_id", "reason").orderBy("pos")
    return audit.select("response_id", "reason", "name",
                        F.row_number().over(order).alias("seen_order"))


def note_rows(responses: DataFrame, vocab: Vocabulary, text_col: str = "response_text",
              scope_col: str | None = "ecosystem") -> DataFrame:
    """``(response_id, note)`` of the responses with a mention from prose."""
    known = vocab.inline()
    if known is None:
        return prose_note(mentions_of(extract_resolved(responses, vocab, text_col, scope_col)))
    slim = responses.select("response_id", *filter(None, (scope_col, text_col)))
    return with_found(slim, known, text_col, scope_col).filter(has_prose(F.col("found"))).select(
        "response_id", F.lit(V.PROSE_NOTE).alias("note"))


def name_rows(responses: DataFrame, vocab: Vocabulary, text_col: str = "response_text",
              scope_col: str | None = "ecosystem") -> DataFrame:
    """``(response_id, names)`` of the responses with a mention."""
    known = vocab.inline()
    if known is None:
        return response_names(mentions_of(
            extract_resolved(responses, vocab, text_col, scope_col)))
    slim = responses.select("response_id", *filter(None, (scope_col, text_col)))
    names = F.array_distinct(F.transform(packages_of(F.col("found")), lambda p: p["name"]))
    return with_found(slim, known, text_col, scope_col).select(
        "response_id", names.alias("names")).filter(F.size("names") > 0)


def extract_resolved(responses: DataFrame, vocab: Vocabulary,
                     text_col: str = "response_text",
                     scope_col: str | None = "ecosystem") -> DataFrame:
    """K21 core: every candidate with its reason (NULL = a mention)."""
    return resolve(candidates(units(responses, text_col, scope_col)), vocab)


def mentions_of(resolved: DataFrame) -> DataFrame:
    """The mentions (package rows) with their first-seen position columns."""
    return resolved.filter(F.col("reason").isNull()).select(
        "response_id", *POS, "raw", "name", "ecosystem", "source", "origin", "alias_resolved"
    )


def filtered_audit(resolved: DataFrame) -> DataFrame:
    """Distinct names per (response, reason) with their first-seen position."""
    return (
        resolved.filter(F.col("reason").isNotNull())
        .groupBy("response_id", "reason", F.col("audit_name").alias("name"))
        .agg(F.min(F.struct(*POS)).alias("pos"))
    )


def filtered_by_reason(resolved: DataFrame) -> DataFrame:
    """Every distinct filtered name with its reason, sorted by reason then name.
    Kept long (one row per name) so no reason's names are gathered into one group."""
    return (
        resolved.filter(F.col("reason").isNotNull())
        .select("reason", F.col("audit_name").alias("name"))
        .distinct()
        .orderBy("reason", "name")
    )


def packages_per_response(mentions: DataFrame) -> DataFrame:
    """Record assembly: (response_id, packages) with the package structs in first-seen
    order. One group per response, bounded by that response's text."""
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                F.struct(*POS).alias("pos"),
                F.struct("raw", "name", "ecosystem", "source", "origin", "alias_resolved")
                .alias("pkg"),
            )
        )
    )
    return mentions.groupBy("response_id").agg(
        F.transform(ordered, lambda x: x["pkg"]).alias("packages")
    )


def response_names(mentions: DataFrame, ecosystem: str | None = None) -> DataFrame:
    """Distinct names of each response in first-seen order (optionally one
    ecosystem)."""
    m = mentions if ecosystem is None else mentions.filter(F.col("ecosystem") == ecosystem)
    ordered = F.array_sort(F.collect_list(F.struct(F.struct(*POS).alias("pos"), "name")))
    return m.groupBy("response_id").agg(
        F.array_distinct(F.transform(ordered, lambda x: x["name"])).alias("names")
    )


def prose_note(mentions: DataFrame) -> DataFrame:
    """Responses with at least one prose mention get the note."""
    return (
        mentions.groupBy("response_id")
        .agg(F.bool_or(F.col("origin") == "prose").alias("has_prose"))
        .filter("has_prose")
        .select("response_id", F.lit(V.PROSE_NOTE).alias("note"))
    )


def unmapped_imports(mentions: DataFrame) -> DataFrame:
    """Distinct raw import names checked as-is (alias_resolved false), sorted."""
    return (
        mentions.filter(F.col("alias_resolved").eqNullSafe(False))
        .select("raw")
        .distinct()
        .orderBy("raw")
    )


def extract(responses: DataFrame, vocab: Vocabulary, text_col: str = "response_text",
            scope_col: str | None = "ecosystem") -> tuple[DataFrame, DataFrame]:
    """Responses -> (mentions, filtered audit)."""
    resolved = extract_resolved(responses, vocab, text_col, scope_col)
    return mentions_of(resolved), filtered_audit(resolved)
