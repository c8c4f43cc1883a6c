"""Registered extraction queries (stage 1-3 operators) over the derived responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewatch.functions import text as TX
from namewatch.operators import extract as X
from namewatch.operators import segment as S
from namewatch.sources import fixtures as FX


def _resp(s: SparkSession, sf: str) -> DataFrame:
    return FX.responses(s, sf)


def _units(s: SparkSession, sf: str) -> DataFrame:
    return S.units(_resp(s, sf))


def _resolved(s: SparkSession, sf: str) -> DataFrame:
    return X.extract_resolved(_resp(s, sf), X.Vocabulary.default(s))


def _mentions(s: SparkSession, sf: str) -> DataFrame:
    return X.mentions_of(_resolved(s, sf))


def _doc_tokens(s: SparkSession, sf: str) -> DataFrame:
    """Every whitespace token of every document, whole texts."""
    d = FX.read_table(s, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.explode(TX.split_ws(F.col("text"))).alias("token"))


def code_blocks(s, sf):
    b = S.code_blocks(_resp(s, sf))
    return b.select("response_id", "block_idx", "tag", "lang", "body")


def block_langs(s, sf):
    return S.code_blocks(_resp(s, sf)).groupBy("tag", "lang").agg(F.count(F.lit(1)).alias("n"))


def prose_text(s, sf):
    p = S.prose_remainder(_resp(s, sf))
    return p.select("response_id", F.length("prose").alias("prose_len"),
                    F.md5("prose").alias("prose_md5"))


def untagged_infer(s, sf):
    return S.untagged_inference(S.code_blocks(_resp(s, sf)))


def declared_modules(s, sf):
    return S.declared_modules(_resp(s, sf))


def block_routing(s, sf):
    return _units(s, sf).select("response_id", "scope", "section", "block_idx", "kind")


def _cands(s, sf):
    from namewatch.operators.candidates import candidates
    return candidates(_units(s, sf))


def py_imports(s, sf):
    c = _cands(s, sf).filter((F.col("ecosystem") == "python") & (F.col("rule") == 0))
    return c.select("response_id", "block_idx", "match_idx", "item_idx", F.col("raw").alias("target"))


def py_from_imports(s, sf):
    c = _cands(s, sf).filter((F.col("ecosystem") == "python") & (F.col("rule") == 1))
    return c.select("response_id", "block_idx", "match_idx", F.col("raw").alias("module"))


def py_installs(s, sf):
    c = _cands(s, sf).filter((F.col("ecosystem") == "python") & (F.col("rule") == 2))
    return c.select("response_id", "section", "block_idx", "match_idx", "item_idx",
                    F.col("raw").alias("token"), "origin")


def py_requirements(s, sf):
    c = _cands(s, sf).filter((F.col("ecosystem") == "python") & (F.col("rule") == 3))
    return c.select("response_id", "block_idx", "match_idx", "item_idx", F.col("raw").alias("token"))


def js_imports(s, sf):
    c = _cands(s, sf).filter((F.col("ecosystem") == "javascript") & (F.col("rule") <= 4))
    return c.select("response_id", "block_idx", "rule", "match_idx", F.col("raw").alias("specifier"))


def js_installs(s, sf):
    c = _cands(s, sf).filter((F.col("ecosystem") == "javascript") & (F.col("rule") == 5))
    return c.select("response_id", "section", "block_idx", "match_idx", "item_idx",
                    F.col("raw").alias("token"), "origin")


def js_manifest(s, sf):
    c = _cands(s, sf).filter((F.col("ecosystem") == "javascript") & (F.col("rule") == 6))
    return c.select("response_id", "block_idx", F.col("match_idx").alias("dep_key"),
                    F.col("raw").alias("name"))


def install_tokens(s, sf):
    """K1 per install command: the argument text and the names it yields."""
    from namewatch import fixed_values as V
    u = _units(s, sf)
    py = u.filter(F.col("scope") == "python").filter(F.col("kind").isin("python", "shell", "prose"))
    js = u.filter(F.col("scope") == "javascript").filter(
        F.col("kind").isin("javascript", "shell", "prose"))

    def args(df, pattern):
        return df.select(
            "response_id", "section", "block_idx",
            F.posexplode(F.regexp_extract_all("body", TX.lit_re(pattern), F.lit(1)))
            .alias("match_idx", "args"),
        ).select(
            "response_id", "section", "block_idx", F.col("match_idx").cast("int").alias("match_idx"),
            "args", TX.install_tokens(F.col("args"), F.col("section") == 1).alias("names"),
        )

    return args(py, V.PY_INSTALL).unionByName(args(js, V.JS_INSTALL))


def token_peel(s, sf):
    t = _doc_tokens(s, sf)
    return t.groupBy(TX.peel(F.col("token")).alias("peeled")).agg(F.count(F.lit(1)).alias("n"))


def token_clean(s, sf):
    t = _doc_tokens(s, sf)
    return t.groupBy(TX.clean_install_token(F.col("token")).alias("cleaned")).agg(
        F.count(F.lit(1)).alias("n"))


def norm_py(s, sf):
    t = _doc_tokens(s, sf)
    return t.groupBy(TX.normalise_python(F.col("token")).alias("normalised")).agg(
        F.count(F.lit(1)).alias("n"))


def norm_js(s, sf):
    t = _doc_tokens(s, sf)
    return t.groupBy(TX.normalise_js(F.col("token")).alias("normalised")).agg(
        F.count(F.lit(1)).alias("n"))


def js_package_root(s, sf):
    t = _doc_tokens(s, sf)
    return t.groupBy(TX.js_package_root(F.col("token")).alias("root")).agg(
        F.count(F.lit(1)).alias("n"))


def plausible_name(s, sf):
    t = _doc_tokens(s, sf)
    return t.groupBy(TX.plausible_name(F.col("token")).alias("plausible")).agg(
        F.count(F.lit(1)).alias("n"))


def _reasons(s, sf, eco):
    r = _resolved(s, sf).filter(F.col("ecosystem") == eco)
    return r.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "audit_name").agg(
        F.count(F.lit(1)).alias("n"))


def py_filter_reason(s, sf):
    return _reasons(s, sf, "python")


def js_filter_reason(s, sf):
    return _reasons(s, sf, "javascript")


def alias_resolve(s, sf):
    m = _mentions(s, sf).filter((F.col("ecosystem") == "python") & (F.col("source") == "import"))
    return m.groupBy("raw", "name", "alias_resolved").agg(F.count(F.lit(1)).alias("n"))


def filtered_audit(s, sf):
    return X.audit_rows(_resp(s, sf), X.Vocabulary.default(s))


def prose_note(s, sf):
    return X.note_rows(_resp(s, sf), X.Vocabulary.default(s))


def response_names(s, sf):
    return X.name_rows(_resp(s, sf), X.Vocabulary.default(s))


def extract_mentions(s, sf):
    return _mentions(s, sf)


def prose_installs(s, sf):
    m = _mentions(s, sf).filter(F.col("origin") == "prose")
    return m.select("response_id", "ecosystem", "name", "source")


def unmapped_imports(s, sf):
    return X.unmapped_imports(_mentions(s, sf))


def filtered_by_reason(s, sf):
    return X.filtered_by_reason(_resolved(s, sf))


def lookup_keys(s, sf):
    names = _mentions(s, sf).select("ecosystem", "name").distinct()
    return names.select(
        "ecosystem", "name",
        TX.registry_lookup_key(F.col("ecosystem"), F.col("name")).alias("lookup_key"),
        TX.registry_url(F.col("ecosystem"), F.col("name")).alias("url"),
    )


QUERIES = {
    "code_blocks": code_blocks,
    "block_langs": block_langs,
    "prose_text": prose_text,
    "untagged_infer": untagged_infer,
    "declared_modules": declared_modules,
    "block_routing": block_routing,
    "py_imports": py_imports,
    "py_from_imports": py_from_imports,
    "py_installs": py_installs,
    "py_requirements": py_requirements,
    "js_imports": js_imports,
    "js_installs": js_installs,
    "js_manifest": js_manifest,
    "install_tokens": install_tokens,
    "token_peel": token_peel,
    "token_clean": token_clean,
    "norm_py": norm_py,
    "norm_js": norm_js,
    "js_package_root": js_package_root,
    "plausible_name": plausible_name,
    "py_filter_reason": py_filter_reason,
    "js_filter_reason": js_filter_reason,
    "alias_resolve": alias_resolve,
    "filtered_audit": filtered_audit,
    "prose_note": prose_note,
    "response_names": response_names,
    "extract_mentions": extract_mentions,
    "prose_installs": prose_installs,
    "unmapped_imports": unmapped_imports,
    "filtered_by_reason": filtered_by_reason,
    "lookup_keys": lookup_keys,
}
