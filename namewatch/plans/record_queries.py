"""Registered queries of record assembly and re-extraction, with their oracle SQL.

The calls are derived from the documents (``fixtures.model_calls``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewatch import fixed_values as V
from namewatch.operators import extract as X
from namewatch.operators import records as RC
from namewatch.sources import files as FS
from namewatch.sources import fixtures as FX


def _built(s: SparkSession, sf: str, vocab: X.Vocabulary) -> DataFrame:
    return RC.build_records(FX.model_calls(s, sf), FX.prompts(s, sf), FX.models(s, sf), vocab)


def build_records(s: SparkSession, sf: str) -> DataFrame:
    """R8 + J7 + K21: full records; the text by its length, packages by their names."""
    r = _built(s, sf, X.Vocabulary.default(s))
    return r.select(
        "response_id", "schema_version", "run_id", "prompt_id", "ecosystem", "domain",
        "specificity", "model_id", "model_alias", "resolved_model", "run_index", "ok", "error",
        "latency_s", "input_tokens", "output_tokens", "stop_reason", "truncated", "params_sent",
        F.transform("packages", lambda p: p["name"]).alias("names"),
        F.array_join("extraction_notes", " ").alias("notes"),
        F.length("response_text").cast("long").alias("text_length"))


def reextract(s: SparkSession, sf: str) -> DataFrame:
    """S8 + A18: records extracted with a stale vocabulary (no standard library, no aliases),
    committed as version 1, extracted again into version 2, and compared."""
    base = FS.scratch_path(s, "run-records")
    FS.write_version(_built(s, sf, X.Vocabulary.small(s, set(), set(), {})), base, 1)
    old = FS.read_current(s, base)
    FS.write_version(RC.reextract(old, X.Vocabulary.default(s)), base, 2)
    return RC.reextraction_diff(FS.read_version(s, base, 1), FS.read_current(s, base))


# What the vocabulary of reextract_incremental's stored records lacks.
_LATER_NAMES = {"python": {"os", "sqlite3"}, "javascript": {"fs"}}
_LATER_ALIASES = {"cv2"}


def reextract_incremental(s: SparkSession, sf: str) -> DataFrame:
    """S8 + A18 after a vocabulary change: records extracted before some names and an alias
    were added are indexed once; only those that hold such a word are extracted again, and
    their results replace the stored ones. Compared record by record."""
    known = X.Vocabulary.default(s).inline()
    old = X.Vocabulary.small(s, set(known.python - _LATER_NAMES["python"]),
                             set(known.javascript - _LATER_NAMES["javascript"]),
                             {k: v for k, v in known.aliases.items() if k not in _LATER_ALIASES})
    new = X.Vocabulary.default(s)
    base = FS.scratch_path(s, "run-records")
    FS.write_version(_built(s, sf, old), f"{base}/records", 1)
    records = FS.read_current(s, f"{base}/records")
    FS.write_version(RC.vocabulary_index(records), f"{base}/index", 1)
    changes = RC.reextract_touched(records, FS.read_current(s, f"{base}/index"), old, new)
    FS.write_version(RC.with_changes(records, changes), f"{base}/results", 1)
    now = FS.read_current(s, f"{base}/results")
    touched = RC.touched_records(FS.read_current(s, f"{base}/index"), old, new)
    return RC.reextraction_diff(records, now).withColumn(
        "read_again", touched.agg(F.count(F.lit(1))).scalar())


QUERIES = {"build_records": build_records, "reextract": reextract,
           "reextract_incremental": reextract_incremental}


def all_sql() -> dict[str, str]:
    from namewatch.plans import oracle_extract as OX
    from namewatch.plans.oracle_ops import DIMS

    order = OX.POS
    base = OX.pipeline_ctes() + f"""
, {OX.resolved_cte("resolved_stale", "false", "CAST(NULL AS VARCHAR)")}
{DIMS},
calls_f AS (
  SELECT response_id AS i, response_text, response_id % 7 <> 0 AS ok FROM resp),
fresh AS (
  SELECT response_id AS i, list(name ORDER BY {order}) AS names,
         list({{'n': name, 'r': raw, 'e': ecosystem, 's': source, 'o': origin,
                'a': alias_resolved}} ORDER BY {order}) AS p,
         bool_or(origin = 'prose') AS prose
  FROM resolved WHERE reason IS NULL GROUP BY 1),
stale AS (
  SELECT response_id AS i,
         list({{'n': name, 'r': raw, 'e': ecosystem, 's': source, 'o': origin,
                'a': alias_resolved}} ORDER BY {order}) AS p
  FROM resolved_stale WHERE reason IS NULL GROUP BY 1)"""
    return {
        "build_records": base + f"""
SELECT i AS response_id, 1 AS schema_version, concat('sweep-', CAST(i % 3 AS VARCHAR)) AS run_id,
       q.id AS prompt_id, q.ecosystem, q.domain, q.specificity, mo.id AS model_id,
       mo.model AS model_alias, concat(mo.id, '-2024') AS resolved_model, i % 20 AS run_index, ok,
       CASE WHEN NOT ok THEN 'Timeout: no answer' END AS error,
       round((i % 1000) / 7.0, 3) AS latency_s, i % 500 AS input_tokens,
       CASE WHEN ok THEN length(response_text) END AS output_tokens,
       CASE WHEN ok AND i % 9 = 0 THEN 'max_tokens' WHEN ok THEN 'end_turn' END AS stop_reason,
       ok AND i % 9 = 0 AS truncated, '{{"max_tokens": 8192}}' AS params_sent,
       CASE WHEN ok AND names IS NOT NULL THEN names ELSE CAST([] AS VARCHAR[]) END AS names,
       CASE WHEN ok AND prose THEN {OX.lit(V.PROSE_NOTE)} ELSE '' END AS notes,
       CASE WHEN ok THEN length(response_text) END AS text_length
FROM calls_f LEFT JOIN fresh USING (i)
LEFT JOIN prompts q ON q.id = concat('prompt-', lpad(CAST(i % 50 AS VARCHAR), 2, '0'))
LEFT JOIN models mo ON mo.id = concat('model-', CAST(i % 4 AS VARCHAR))""",
        "reextract_incremental": OX.pipeline_ctes() + f"""
, later AS (
  SELECT *, coalesce(CASE ecosystem WHEN 'python' THEN py_raw IN {OX.in_list(sorted(_LATER_NAMES['python']))}
                     ELSE vocab_key IN {OX.in_list(sorted(_LATER_NAMES['javascript']))} END, false)
              AS new_name,
         coalesce(ecosystem = 'python' AND py_raw IN {OX.in_list(sorted(_LATER_ALIASES))}, false)
              AS new_alias
  FROM joined WHERE response_id % 7 <> 0),
{OX.resolved_cte("before", "(in_vocab AND NOT new_name)",
                 "(CASE WHEN new_alias THEN NULL ELSE a_dist END)").replace("FROM joined)", "FROM later)")},
p AS (
  SELECT response_id,
         list({{'n': name, 'r': raw, 's': source, 'o': origin, 'a': alias_resolved}} ORDER BY {order}) AS p
  FROM before WHERE reason IS NULL GROUP BY 1),
q AS (
  SELECT response_id,
         list({{'n': name, 'r': raw, 's': source, 'o': origin, 'a': alias_resolved}} ORDER BY {order}) AS q
  FROM resolved WHERE reason IS NULL AND response_id % 7 <> 0 GROUP BY 1)
SELECT count(*) AS records,
       count(*) FILTER (WHERE coalesce(p, []) IS DISTINCT FROM coalesce(q, [])) AS changed,
       CAST(sum(coalesce(len(p), 0)) AS BIGINT) AS packages_before,
       CAST(sum(coalesce(len(q), 0)) AS BIGINT) AS packages_after,
       (SELECT count(DISTINCT response_id) FROM later WHERE new_name OR new_alias) AS read_again
FROM resp LEFT JOIN p USING (response_id) LEFT JOIN q USING (response_id)""",
        "reextract": base + """
SELECT count(*) AS records,
       count(*) FILTER (WHERE ok AND coalesce(s.p, []) IS DISTINCT FROM coalesce(f.p, []))
           AS changed,
       CAST(sum(CASE WHEN ok THEN coalesce(len(s.p), 0) ELSE 0 END) AS BIGINT) AS packages_before,
       CAST(sum(CASE WHEN ok THEN coalesce(len(f.p), 0) ELSE 0 END) AS BIGINT) AS packages_after
FROM calls_f LEFT JOIN fresh f USING (i) LEFT JOIN stale s USING (i)""",
    }
