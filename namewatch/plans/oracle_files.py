"""Oracle SQL (DuckDB) for the source/sink queries: what the reader must see after the
writer ran."""

from __future__ import annotations

from namewatch.plans import oracle_extract as OX
from namewatch.plans.oracle import BASE
from namewatch.plans.file_queries import PASSES
from namewatch.plans.oracle_ops import CACHE, DIMS, reduce_sql
from namewatch.plans.ops_queries import CUT, LATER

W = BASE + DIMS + CACHE
RUN_COLS = ("run_id, prompt_id, ecosystem, domain, specificity, model_id, run_index, ok, "
            "truncated, created_at")


def _snap_id(ts: str) -> str:
    d, t = ts.split(" ")
    return d.replace("-", "") + "T" + t.replace(":", "") + "Z"


def reextract_sql() -> str:
    pk = ("{'raw': raw, 'name': name, 'ecosystem': ecosystem, 'source': source, "
          "'origin': origin, 'alias_resolved': alias_resolved}")
    order = OX.POS
    return OX.pipeline_ctes() + f"""
, {OX.resolved_cte("resolved_stale", "false", "CAST(NULL AS VARCHAR)")},
new_pk AS (SELECT response_id, list({pk} ORDER BY {order}) AS p FROM resolved
           WHERE reason IS NULL GROUP BY response_id),
old_pk AS (SELECT response_id, list({pk} ORDER BY {order}) AS p FROM resolved_stale
           WHERE reason IS NULL GROUP BY response_id),
pairs AS (SELECT r.response_id, coalesce(o.p, []) AS old_p, coalesce(n.p, []) AS new_p
         FROM resp r LEFT JOIN old_pk o USING (response_id) LEFT JOIN new_pk n USING (response_id))
SELECT count(*) AS records, count(*) FILTER (WHERE old_p IS DISTINCT FROM new_p) AS changed,
       CAST(sum(len(old_p)) AS BIGINT) AS packages_before,
       CAST(sum(len(new_p)) AS BIGINT) AS packages_after
FROM pairs"""


def mentions_loaded_sql() -> str:
    listed = ("coalesce(CASE ecosystem WHEN 'python' THEN py_raw IN (SELECT w FROM py_words) "
              "ELSE vocab_key IN (SELECT w FROM js_words) END, false)")
    alias = "(CASE WHEN py_raw IN (SELECT w FROM py_alias) THEN concat('dist-', py_raw) END)"
    return OX.pipeline_ctes() + f"""
, {OX.resolved_cte("first_pass", "false", "CAST(NULL AS VARCHAR)")},
py_words AS (SELECT DISTINCT raw AS w FROM first_pass
             WHERE reason IS NULL AND ecosystem = 'python' AND md5(raw) < '8'),
js_words AS (SELECT DISTINCT name AS w FROM first_pass
             WHERE reason IS NULL AND ecosystem = 'javascript' AND md5(name) < '8'),
py_alias AS (SELECT DISTINCT raw AS w FROM first_pass
             WHERE reason IS NULL AND ecosystem = 'python' AND md5(raw) >= '8'),
{OX.resolved_cte("second_pass", listed, alias)}
SELECT ecosystem, coalesce(reason, 'kept') AS reason, audit_name, name, alias_resolved,
       count(*) AS n FROM second_pass GROUP BY ALL"""


def all_sql() -> dict[str, str]:
    return {
        "scan_runs": BASE + f"""
SELECT {RUN_COLS}, CAST(coalesce(n, 0) AS INTEGER) AS n_packages FROM runs_f r
LEFT JOIN (SELECT response_id, count(*) AS n FROM mentions_f GROUP BY 1) m USING (response_id)""",
        "scan_mentions": BASE + "SELECT run_id, prompt_id, ecosystem, domain, specificity, "
        "model_id, run_index, name, source, origin, alias_resolved FROM mentions_f",
        "scan_registry": BASE + "SELECT ecosystem, name, status FROM names_f",
        "scan_tolerant": BASE + "SELECT DISTINCT prompt_id, model_id, run_index FROM runs_f "
        "WHERE ok AND response_id % 13 <> 0",
        "scan_strict": BASE + f"""
SELECT {RUN_COLS}, CAST(coalesce(n, 0) AS INTEGER) AS n_packages FROM runs_f r
LEFT JOIN (SELECT response_id, count(*) AS n FROM mentions_f GROUP BY 1) m USING (response_id)""",
        "snapshot_mention_status": W + """
, newest AS (
  SELECT ecosystem, name, coalesce(a.status, b.status) AS status
  FROM snap_before b FULL JOIN snap_after a USING (ecosystem, name))
SELECT coalesce(status, 'unchecked') AS status, count(*) AS n
FROM (SELECT ecosystem, name FROM mentions_f) LEFT JOIN newest USING (ecosystem, name)
GROUP BY 1""",
        "mention_status_as_of": W + ", " + ",\n".join(
            f"pass_{i} AS {reduce_sql(f'checked_at < TIMESTAMP {chr(39)}{at}{chr(39)}')}"
            for i, at in enumerate(PASSES)) + """,
dated AS (""" + " UNION ALL ".join(
            f"SELECT ecosystem, name, status, TIMESTAMP '{at}' AS seen FROM pass_{i}"
            for i, at in enumerate(PASSES)) + """)
SELECT model_id, year(created_at) AS year, coalesce(d.status, 'unchecked') AS status,
       count(*) AS n
FROM mentions_f f ASOF LEFT JOIN dated d
  ON f.ecosystem = d.ecosystem AND f.name = d.name AND f.created_at >= d.seen
GROUP BY ALL""",
        "cache_table": W + "SELECT * FROM cache",
        "append_runs": BASE + "SELECT run_id, count(*) AS records, count(*) FILTER (WHERE ok) AS ok "
        "FROM runs_f GROUP BY run_id",
        "snapshot_write": W + f"""
SELECT '{_snap_id(CUT)}' AS snapshot_id, status, count(*) AS n FROM snap_before GROUP BY status
UNION ALL
SELECT '{_snap_id(LATER)}' AS snapshot_id, status, count(*) AS n FROM snap_after GROUP BY status""",
        "wordlist_load": f"SELECT DISTINCT {OX.strip('n_name')} AS word FROM nation",
        "alias_load": "SELECT DISTINCT concat('mod_', CAST(p_partkey % 1000 AS VARCHAR)) "
        "AS import_name, concat('dist-3-', CAST((p_partkey % 1000) % 97 AS VARCHAR)) AS dist_name "
        "FROM part",
        "mentions_loaded": mentions_loaded_sql(),
        "recurrence_csv_write": BASE + """
SELECT model_id, prompt_id, ecosystem, name, CAST(appearances AS VARCHAR) AS appearances,
       CAST(runs AS VARCHAR) AS runs, printf('%.4f', recurrence_rate) AS recurrence_rate, status
FROM rec""",
        "reextract_diff": reextract_sql(),
    }
