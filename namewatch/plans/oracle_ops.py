"""Oracle SQL (DuckDB) for the sweep, lookup, call-log, corpus and extension queries."""

from __future__ import annotations

from namewatch import fixed_values as V
from namewatch.plans import oracle_extract as OX
from namewatch.plans.oracle import BASE, CONFIRMED, REVIEW, model_rates
from namewatch.plans.ops_queries import CUT, LATER, PROMPT_LIMIT, RUNS_PER_PROMPT


def _in(values) -> str:
    return "(" + ", ".join(str(v) if isinstance(v, int) else OX.lit(v) for v in values) + ")"


DIMS = f"""
, models AS (
  SELECT concat('model-', CAST(n AS VARCHAR)) AS id,
         CASE WHEN n % 2 = 0 THEN 'anthropic' ELSE 'openai' END AS provider,
         concat('alias-', CAST(n AS VARCHAR)) AS model, n < 3 AS enabled
  FROM (SELECT DISTINCT o_custkey % 4 AS n FROM orders)),
prompts AS (
  SELECT concat('prompt-', lpad(CAST(k AS VARCHAR), 2, '0')) AS id,
         CASE WHEN k % 2 = 0 THEN 'python' ELSE 'javascript' END AS ecosystem,
         concat('domain-', CAST(k % 5 AS VARCHAR)) AS domain,
         CASE WHEN k % 3 = 0 THEN 'vague' WHEN k % 3 = 1 THEN 'detailed' ELSE 'niche' END AS specificity,
         concat('Write a ', lower(segment), ' tool for ', first_name) AS text,
         concat(CASE WHEN k % 2 = 0 THEN 'python' ELSE 'javascript' END, '.yaml') AS file,
         k AS ord
  FROM (SELECT c_custkey % 50 AS k, min(c_name) AS first_name, min(c_mktsegment) AS segment
        FROM customer GROUP BY 1)),
corpus AS (
  SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN 'py' ELSE 'js' END, '-', CAST(c_custkey % 1000 AS VARCHAR)) AS id,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'rust' WHEN c_custkey % 2 = 0 THEN 'python' ELSE 'javascript' END AS ecosystem,
         lower(c_mktsegment) AS domain,
         CASE c_nationkey % 4 WHEN 0 THEN 'vague' WHEN 1 THEN 'detailed' WHEN 2 THEN 'niche' END AS specificity,
         CASE WHEN c_acctbal < 0 THEN '   ' ELSE concat('  Write a tool for ', c_name, ' ', chr(10)) END AS text,
         concat(CASE WHEN c_custkey % 2 = 0 THEN 'python' ELSE 'javascript' END, '.yaml') AS file,
         c_custkey AS ord
  FROM customer),
plan AS (
  SELECT p.id AS prompt_id, p.ecosystem, p.domain, p.specificity, m.id AS model_id,
         CAST(r.range AS BIGINT) AS run_index
  FROM prompts p CROSS JOIN (SELECT id FROM models WHERE enabled) m
  CROSS JOIN range({RUNS_PER_PROMPT}) r),
completed AS (SELECT DISTINCT prompt_id, model_id, run_index FROM runs_f WHERE ok),
attempts AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'python' ELSE 'javascript' END AS ecosystem,
         concat('pkg-', lpad(CAST(l_partkey % 400 AS VARCHAR), 3, '0')) AS name,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS attempt, st AS http_status,
         CASE WHEN st IS NULL THEN 'ConnectTimeout: timed out' ELSE concat('HTTP ', CAST(st AS VARCHAR)) END AS detail,
         l_shipdate AS checked_at, l_orderkey AS batch
  FROM (SELECT *, CAST(CASE WHEN (l_partkey + l_suppkey) % 10 <= 4 THEN 200
                    WHEN (l_partkey + l_suppkey) % 10 <= 6 THEN 404
                    WHEN (l_partkey + l_suppkey) % 10 = 7 THEN 429
                    WHEN (l_partkey + l_suppkey) % 10 = 8 THEN (CASE WHEN l_returnflag = 'R' THEN 403 ELSE 503 END)
                    END AS INTEGER) AS st FROM lineitem)),
calls AS (
  SELECT r.response_id AS call_id, r.model_id, r.prompt_id, r.run_index,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS attempt, provider,
         CASE WHEN st = 429 THEN 'RateLimitError' WHEN st IN (500, 503) THEN 'InternalServerError'
              WHEN st = 408 THEN 'APITimeoutError' WHEN st = 400 THEN 'BadRequestError'
              WHEN st = 401 THEN 'AuthenticationError' END AS exc_type,
         CASE WHEN st = 429 AND l_suppkey % 3 = 0 AND l_suppkey % 2 = 1 THEN 'insufficient_quota' END AS error_code,
         st AS status_code,
         CASE WHEN st = 429 AND l_suppkey % 3 = 0 AND l_suppkey % 2 = 0
                THEN 'Error code: 429 - {{''error'': {{''code'': ''insufficient_quota''}}}}'
              WHEN st IS NOT NULL THEN concat('Error code: ', CAST(st AS VARCHAR), ' - request failed') END AS message,
         CASE WHEN st IS NULL THEN (CASE WHEN l_returnflag = 'R'
                THEN (CASE WHEN provider = 'anthropic' THEN 'max_tokens' ELSE 'length' END)
                ELSE (CASE WHEN provider = 'anthropic' THEN 'end_turn' ELSE 'stop' END) END) END AS stop_reason,
         l_quantity / 10.0 AS latency_s, l_shipdate AS created_at
  FROM (SELECT response_id, model_id, prompt_id, run_index,
               CASE WHEN model_id IN ('model-0', 'model-2') THEN 'anthropic' ELSE 'openai' END AS provider
        FROM runs_f) r
  JOIN (SELECT *, CAST(CASE l_partkey % 10 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 400
                        WHEN 3 THEN 401 WHEN 4 THEN 500 WHEN 5 THEN 408 END AS INTEGER) AS st
        FROM lineitem) l ON r.response_id = l.l_orderkey)
"""


def reduce_sql(where: str = "TRUE") -> str:
    terminal = (f"(http_status IS NOT NULL AND (http_status IN (200, 404) OR http_status NOT IN "
                f"{_in(V.RETRYABLE_HTTP)}))")
    return f"""(
  WITH t AS (SELECT *, {terminal} AS terminal FROM attempts WHERE {where}),
  ft AS (SELECT ecosystem, name, http_status AS ft_status FROM (
         SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY checked_at, batch, attempt) AS rn
         FROM t WHERE terminal) WHERE rn = 1),
  la AS (SELECT ecosystem, name, http_status AS last_status, detail AS last_detail FROM (
         SELECT *, row_number() OVER (PARTITION BY ecosystem, name
                                      ORDER BY checked_at DESC, batch DESC, attempt DESC) AS rn
         FROM t) WHERE rn = 1),
  agg AS (SELECT ecosystem, name, min(checked_at) AS checked_at, count(*) AS attempts FROM t GROUP BY 1, 2)
  SELECT agg.ecosystem, agg.name,
         CASE WHEN ft.ft_status = 200 THEN 'exists' WHEN ft.ft_status = 404 THEN 'not_found' ELSE 'error' END AS status,
         CASE WHEN ft.ft_status IS NOT NULL THEN ft.ft_status ELSE la.last_status END AS http_status,
         CASE WHEN ft.ft_status IN (200, 404) THEN NULL
              WHEN ft.ft_status IS NOT NULL THEN concat('HTTP ', CAST(ft.ft_status AS VARCHAR))
              WHEN la.last_status IS NOT NULL THEN concat('HTTP ', CAST(la.last_status AS VARCHAR))
              ELSE la.last_detail END AS detail,
         agg.checked_at, agg.attempts
  FROM agg LEFT JOIN ft USING (ecosystem, name) LEFT JOIN la USING (ecosystem, name))"""


CACHE = f"""
, snap_before AS {reduce_sql(f"checked_at < TIMESTAMP '{CUT}'")},
snap_after AS {reduce_sql(f"checked_at >= TIMESTAMP '{CUT}'")},
snap_all AS {reduce_sql()},
cache AS (
  SELECT ecosystem, name, status, http_status, detail, checked_at FROM (
    SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY put DESC, checked_at DESC, status DESC) AS rn
    FROM (SELECT ecosystem, name, status, http_status, detail, checked_at, 0 AS put FROM snap_before
          WHERE status IN ('exists', 'not_found')
          UNION ALL
          SELECT ecosystem, name, status, http_status, detail, checked_at, 1 AS put FROM snap_after
          WHERE status IN ('exists', 'not_found'))) WHERE rn = 1),
fresh AS (
  SELECT *, status <> 'error' AND date_diff('second', checked_at, (SELECT max(checked_at) FROM cache))
            <= {V.CACHE_MAX_AGE_DAYS * 86400.0} AS fresh FROM cache),
uniq AS (SELECT DISTINCT ecosystem, name FROM mentions_f
         WHERE ecosystem IS NOT NULL AND ecosystem <> '' AND name IS NOT NULL AND name <> ''),
split AS (
  SELECT u.ecosystem, u.name, f.status IS NOT NULL AS from_cache, f.status, f.http_status, f.detail, f.checked_at
  FROM uniq u LEFT JOIN (SELECT * FROM fresh WHERE fresh) f USING (ecosystem, name))
"""

W = BASE + DIMS + CACHE


def outcome_sql() -> str:
    quota = " OR ".join(f"contains(message, {OX.lit(c)})" for c in V.TERMINAL_CALL_CODES)
    return (
        "CASE WHEN exc_type IS NULL AND status_code IS NULL THEN 'ok' "
        f"WHEN coalesce(error_code IN {_in(V.TERMINAL_CALL_CODES)}, false) OR coalesce({quota}, false) "
        "THEN 'terminal' "
        f"WHEN coalesce(exc_type IN {_in(V.TRANSIENT_CALL_TYPES)} OR status_code IN "
        f"{_in(V.TRANSIENT_CALL_STATUS)}, false) THEN 'transient' ELSE 'terminal' END"
    )


def truncated_sql(provider: str, stop: str) -> str:
    a, b = V.TRUNCATION_STOP_REASONS
    return (f"coalesce(({provider} = 'anthropic' AND {stop} = '{a}') OR "
            f"({provider} = 'openai' AND {stop} = '{b}'), false)")


def per_model_sql(runs_where: str, m_where: str) -> str:
    return (W + f", r2 AS (SELECT * FROM runs_f WHERE {runs_where}), "
            f"m2 AS (SELECT * FROM judged WHERE {m_where})" + model_rates("r2", "m2"))


def rates_by_sql(key: str) -> str:
    return f"""
SELECT {key},
       count(*) FILTER (WHERE status IN ('exists', 'not_found')) AS checkable,
       count(*) FILTER (WHERE {CONFIRMED}) AS confirmed,
       count(*) FILTER (WHERE {REVIEW}) AS needs_review,
       CASE WHEN count(*) FILTER (WHERE status IN ('exists', 'not_found')) = 0 THEN NULL
            ELSE count(*) FILTER (WHERE {CONFIRMED})
                 / count(*) FILTER (WHERE status IN ('exists', 'not_found')) END AS confirmed_rate
FROM judged GROUP BY {key}"""


def all_sql() -> dict[str, str]:
    outcome = outcome_sql()
    dq = " UNION ALL ".join(
        [f"SELECT file, id, 'missing_field' AS check, '{f}' AS detail FROM corpus WHERE {f} IS NULL"
         for f in ("id", "ecosystem", "domain", "specificity", "text")]
        + ["SELECT min(file) AS file, id, 'duplicate_id' AS check, "
           "concat(CAST(count(*) AS VARCHAR), ' entries') AS detail FROM corpus "
           "WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
           f"SELECT file, id, 'bad_ecosystem', ecosystem FROM corpus WHERE ecosystem IS NOT NULL "
           f"AND ecosystem NOT IN {_in(V.VALID_ECOSYSTEMS)}",
           f"SELECT file, id, 'bad_specificity', specificity FROM corpus WHERE specificity IS NOT NULL "
           f"AND specificity NOT IN {_in(V.VALID_SPECIFICITY)}",
           f"SELECT file, id, 'empty_text', '' FROM corpus WHERE text IS NOT NULL AND {OX.strip('text')} = ''"]
    )
    gs = " UNION ALL ".join(
        f"SELECT '{k}' AS dimension, {k} AS value, "
        f"count(*) FILTER (WHERE status IN ('exists', 'not_found')) AS checkable, "
        f"count(*) FILTER (WHERE {CONFIRMED}) AS confirmed, count(*) FILTER (WHERE {REVIEW}) AS needs_review, "
        f"CASE WHEN count(*) FILTER (WHERE status IN ('exists', 'not_found')) = 0 THEN NULL ELSE "
        f"count(*) FILTER (WHERE {CONFIRMED}) / count(*) FILTER (WHERE status IN ('exists', 'not_found')) END "
        f"AS confirmed_rate FROM judged GROUP BY {k}"
        for k in ("model_id", "specificity", "ecosystem", "domain"))
    ext = OX.pipeline_ctes()
    return {
        "plan_enabled": W + "SELECT id, provider, model FROM models WHERE enabled",
        "sweep_plan": W + "SELECT * FROM plan",
        "plan_limited": W + f"SELECT id, ecosystem, domain, specificity, ord FROM prompts ORDER BY ord LIMIT {PROMPT_LIMIT}",
        "completed_keys": W + "SELECT * FROM completed",
        "resume_pending": W + "SELECT prompt_id, model_id, run_index FROM plan "
        "ANTI JOIN completed USING (prompt_id, model_id, run_index)",
        "resume_done": W + "SELECT count(*) AS done FROM plan SEMI JOIN completed USING (prompt_id, model_id, run_index)",
        "records_enriched": W + """
SELECT r.run_id, r.prompt_id, p.ecosystem, p.domain, p.specificity, r.model_id,
       mo.model AS model_alias, mo.provider, r.run_index, r.ok, r.truncated, r.created_at,
       round(o.o_totalprice / 7919.0, 3) AS latency_s
FROM runs_f r JOIN orders o ON o.o_orderkey = r.response_id
LEFT JOIN prompts p ON p.id = r.prompt_id LEFT JOIN models mo ON mo.id = r.model_id""",
        "sweep_summary": W + """
, before AS (SELECT DISTINCT prompt_id, model_id, run_index FROM runs_f WHERE ok AND run_id = 'sweep-0'),
pending AS (SELECT * FROM plan ANTI JOIN before USING (prompt_id, model_id, run_index)),
att AS (SELECT * FROM runs_f WHERE run_id <> 'sweep-0' AND
        (prompt_id, model_id, run_index) IN (SELECT (prompt_id, model_id, run_index) FROM pending))
SELECT (SELECT count(*) FROM plan) AS total,
       (SELECT count(*) FROM plan) - (SELECT count(*) FROM pending) AS skipped,
       (SELECT count(*) FROM att) AS attempted,
       (SELECT count(*) FILTER (WHERE ok) FROM att) AS ok,
       (SELECT count(*) FILTER (WHERE NOT ok) FROM att) AS failed,
       (SELECT count(*) FILTER (WHERE truncated) FROM att) AS truncated""",
        "classify_http": W + "SELECT http_status, CASE WHEN http_status = 200 THEN 'exists' "
        "WHEN http_status = 404 THEN 'not_found' ELSE 'error' END AS status, count(*) AS n "
        "FROM attempts GROUP BY 1, 2",
        "reduce_attempts": W + "SELECT * FROM snap_all",
        "cache_fresh": W + "SELECT ecosystem, name, status, checked_at, fresh FROM fresh",
        "latest_status": W + """
SELECT ecosystem, name, status, http_status, checked_at FROM (
  SELECT ecosystem, name, CASE WHEN http_status = 200 THEN 'exists' WHEN http_status = 404
         THEN 'not_found' ELSE 'error' END AS status, http_status, checked_at,
         row_number() OVER (PARTITION BY ecosystem, name ORDER BY checked_at DESC, batch DESC, attempt DESC) AS rn
  FROM attempts) WHERE rn = 1""",
        "cache_put": W + "SELECT * FROM cache",
        "cache_split": W + "SELECT * FROM split",
        "cache_stats": W + "SELECT count(*) FILTER (WHERE from_cache) AS hits, "
        "count(*) FILTER (WHERE NOT from_cache) AS misses FROM split",
        "unique_names": W + "SELECT * FROM uniq ORDER BY ecosystem, name",
        "dedupe_first_seen": ext + f"""
SELECT ecosystem, name, response_id, eco_ord, section, CAST(block_idx AS INTEGER) AS block_idx, rule,
       CAST(match_idx AS INTEGER) AS match_idx, CAST(item_idx AS INTEGER) AS item_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY response_id, {OX.POS}) AS rn
  FROM mentions) WHERE rn = 1""",
        "status_counts": W + "SELECT status, count(*) AS n FROM snap_all GROUP BY status",
        "check_summary": W + "SELECT count(*) FILTER (WHERE status = 'not_found') AS not_found, "
        "count(*) FILTER (WHERE status = 'exists') AS exist, "
        "count(*) FILTER (WHERE status = 'error') AS undetermined FROM snap_all",
        "check_ambiguous": W + f"SELECT ecosystem, name FROM snap_all WHERE ecosystem = 'python' "
        f"AND status = 'not_found' AND name NOT IN (SELECT dist_name FROM ({OX.aliases_sql()}))",
        "status_transitions": W + f"""
SELECT * FROM (
  SELECT ecosystem, name, snapshot_at, status,
         lag(status) OVER (PARTITION BY ecosystem, name ORDER BY snapshot_at) AS previous_status
  FROM (SELECT ecosystem, name, status, TIMESTAMP '{CUT}' AS snapshot_at FROM snap_before
        UNION ALL SELECT ecosystem, name, status, TIMESTAMP '{LATER}' FROM snap_after))
WHERE previous_status IS NOT NULL AND previous_status <> status""",
        "classify_call_error": W + f"SELECT exc_type, error_code, status_code, message, "
        f"{outcome} AS outcome, count(*) AS n FROM calls GROUP BY ALL",
        "reduce_calls": W + f"""
, c AS (SELECT *, {outcome} AS outcome FROM calls),
d AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY
                   CASE WHEN attempt <= 3 AND (outcome <> 'transient' OR attempt = 3) THEN 0 ELSE 1 END,
                   CASE WHEN attempt <= 3 AND (outcome <> 'transient' OR attempt = 3) THEN attempt
                        ELSE -attempt END) AS rn
        FROM c WHERE attempt <= 3) WHERE rn = 1),
n AS (SELECT call_id, model_id, prompt_id, run_index,
             count(*) FILTER (WHERE attempt <= 3) AS attempts,
             count(*) FILTER (WHERE attempt > 3) AS ignored_attempts FROM c GROUP BY ALL)
SELECT n.call_id, n.model_id, n.prompt_id, n.run_index, coalesce(d.outcome = 'ok', false) AS ok,
       CASE WHEN n.attempts = 0 THEN 'no attempt within the retry limit'
            WHEN d.outcome <> 'ok' THEN concat(coalesce(d.exc_type, 'Error'), ': ', substr(coalesce(d.message, ''), 1, {V.CALL_ERROR_MESSAGE_CHARS})) END AS error,
       round(d.latency_s, 3) AS latency_s,
       CASE WHEN d.outcome = 'ok' THEN d.stop_reason END AS stop_reason,
       coalesce(d.outcome = 'ok', false) AND {truncated_sql('d.provider', 'd.stop_reason')} AS truncated,
       d.attempt AS deciding_attempt, n.attempts, n.ignored_attempts
FROM n LEFT JOIN d USING (call_id)""",
        "truncated_flag": W + f"SELECT provider, stop_reason, {truncated_sql('provider', 'stop_reason')} "
        "AS truncated, count(*) AS n FROM calls WHERE status_code IS NULL GROUP BY ALL",
        "response_assemble": W + """
SELECT conv_id AS response_id,
       coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS text,
       nullif(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (WHERE role <> 'assistant'), ''), '') AS thinking
FROM conversations GROUP BY conv_id""",
        "dq_prompts": W + dq,
        "prompts_scan": W + f"SELECT id, ecosystem, domain, specificity, {OX.strip('text')} AS text, file, "
        "position AS ord FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) - 1 "
        "AS position FROM corpus) WHERE ecosystem IN ('python') ORDER BY file, position",
        "corpus_summary": W + """
SELECT count(*) AS prompts, count(*) FILTER (WHERE ecosystem = 'python') AS python,
       count(*) FILTER (WHERE ecosystem = 'javascript') AS javascript,
       count(*) FILTER (WHERE specificity = 'vague') AS vague,
       count(*) FILTER (WHERE specificity = 'detailed') AS detailed,
       count(*) FILTER (WHERE specificity = 'niche') AS niche,
       count(DISTINCT domain) AS domains,
       CASE WHEN count(*) = 0 THEN NULL ELSE count(*) FILTER (WHERE specificity = 'niche') / count(*) END AS niche_share
FROM prompts""",
        "cross_recurrence": W + """
SELECT ecosystem, name, count(DISTINCT prompt_id) AS prompts, count(DISTINCT model_id) AS models,
       count(DISTINCT concat_ws(chr(1), model_id, prompt_id, CAST(run_index AS VARCHAR))) AS runs
FROM judged WHERE status = 'not_found' GROUP BY ecosystem, name""",
        "by_domain": W + rates_by_sql("domain"),
        "rates_grouping_sets": W + gs,
        "strict_rates": per_model_sql("TRUE", "origin = 'code_block'"),
        "untruncated_rates": per_model_sql("NOT coalesce(truncated, false)",
                                           "NOT coalesce(truncated, false)"),
        "recurrence_redacted": W + "SELECT model_id, prompt_id, ecosystem, sha256(concat('example-key:', name)) AS name_sha256, "
        "appearances, runs, recurrence_rate, status FROM rec",
        "by_resolved_model": W + f"""
SELECT model_id, concat(model_id, '-', strftime(created_at, '%Y')) AS resolved_model, count(*) AS mentions,
       count(*) FILTER (WHERE status IN ('exists', 'not_found')) AS checkable,
       count(*) FILTER (WHERE {CONFIRMED}) AS confirmed,
       CASE WHEN count(*) FILTER (WHERE status IN ('exists', 'not_found')) = 0 THEN NULL
            ELSE count(*) FILTER (WHERE {CONFIRMED}) / count(*) FILTER (WHERE status IN ('exists', 'not_found')) END AS confirmed_rate
FROM judged GROUP BY 1, 2""",
    }
