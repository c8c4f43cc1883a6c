"""Oracle SQL for the streaming queries: the batch answer the stream must reach."""

from __future__ import annotations

from namewatch.plans import oracle_extract as OX
from namewatch.plans.oracle import BASE
from namewatch.plans.oracle_ops import CACHE, DIMS

W = BASE + DIMS + CACHE


def all_sql() -> dict[str, str]:
    ext = OX.pipeline_ctes()
    return {
        "stream_mentions": ext + "SELECT response_id, eco_ord, section, CAST(block_idx AS INTEGER) AS block_idx, "
        "rule, CAST(match_idx AS INTEGER) AS match_idx, CAST(item_idx AS INTEGER) AS item_idx, raw, name, "
        "ecosystem, source, origin, alias_resolved FROM mentions",
        "stream_new_names": ext + "SELECT DISTINCT ecosystem, name FROM mentions",
        "stream_new_names_bounded": BASE + "SELECT DISTINCT ecosystem, name FROM mentions_f",
        "stream_recurrence": BASE + "SELECT model_id, prompt_id, ecosystem, name, appearances, runs, "
        "recurrence_rate FROM rec",
        "stream_progress": BASE + "SELECT count(*) AS records, count(*) FILTER (WHERE ok) AS ok, "
        "count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE truncated) AS truncated FROM runs_f",
        "stream_resume": W + "SELECT prompt_id, model_id, run_index FROM plan "
        "ANTI JOIN completed USING (prompt_id, model_id, run_index)",
    }
