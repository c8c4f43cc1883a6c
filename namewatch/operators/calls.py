"""Model-call outcomes as tables (R4-R7): classify each attempt of a call log, reduce the
attempts of a task to its record, assemble response text from content blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch import fixed_values as V

# One call = one task execution (``call_id``) with its retries.
TASK_KEY = ["call_id", "model_id", "prompt_id", "run_index"]


def classify_call_error(exc_type: Column, error_code: Column, status: Column,
                        message: Column) -> Column:
    """R4: 'ok' for a successful attempt; otherwise 'terminal' for quota codes (as an
    attribute or in the message), 'transient' for the transient exception types and
    statuses, 'terminal' for anything else."""
    quota = error_code.isin(*V.TERMINAL_CALL_CODES)
    for code in V.TERMINAL_CALL_CODES:
        quota = quota | F.coalesce(message.contains(code), F.lit(False))
    transient = exc_type.isin(*V.TRANSIENT_CALL_TYPES) | status.isin(*V.TRANSIENT_CALL_STATUS)
    failed = exc_type.isNotNull() | status.isNotNull()
    return (
        F.when(~failed, "ok")
        .when(F.coalesce(quota, F.lit(False)), "terminal")
        .when(F.coalesce(transient, F.lit(False)), "transient")
        .otherwise("terminal")
    )


def truncated_flag(provider: Column, stop_reason: Column) -> Column:
    """Provider A truncates at stop reason 'max_tokens', provider B at 'length'."""
    a, b = V.TRUNCATION_STOP_REASONS
    return F.coalesce(
        ((provider == "anthropic") & (stop_reason == a))
        | ((provider == "openai") & (stop_reason == b)),
        F.lit(False),
    )


def classified_calls(calls: DataFrame) -> DataFrame:
    return calls.select(
        "*",
        classify_call_error(F.col("exc_type"), F.col("error_code"), F.col("status_code"),
                            F.col("message")).alias("outcome"),
    )


# Error type of a failed attempt that names none, and error of a task without any attempt
# within the limit.
UNKNOWN_ERROR = "Error"
NO_ALLOWED_ATTEMPT = "no attempt within the retry limit"


def reduce_calls(calls: DataFrame, retries: int = 2) -> DataFrame:
    """One record per task from its attempt log (attempts numbered from 1).

    Attempts after the (retries + 1)-th cannot have happened: they do not decide, and their
    number is returned as ``ignored_attempts``. A task that has only such attempts is kept as
    a violation: not ok, with an error that says so. The deciding
    attempt is the first that succeeds or fails terminally, or else the last allowed one;
    a log that stops earlier is decided by its last attempt. A failure's error text is
    ``type: message`` with the message cut to 300 characters; the latency is the deciding
    attempt's. One aggregate per task key (min_by / max_by), no window; its rows carry an
    error's cut text, not the whole message."""
    error = F.concat(F.coalesce("exc_type", F.lit(UNKNOWN_ERROR)), F.lit(": "),
                     F.substring(F.coalesce("message", F.lit("")), 1,
                                 V.CALL_ERROR_MESSAGE_CHARS))
    c = classified_calls(calls).select(
        *TASK_KEY, "attempt", "outcome",
        F.when(F.col("outcome") != "ok", error).alias("error"), "latency_s",
        F.when(F.col("outcome") == "ok", F.col("stop_reason")).alias("stop_reason"),
        truncated_flag(F.col("provider"), F.col("stop_reason")).alias("truncated"))
    allowed = F.col("attempt") <= retries + 1
    deciding = allowed & ((F.col("outcome") != "transient") | (F.col("attempt") == retries + 1))
    rec = F.struct("attempt", "outcome", "error", "latency_s", "stop_reason", "truncated")
    agg = c.groupBy(*TASK_KEY).agg(
        F.min_by(rec, F.when(deciding, F.col("attempt"))).alias("first_decisive"),
        F.max_by(rec, F.when(allowed, F.col("attempt"))).alias("last_allowed"),
        F.count_if(allowed).alias("attempts"),
        F.count_if(~allowed).alias("ignored_attempts"),
    )
    none_allowed = F.col("attempts") == 0
    d = F.coalesce(F.col("first_decisive"), F.col("last_allowed"))
    ok = ~none_allowed & (d["outcome"] == "ok")
    return agg.select(
        *TASK_KEY,
        ok.alias("ok"),
        F.when(none_allowed, F.lit(NO_ALLOWED_ATTEMPT)).when(~ok, d["error"]).alias("error"),
        F.round(d["latency_s"], 3).alias("latency_s"),
        F.when(ok, d["stop_reason"]).alias("stop_reason"),
        (ok & d["truncated"]).alias("truncated"),
        d["attempt"].alias("deciding_attempt"),
        "attempts",
        "ignored_attempts",
    )


def response_assemble(parts: DataFrame) -> DataFrame:
    """Per response, the text blocks joined in order, and the thinking blocks joined
    (NULL when there are none). One group per response, bounded by its blocks."""
    ordered = F.array_sort(F.collect_list(F.struct("part_idx", "type", F.coalesce("text", F.lit("")).alias("text"))))
    g = parts.groupBy("response_id").agg(ordered.alias("p"))

    def joined(kind: str) -> Column:
        return F.array_join(F.transform(F.filter("p", lambda x: x["type"] == kind),
                                        lambda x: x["text"]), "")

    thinking = joined("thinking")
    return g.select(
        "response_id",
        joined("text").alias("text"),
        F.when(thinking != "", thinking).alias("thinking"),
    )
