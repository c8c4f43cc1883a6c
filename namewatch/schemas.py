"""Declared schemas. Inference is never used: it breaks when every ``packages`` list is
empty or every ``alias_resolved`` is null."""

from __future__ import annotations

from pyspark.sql import types as T

PACKAGE = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ecosystem", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("alias_resolved", T.BooleanType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("prompt_id", T.StringType()),
        T.StructField("ecosystem", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("specificity", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("model_alias", T.StringType()),
        T.StructField("resolved_model", T.StringType()),
        T.StructField("run_index", T.LongType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("latency_s", T.DoubleType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("stop_reason", T.StringType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("params_sent", T.StringType()),
        T.StructField("packages", T.ArrayType(PACKAGE)),
        T.StructField("extraction_notes", T.ArrayType(T.StringType())),
        T.StructField("response_text", T.StringType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("ecosystem", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("checked_at", T.TimestampType()),
        T.StructField("from_cache", T.BooleanType()),
        T.StructField("snapshot_at", T.TimestampType()),
    ]
)

PROMPTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ecosystem", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("specificity", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

MODELS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    ]
)

MODULE_NAMES = T.StructType(
    [T.StructField("language", T.StringType()), T.StructField("name", T.StringType())]
)

ALIASES = T.StructType(
    [T.StructField("import_name", T.StringType()), T.StructField("dist_name", T.StringType())]
)

ATTEMPTS = T.StructType(
    [
        T.StructField("ecosystem", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("detail", T.StringType()),
        T.StructField("checked_at", T.TimestampType()),
    ]
)

CALLS = T.StructType(
    [
        T.StructField("call_id", T.LongType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("prompt_id", T.StringType()),
        T.StructField("run_index", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("provider", T.StringType()),
        T.StructField("exc_type", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("stop_reason", T.StringType()),
        T.StructField("latency_s", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

LOOKUP_CACHE = T.StructType(
    [
        T.StructField("ecosystem", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("detail", T.StringType()),
        T.StructField("checked_at", T.TimestampType()),
    ]
)
