"""Engine tables derived from the driver's TPC-H-ish tables.

The driver tables hold no model responses, so the engine's inputs are derived from them
with deterministic rules (orders play responses, lineitem plays mentions, part plays the
registry, documents carry the response prose). Runs, mentions, attempts and responses grow
with their source tables; names, prompts, models and run indexes are folded by a modulus, so
those dimensions stay small at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _padded(prefix: str, value: Column, width: int) -> Column:
    digits = value.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run record per order: the experimental cell and the call outcome."""
    o = read_table(spark, sf_dir, "orders")
    cust = F.col("o_custkey")
    key = F.col("o_orderkey")
    prompt_no = cust % 50
    return o.select(
        key.alias("response_id"),
        F.concat(F.lit("sweep-"), (key % 3).cast("string")).alias("run_id"),
        _padded("prompt-", prompt_no, 2).alias("prompt_id"),
        F.when(cust % 2 == 0, "python").otherwise("javascript").alias("ecosystem"),
        F.concat(F.lit("domain-"), (cust % 5).cast("string")).alias("domain"),
        F.when(prompt_no % 3 == 0, "vague")
        .when(prompt_no % 3 == 1, "detailed")
        .otherwise("niche")
        .alias("specificity"),
        F.concat(F.lit("model-"), (cust % 4).cast("string")).alias("model_id"),
        (key % 20).alias("run_index"),
        (F.col("o_orderpriority") != "5-LOW").alias("ok"),
        (key % 11 == 0).alias("truncated"),
        F.col("o_orderdate").alias("created_at"),
    )


def mentions(spark: SparkSession, sf_dir: str, name_modulus: int = 400) -> DataFrame:
    """One mention per line item of a successful run (the `mentions` view's columns plus
    the run key). ``alias_resolved`` is three-valued: set for Python imports only."""
    r = runs(spark, sf_dir).filter("ok")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", "l_returnflag"
    )
    k = F.col("l_partkey") % name_modulus
    return r.join(li, r.response_id == li.l_orderkey, "inner").select(
        *[F.col(c) for c in r.columns],
        F.col("l_linenumber").alias("mention_idx"),
        _padded("pkg-", k, 3).alias("name"),
        F.when(F.col("l_linestatus") == "O", "import").otherwise("install").alias("source"),
        F.when(F.col("l_returnflag") == "R", "prose").otherwise("code_block").alias("origin"),
        F.when(
            (F.col("ecosystem") == "python") & (F.col("l_linestatus") == "O"), k % 3 != 0
        ).alias("alias_resolved"),
    )


def names(spark: SparkSession, sf_dir: str, name_modulus: int = 400) -> DataFrame:
    """Registry snapshot: one status per (ecosystem, name). One name in 20 is absent, so
    it stays unchecked (NULL after the join), which is what invariant I1 is about."""
    k = F.col("k")
    part_keys = (
        read_table(spark, sf_dir, "part")
        .select((F.col("p_partkey") % name_modulus).alias("k"))
        .distinct()
    )
    return (
        part_keys.filter(k % 20 < 19)
        .select(
            F.explode(F.array(F.lit("python"), F.lit("javascript"))).alias("ecosystem"),
            _padded("pkg-", k, 3).alias("name"),
            F.when(k % 20 < 14, "exists").when(k % 20 < 18, "not_found").otherwise("error")
            .alias("status"),
        )
    )


# Template fragments of the derived response texts (one per doc_id % 20). These are test
# content, not vocabulary: each exercises one extraction rule.
_FENCE = "```"
_TEMPLATES: dict[int, list] = {
    0: [_FENCE, "python\n", "import os, cv2 as c\n", "from ghost", "#MOD7", ".sub import x\n",
        "from .rel import y\n", _FENCE, "\n"],
    1: [_FENCE, "js\n", "import x from 'lodash/merge';\n",
        "const p = require('@scope/pkg/sub');\n", "import fs from 'node:fs/promises';\n",
        _FENCE, "\n"],
    2: [_FENCE, "bash\n",
        "$ pip install -r requirements.txt Flask_SQLAlchemy 'httpx>=0.27' celery[redis]  # core\n",
        _FENCE, "\n"],
    3: [_FENCE, "json\n",
        '{"dependencies":{"express":"^4","@types/node":"20"},"devDependencies":{"zod":"3"}}\n',
        _FENCE, "\n"],
    4: [_FENCE, "requirements\n", "# pinned\n", "requests==2.31\n", "sqlite3  # built-in\n",
        "-r other.txt\n", _FENCE, "\n"],
    5: ["Just run npm install got and you are away.\n"],
    6: [_FENCE, "python:helpers.py\n", "def x(): pass\n", _FENCE, "\n", _FENCE, "python\n",
        "from helpers import x\n", "import yaml\n", _FENCE, "\n"],
    7: [_FENCE, "\n", "npm i express@4.18.2 ./local -D typescript (or yarn)\n", _FENCE, "\n"],
    8: ["First pip install rich to get started.\n", _FENCE, "python\n", "import unclosed\n"],
    10: [_FENCE, "txt\n", "daisy==1.0\n", "fern\n", _FENCE, "\n", "# file: src/garden.py\n",
         _FENCE, "py\n", "import garden, orchid, _\n", _FENCE, "\n"],
    11: [_FENCE, "mjs\n", "import 'lichen';\n", "const m = await import('@peat/bog/deep');\n",
         "export { a } from 'sedge';\n", "require('./own'); require('-');\n", _FENCE, "\n"],
    12: [_FENCE, "sh\n", "uv add rose5\n", "poetry add rose6\n", "conda install rose8\n",
         "pip install list.txt your-package 123 -c pins rose9 (soon)\n", _FENCE, "\n"],
    13: [_FENCE, "sh\n", "npm i @peat/bog@1.2 @fen\n", "yarn add oak4\n", "pnpm add oak5\n",
         "bun add oak7\n", _FENCE, "\n"],
    14: [_FENCE, "\n", "\n", "import orchid\n", "def grow(x):\n", _FENCE, "\n"],
    15: [_FENCE, "\n", "const a = require('moss')\n", "let b = () => 1\n", _FENCE, "\n"],
    16: [_FENCE, "py\n", "import os, sys, re, json\n", "from .a import b\n",
         "from ..c import d\n", "import os\n", "import lily as l\n", _FENCE, "\n"],
    17: [_FENCE, "json\n",
         '{"peerDependencies":{"box":"3"},"optionalDependencies":{"fir":"4"},"name":"x"}\n',
         _FENCE, "\n"],
    18: [_FENCE, "rust\n", "pip install unseen\n", _FENCE, "\n",
         "Then pip install lily and pray.\n"],
    19: [_FENCE, "js\n", "const f = require('fs'), p = require('node:path');\n",
         "require('../x'); require('https://x.example/y');\n",
         "import z from 'moss/leaf/deep';\n", _FENCE, "\n"],
}


def _template(parts: list, doc_id: Column) -> Column:
    cols = [(doc_id % 7).cast("string") if p == "#MOD7" else F.lit(p) for p in parts]
    return F.concat(*cols)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses: a document's whole text, a newline, then one code template.
    Even doc ids are Python prompts, odd ones JavaScript."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    doc_id = F.col("doc_id")
    tail = F.lit("")
    for k in sorted(_TEMPLATES, reverse=True):
        tail = F.when(doc_id % 20 == k, _template(_TEMPLATES[k], doc_id)).otherwise(tail)
    return d.select(
        doc_id.alias("response_id"),
        F.when(doc_id % 2 == 0, "python").otherwise("javascript").alias("ecosystem"),
        F.concat(F.col("text"), F.lit("\n"), tail).alias("response_text"),
    )


# ------------------------------------------------------------------ sweep and lookup inputs
# A total order of the line items of one order (line numbers alone repeat).
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``attempt``, numbered within an order. Texts are derived afterwards: in
    one select with the window they would be exchanged and sorted with the lines."""
    return lines.withColumn("attempt", F.row_number().over(
        Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("int"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep's prompt dimension: one prompt per customer group (custkey mod 50), with
    the attributes the run records carry; ``ord`` is file-then-entry order."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 50
    g = c.groupBy(k.alias("k")).agg(
        F.min("c_name").alias("first_name"), F.min("c_mktsegment").alias("segment")
    )
    kk = F.col("k")
    eco = F.when(kk % 2 == 0, "python").otherwise("javascript")
    return g.select(
        _padded("prompt-", kk, 2).alias("id"),
        eco.alias("ecosystem"),
        F.concat(F.lit("domain-"), (kk % 5).cast("string")).alias("domain"),
        F.when(kk % 3 == 0, "vague").when(kk % 3 == 1, "detailed").otherwise("niche")
        .alias("specificity"),
        F.concat(F.lit("Write a "), F.lower("segment"), F.lit(" tool for "), F.col("first_name"))
        .alias("text"),
        F.concat(eco, F.lit(".yaml")).alias("file"),
        kk.alias("ord"),
    )


def prompt_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw prompt corpus as it would be loaded from files, one entry per customer, with
    the defects the corpus checks look for (missing fields, unknown enums, blank text,
    ids reused across entries)."""
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    eco = (
        F.when(F.col("c_mktsegment") == "BUILDING", "rust")
        .when(key % 2 == 0, "python")
        .otherwise("javascript")
    )
    prefix = F.when(key % 2 == 0, "py").otherwise("js")
    return c.select(
        F.concat(prefix, F.lit("-"), (key % 1000).cast("string")).alias("id"),
        eco.alias("ecosystem"),
        F.lower("c_mktsegment").alias("domain"),
        F.when(F.col("c_nationkey") % 4 == 0, "vague")
        .when(F.col("c_nationkey") % 4 == 1, "detailed")
        .when(F.col("c_nationkey") % 4 == 2, "niche")
        .alias("specificity"),
        F.when(F.col("c_acctbal") < 0, F.lit("   "))
        .otherwise(F.concat(F.lit("  Write a tool for "), F.col("c_name"), F.lit(" \n")))
        .alias("text"),
        F.concat(F.when(key % 2 == 0, "python").otherwise("javascript"), F.lit(".yaml"))
        .alias("file"),
        key.alias("ord"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model dimension: the models that appear in the orders (custkey mod 4); model 3 is
    disabled."""
    o = read_table(spark, sf_dir, "orders")
    n = F.col("n")
    return (
        o.select((F.col("o_custkey") % 4).alias("n"))
        .distinct()
        .select(
            F.concat(F.lit("model-"), n.cast("string")).alias("id"),
            F.when(n % 2 == 0, "anthropic").otherwise("openai").alias("provider"),
            F.concat(F.lit("alias-"), n.cast("string")).alias("model"),
            (n < 3).alias("enabled"),
            F.create_map(F.lit("max_tokens"), F.lit("8192")).alias("params"),
        )
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry lookup log: every line item is one GET for the name of its part, in the
    ecosystem of its order's parity; the outcome comes from the line's flags."""
    li = _numbered(read_table(spark, sf_dir, "lineitem"))
    code = (F.col("l_partkey") + F.col("l_suppkey")) % 10
    status = (
        F.when(code <= 4, 200)
        .when(code <= 6, 404)
        .when(code == 7, 429)
        .when(code == 8, F.when(F.col("l_returnflag") == "R", 403).otherwise(503))
        .otherwise(F.lit(None))
    )
    return li.select(
        F.when(F.col("l_orderkey") % 2 == 0, "python").otherwise("javascript").alias("ecosystem"),
        _padded("pkg-", F.col("l_partkey") % 400, 3).alias("name"),
        "attempt",
        status.cast("int").alias("http_status"),
        F.when(status.isNull(), F.lit("ConnectTimeout: timed out"))
        .otherwise(F.concat(F.lit("HTTP "), status.cast("string"))).alias("detail"),
        F.col("l_shipdate").alias("checked_at"),
        F.col("l_orderkey").alias("batch"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model call log: each order is one sweep task (its run keys), each of its line items
    one attempt; the error class comes from the line's part and supplier keys."""
    r = runs(spark, sf_dir).select("response_id", "model_id", "prompt_id", "run_index")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity",
        "l_extendedprice", "l_shipdate",
    )
    j = _numbered(r.join(li, r.response_id == li.l_orderkey, "inner"))
    code = F.col("l_partkey") % 10
    status = (
        F.when(code == 0, 429).when(code == 1, 503).when(code == 2, 400).when(code == 3, 401)
        .when(code == 4, 500).when(code == 5, 408).otherwise(F.lit(None))
    ).cast("int")
    exc = (
        F.when(status == 429, "RateLimitError").when(status.isin(500, 503), "InternalServerError")
        .when(status == 408, "APITimeoutError").when(status == 400, "BadRequestError")
        .when(status == 401, "AuthenticationError")
    )
    quota = (status == 429) & (F.col("l_suppkey") % 3 == 0)
    provider = F.when(F.col("model_id").isin("model-0", "model-2"), "anthropic").otherwise("openai")
    message = F.when(
        quota & (F.col("l_suppkey") % 2 == 0),
        F.lit("Error code: 429 - {'error': {'code': 'insufficient_quota'}}"),
    ).when(status.isNotNull(), F.concat(F.lit("Error code: "), status.cast("string"),
                                        F.lit(" - request failed")))
    stop = F.when(status.isNull(),
                  F.when(F.col("l_returnflag") == "R",
                         F.when(provider == "anthropic", "max_tokens").otherwise("length"))
                  .otherwise(F.when(provider == "anthropic", "end_turn").otherwise("stop")))
    return j.select(
        F.col("response_id").alias("call_id"),
        "model_id", "prompt_id", "run_index",
        "attempt",
        provider.alias("provider"),
        exc.alias("exc_type"),
        F.when(quota & (F.col("l_suppkey") % 2 == 1), F.lit("insufficient_quota")).alias("error_code"),
        status.alias("status_code"),
        message.alias("message"),
        stop.alias("stop_reason"),
        (F.col("l_quantity") / 10.0).alias("latency_s"),
        F.col("l_shipdate").alias("created_at"),
    )


def content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider content blocks: each conversation is one response, each turn one block
    (assistant turns are text, user and system turns stand in for thinking blocks)."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("response_id"),
        F.col("turn").alias("part_idx"),
        F.when(F.col("role") == "assistant", "text").otherwise("thinking").alias("type"),
        F.col("text"),
    )


def resolved_model_of(model_id: Column, created_at: Column) -> Column:
    """The version string that a provider reports back for a call, derived from the model
    alias and the call's year."""
    return F.concat(model_id, F.lit("-"), F.date_format(created_at, "yyyy"))


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls, one per document: the cell and outcome from its id, the response text
    where the call succeeded (every seventh fails)."""
    r = responses(spark, sf_dir)
    i = F.col("response_id")
    ok, long = i % 7 != 0, i % 9 == 0
    model_id = F.concat(F.lit("model-"), (i % 4).cast("string"))
    return r.select(
        "response_id",
        F.concat(F.lit("sweep-"), (i % 3).cast("string")).alias("run_id"),
        _padded("prompt-", i % 50, 2).alias("prompt_id"),
        model_id.alias("model_id"),
        F.concat(model_id, F.lit("-2024")).alias("resolved_model"),
        (i % 20).alias("run_index"),
        ok.alias("ok"),
        F.when(~ok, F.lit("Timeout: no answer")).alias("error"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
        ((i % 1000) / 7.0).alias("latency_s"),
        (i % 500).alias("input_tokens"),
        F.when(ok, F.length("response_text").cast("long")).alias("output_tokens"),
        F.when(ok, F.when(long, "max_tokens").otherwise("end_turn")).alias("stop_reason"),
        (ok & long).alias("truncated"),
        F.lit('{"max_tokens": 8192}').alias("params_sent"),
        F.when(ok, F.col("response_text")).alias("response_text"),
    )
