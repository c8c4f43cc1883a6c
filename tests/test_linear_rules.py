"""Text rules take time in proportion to the text, whatever repeats in it: every pattern and
rule over pumped texts of 200,000 characters."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from namewatch import fixed_values as V
from namewatch.functions import text as TX
from namewatch.operators import candidates as C

SIZE = 200_000
# What a pattern repeats: pumped alone, after each head, and before each tail.
PUMPS = [" ", "\t", "\n", "a", ".", "a.", "$", "$ ", "(", ")", "'", "\"", "[", "`", "```\n", "#",
         "# ", ":", ";", ",", "as ", " as", "/", "-", "=", "\\\"", "import ", "import\n", "from ",
         "from x ", "require(", "require('", "pip ", "pip install ", "npm i ", "let ", "let a ",
         "def ", "file:", ".py ", "a.py", "NaN", "x\u2028", "- ", "@a/", "_"]
HEADS = ["", "```", "```py\n", "import", "import ", "import a from", "from", "from ", "from .",
         "require(", "require('", "const", "let a", "def", "pip install", "pip", "$", "npm i ",
         "# file", "# ", "a", "export", "{\"", "-r"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Pumped texts, many to a task."""
    path = f"{tmp_path_factory.mktemp('pumped')}/texts"
    rows = [(head, pump, "!") for pump in PUMPS for head in HEADS]
    parts = spark.createDataFrame(rows, "head string, pump string, tail string").repartition(64)
    body = F.expr(f"repeat(pump, cast({SIZE} / length(pump) as int))")
    parts.select("head", F.concat("head", body, "tail").alias("t")).write.parquet(path)
    return spark.read.parquet(path)


def _in_time(df, columns) -> None:
    """All rules over all texts: about 1,000 texts, in the time that one quadratic rule would
    take for a few of them."""
    began = time.perf_counter()
    df.select(*columns).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 15 * len(columns)


@pytest.mark.parametrize("names", [list(V.PATTERNS)[i::4] for i in range(4)], ids=str)
def test_patterns_are_linear(spark, texts, names):
    _in_time(texts, [F.regexp_count("t", F.lit(V.java_form(n))).alias(n) for n in names])


def test_token_rules_are_linear(spark, texts):
    t = F.col("t")
    # each token of a text goes through a dozen rules, so fewer texts
    _in_time(texts.where(F.col("head").isin("", "a")).repartition(64), [TX.ustrip(t).alias("strip"), TX.peel(t).alias("peel"),
                            TX.clean_install_token(t).alias("clean"),
                            TX.normalise_python(t).alias("norm"),
                            TX.js_package_root(t).alias("root"),
                            F.size(C.import_targets(t)).alias("targets"),
                            F.size(TX.install_tokens(t, F.lit(True))).alias("tokens"),
                            F.length(C.json_finite(t)).alias("json")])


@pytest.mark.parametrize("pump, head, rule", [
    (" ", "import", "UNTAGGED_JS_IMPORT"), (".", "from ", "PY_FROM"), ("a", "```", "FENCE"),
    (" ", "a", "PY_AS_SPLIT"), (" ", "a", "STRIP")])
def test_known_bad_cases(spark, pump, head, rule):
    """Texts that the plain forms took minutes for."""
    df = spark.createDataFrame([(head + pump * SIZE + "!",)], "t string")
    began = time.perf_counter()
    df.select(F.regexp_count("t", F.lit(V.java_form(rule)))).collect()
    assert time.perf_counter() - began < 2


def test_peel_of_inner_brackets(spark):
    df = spark.createDataFrame([("a" + "(" * SIZE + "b)]",)], "t string")
    began = time.perf_counter()
    assert len(df.select(TX.peel(F.col("t"))).first()[0]) == SIZE + 2
    assert time.perf_counter() - began < 2
