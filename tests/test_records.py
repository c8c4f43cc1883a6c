"""Record assembly and re-extraction on a few made-up calls."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from namewatch import fixed_values as V
from namewatch import schemas
from namewatch.operators import extract as X
from namewatch.operators import records as RC

CODE = "```py\nimport orchid, os\n```\nthen pip install lily\n"


@pytest.fixture(scope="module")
def built(spark):
    calls = spark.createDataFrame(
        [(1, "q1", "m1", True, None, CODE), (2, "q1", "m1", False, "E: x", None),
         (3, "gone", "gone", True, None, "```py\nimport tulip\n```\n"), (4, "q1", "m1", True,
                                                                        None, "")],
        "response_id long, prompt_id string, model_id string, ok boolean, error string, "
        "response_text string").withColumns({
            "run_id": F.lit("s"), "resolved_model": F.lit("v"), "run_index": F.lit(0).cast("long"),
            "created_at": F.lit(dt.datetime(2024, 1, 1)), "latency_s": F.lit(1.23456),
            "input_tokens": F.lit(1).cast("long"), "output_tokens": F.lit(2).cast("long"),
            "stop_reason": F.lit("end"), "truncated": F.lit(False), "params_sent": F.lit("{}")})
    prompts = spark.createDataFrame([("q1", "python", "d", "vague")],
                                    "id string, ecosystem string, domain string, "
                                    "specificity string")
    models = spark.createDataFrame([("m1", "alias")], "id string, model string")
    vocab = X.Vocabulary.small(spark, {"os"}, set(), {})
    return RC.build_records(calls, prompts, models, vocab)


def test_full_record(built):
    assert built.columns == ["response_id", *schemas.RUNS.names]
    rows = {r["response_id"]: r for r in built.collect()}
    first = rows[1]
    assert [p["name"] for p in first["packages"]] == ["orchid", "lily"]
    assert first["extraction_notes"] == [V.PROSE_NOTE]
    assert (first["domain"], first["model_alias"], first["latency_s"]) == ("d", "alias", 1.235)
    assert rows[2]["packages"] == [] and rows[2]["error"] == "E: x"
    # prompt and model have left the corpus: the record stays, and both languages are read
    assert rows[3]["ecosystem"] is None and rows[3]["model_alias"] is None
    assert [p["name"] for p in rows[3]["packages"]] == ["tulip"]
    assert rows[4]["packages"] == [] and rows[4]["extraction_notes"] == []


def test_reextraction_rewrites_only_what_has_a_text(spark, built):
    stored = built.withColumns({
        "packages": F.expr("array(named_struct('raw', 'x', 'name', 'kept', 'ecosystem', 'python', "
                           "'source', 'import', 'origin', 'code_block', 'alias_resolved', true))"),
        "extraction_notes": F.array(F.lit("old"))})
    again = RC.reextract(stored, X.Vocabulary.small(spark, set(), set(), {}))
    rows = {r["response_id"]: ([p["name"] for p in r["packages"]], r["extraction_notes"])
            for r in again.collect()}
    assert rows == {1: (["orchid", "os", "lily"], [V.PROSE_NOTE]), 2: (["kept"], ["old"]),
                    3: (["tulip"], []), 4: (["kept"], ["old"])}
    diff = RC.reextraction_diff(stored, again).first().asDict()
    assert diff == {"records": 4, "changed": 2, "packages_before": 2, "packages_after": 4}


def test_rows_and_joins_agree(spark, monkeypatch):
    """What is worked out inside the row equals the joined form, which larger vocabularies
    take: packages, notes, audit, names."""
    from namewatch.plans import record_queries
    from namewatch.sources import fixtures as FX
    from tests.conftest import SF_SMALL

    odd = [(10_000, None, None), (10_001, "python", ""), (10_002, None, "```py\nimport a, a\n```"),
           (10_003, None, "```js\nrequire('b')\n```\n```py\nimport os, b, .c\n```\nnpm i d")]
    responses = FX.responses(spark, SF_SMALL).unionByName(spark.createDataFrame(
        odd, "response_id long, ecosystem string, response_text string"))

    def everything():
        vocab = X.Vocabulary.default(spark)
        vocab = X.Vocabulary(vocab.module_names, vocab.aliases)     # as loaded from files
        out = [X.audit_rows(responses, vocab), X.note_rows(responses, vocab),
               X.name_rows(responses, vocab), record_queries._built(spark, SF_SMALL, vocab)]
        return vocab, [sorted(map(repr, df.collect())) for df in out]

    vocab, inside = everything()
    assert vocab.inline() is not None
    monkeypatch.setattr(X, "INLINE_WORDS", 10)
    vocab, joined = everything()
    assert vocab.inline() is None
    assert inside == joined and all(inside)


def test_incremental_reextraction_equals_full(spark):
    """Only records that hold a changed word are read again, and the result is that of a full
    re-extraction: added and removed names, changed, added and removed aliases."""
    from namewatch.plans import record_queries
    from tests.conftest import SF_SMALL

    known = X.Vocabulary.default(spark).inline()
    old = X.Vocabulary.default(spark)
    new = X.Vocabulary.small(
        spark, set(known.python) - {"os"} | {"lily"}, set(known.javascript) - {"fs"} | {"moss"},
        {**{k: v for k, v in known.aliases.items() if k != "cv2"}, "yaml": "other", "orchid": "o"})
    words = {tuple(r) for r in RC.changed_words(old, new).collect()}
    assert words == {("python", w) for w in ("os", "lily", "cv2", "yaml", "orchid")} | {
        ("javascript", "fs"), ("javascript", "moss")}
    assert RC.changed_words(old, old).count() == 0
    records = record_queries._built(spark, SF_SMALL, old)
    index = RC.vocabulary_index(records)
    changes = RC.reextract_touched(records, index, old, new)
    now = {r["response_id"]: (r["packages"], r["extraction_notes"])
           for r in RC.with_changes(records, changes).collect()}
    full = {r["response_id"]: (r["packages"], r["extraction_notes"])
            for r in RC.reextract(records, new).collect()}
    assert now == full and len(now) == records.count()
    read = {r[0] for r in changes.select("response_id").collect()}
    before = {r["response_id"]: r["packages"] for r in records.collect()}
    differ = {i for i in full if full[i][0] != before[i]}
    assert differ <= read and 0 < len(read) < len(full)
    assert RC.reextract_touched(records, index, old, old).count() == 0
