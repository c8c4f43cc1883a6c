"""Extraction rules, one small response for each, with the names it must give.

All responses run as one job. Vocabularies are small and made up.
"""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from namewatch.functions import text as TX
from namewatch.operators import candidates as C
from namewatch.operators import extract as X

STDLIB = {"os", "re", "json"}
BUILTINS = {"fs", "path"}
ALIASES = {"cv2": "opencv-python", "yaml": "pyyaml"}


def fence(tag, *lines):
    return "\n".join([f"```{tag}", *lines, "```", ""])


PY, JS = "python", "javascript"
# rule, scope, response, names that it mentions, names that it filters by reason
CASES = [
    ("C1", PY, fence("py", "import orchid"), {"orchid"}, {}),
    ("C2", PY, fence("py", "import orchid as o, lily.stem as s , tulip"),
     {"orchid", "lily", "tulip"}, {}),
    ("C3", PY, fence("python3", "from orchid.root import tip"), {"orchid"}, {}),
    ("C3 relative", PY, fence("py", "from .bed import soil", "from ..plot import row"), set(),
     {"relative": {".bed", "..plot"}}),
    ("C4", PY, fence("bash", "pip install rose1", "pip3 install rose2",
                     "python -m pip install rose3", "uv pip install rose4", "uv add rose5",
                     "poetry add rose6", "pipenv install rose7", "conda install rose8"),
     {f"rose{i}" for i in range(1, 9)}, {}),
    ("C5", PY, fence("requirements", "daisy==1.0", "# note", "", "-e .", "Fern[x]>=2 ; y"),
     {"daisy", "fern"}, {}),
    ("X8 pinned", PY, fence("txt", "daisy==1.0", "fern"), {"daisy", "fern"}, {}),
    ("X8 plain", PY, fence("txt", "daisy", "fern"), set(), {}),
    ("C6", JS, fence("js", "const m = require('moss');"), {"moss"}, {}),
    ("C7", JS, fence("ts", 'import a, { b } from "moss/leaf";'), {"moss"}, {}),
    ("C8", JS, fence("mjs", "import 'lichen';"), {"lichen"}, {}),
    ("C9", JS, fence("js", "const m = await import('@peat/bog/deep');"), {"@peat/bog"}, {}),
    ("C10", JS, fence("js", "export { a } from 'sedge';", "export * from 'reed'"),
     {"sedge", "reed"}, {}),
    ("C11", JS, fence("sh", "npm install oak1", "npm i oak2", "npm add oak3", "yarn add oak4",
                      "pnpm add oak5", "pnpm i oak6", "bun add oak7", "bun install oak8"),
     {f"oak{i}" for i in range(1, 9)}, {}),
    ("C12", JS, fence("json", '{"name": "x", "dependencies": {"elm": "1", "Ash": "*"},',
                      '"devDependencies": {"yew": "^2"}, "peerDependencies": {"box": "3"},',
                      '"optionalDependencies": {"fir": "4"}, "scripts": {"pine": "5"}}'),
     {"elm", "ash", "yew", "box", "fir"}, {}),
    ("C12 broken", JS, fence("json", '{"dependencies": {"elm": "1"}'), set(), {}),
    ("C12 no object", JS, fence("json", '{"dependencies": ["elm"]}'), set(), {}),
    ("K2", PY, fence("sh", "pip install 'rose', (\"lily\") `tulip`!"), {"rose"}, {}),
    ("K4", JS, fence("sh", "npm i @peat/bog@1.2 @peat/ @fen"), {"@peat/bog"}, {}),
    ("K5", PY, fence("sh", "pip install rose==1 lily[big]>=2 tulip~=3 iris@ok"),
     {"rose", "lily", "tulip", "iris"}, {}),
    ("K5 paths", PY, fence("sh", "pip install ./rose /lily ~tulip https://iris.example -q"),
     set(), {}),
    ("K6", PY, fence("sh", "pip install rose list.txt script.PY zope.event"),
     {"rose", "zope-event"}, {}),
    ("K7", PY, fence("sh", "pip install rose your-package MyTool 123 4.5"), {"rose"}, {}),
    ("K8", PY, "To begin, pip install rose lily and then pray", {"rose", "lily"}, {}),
    ("K8 code", PY, fence("sh", "pip install rose and lily"), {"rose", "and", "lily"}, {}),
    ("K9", PY, fence("sh", "pip install -r list rose -i -c lily # iris",
                     "pip install tulip (see docs) aster"),
     {"rose", "lily", "tulip"}, {}),
    ("K11", PY, fence("sh", "pip install Big_Rose.Bush--x"), {"big-rose-bush-x"}, {}),
    ("K12", JS, fence("sh", "npm i Moss_Ball"), {"moss_ball"}, {}),
    ("K13", JS, fence("js", "require('moss/a/b'); require('https://x.example/y');"), {"moss"},
     {"relative": {"https://x.example/y"}}),
    ("K15 stdlib", PY, fence("py", "import os.path, orchid", "from __future__ import x"),
     {"orchid"}, {"stdlib": {"os", "__future__"}}),
    ("K15 malformed", PY, fence("py", "import _"), set(), {"malformed": {"_"}}),
    ("K16", JS, fence("js", "require('./own'); require('fs'); require('node:path');",
                      "require('-');"), set(),
     {"relative": {"./own"}, "builtin": {"fs", "node:path"}, "malformed": {"-"}}),
    ("K17", PY, fence("py", "import cv2, orchid"), {"opencv-python", "orchid"}, {}),
    ("X6 line", PY, "# file: src/garden.py\n" + fence("py", "import garden, orchid"), {"orchid"},
     {"declared_in_response": {"garden"}}),
    ("X6 tag", PY, fence("python:src/garden.py", "x = 1") + fence("py", "import garden"), set(),
     {"declared_in_response": {"garden"}}),
    ("X5 python", None, fence("", "import orchid", "def grow(x):", "    pass"), {"orchid"}, {}),
    ("X5 javascript", None, fence("", "const a = require('moss')", "let b = () => 1"), {"moss"},
     {}),
    ("X5 shell", None, fence("", "$ pip install rose", "npm i oak"), {"rose", "oak"}, {}),
    ("X5 none", None, fence("", "nothing to see"), set(), {}),
    ("X3 other", None, fence("rust", "use rose;", "pip install lily"), set(), {}),
    ("P6 both", None, fence("py", "import orchid") + fence("js", "require('moss')"),
     {"orchid", "moss"}, {}),
    ("P6 python", PY, fence("py", "import orchid") + fence("js", "require('moss')"), {"orchid"},
     {}),
    ("X1 empty", PY, "", set(), {}),
]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return X.Vocabulary.small(spark, STDLIB, BUILTINS, ALIASES)


def resolved(spark, vocabulary, texts):
    rows = [(i, scope, text) for i, (scope, text) in enumerate(texts)]
    df = spark.createDataFrame(rows, "response_id long, ecosystem string, response_text string")
    return X.extract_resolved(df, vocabulary).collect()


@pytest.fixture(scope="module")
def outcome(spark, vocabulary):
    out = {case[0]: (set(), {}) for case in CASES}
    for r in resolved(spark, vocabulary, [case[1:3] for case in CASES]):
        names, filtered = out[CASES[r["response_id"]][0]]
        if r["reason"] is None:
            names.add(r["name"])
        else:
            filtered.setdefault(r["reason"], set()).add(r["audit_name"])
    return out


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_rule(outcome, case):
    assert outcome[case[0]] == (case[3], case[4])


def test_fields_of_a_mention(spark, vocabulary):
    """Source, origin, raw name and alias flag; duplicates are kept; prose is marked."""
    text = fence("py", "import cv2", "import orchid") + "then pip install Orchid\n"
    rows = [r for r in resolved(spark, vocabulary, [(PY, text)]) if r["reason"] is None]
    rows.sort(key=lambda r: [r[c] for c in X.POS])
    assert [(r["raw"], r["name"], r["source"], r["origin"], r["alias_resolved"])
            for r in rows] == [
        ("cv2", "opencv-python", "import", "code_block", True),
        ("orchid", "orchid", "import", "code_block", False),
        ("Orchid", "orchid", "install", "prose", None)]


def test_loaded_vocabulary_is_used(spark, tmp_path):
    """Word lists and aliases from files decide what is filtered; the last alias wins."""
    from namewatch.sources import files as FS

    (tmp_path / "std.txt").write_text("# names\norchid\n\n orchid \n")
    (tmp_path / "node.txt").write_text("moss\n")
    (tmp_path / "alias.csv").write_text("import_name,dist_name\nlily,old\nlily,water-lily\n")
    load = lambda n: FS.load_wordlist(spark, str(tmp_path / n))
    vocab = X.Vocabulary.of(load("std.txt"), load("node.txt"),
                            FS.load_aliases(spark, str(tmp_path / "alias.csv")))
    text = fence("py", "import orchid, lily") + fence("js", "require('moss')")
    got = {(r["reason"], r["name"]) for r in resolved(spark, vocab, [(None, text)])}
    assert got == {("stdlib", "orchid"), (None, "water-lily"), ("builtin", "moss")}


# -- hostile sizes ---------------------------------------------------------------------------


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    start = time.perf_counter()
    out = row.select(column.alias("out")).first()["out"]
    return out, time.perf_counter() - start


@pytest.mark.parametrize("value", ["x" * 1_000_000, r"\n" * 100_000, r"\\" * 100_000])
def test_long_manifest_strings(spark, value):
    body = f'{{"description": "{value}", "dependencies": {{"elm": "1"}}}}'
    out, seconds = one(spark, C.manifest_dependency_names(F.col("body")), body=body)
    assert out[0]["names"] == ["elm"] and seconds < 20


def test_many_blank_lines(spark):
    body = "\n" * 16_000 + "import orchid\n" + " \t\n" * 16_000 + "  def grow(x):\n"
    out, seconds = one(spark, TX.infer_untagged(F.col("body")), body=body)
    assert out == "python" and seconds < 10


def test_many_install_tokens(spark):
    args = " ".join(f"rose{i} -r skip{i}" for i in range(30_000)) + " # iris"
    out, seconds = one(spark, TX.install_tokens(F.col("args"), F.lit(False)), args=args)
    assert out == [f"rose{i}" for i in range(30_000)] and seconds < 10


def test_install_token_order(spark):
    """Flags take the next token whatever it is; the end marks count only outside of that."""
    table = {
        "": [], "-r": [], "-r -r rose": ["rose"], "-r # rose": ["rose"], "rose # lily": ["rose"],
        "rose #lily": ["rose"], "(rose lily": [], "-c (x rose": ["rose"],
        "--index-url http://x rose": ["rose"], "--index-urls rose": ["rose"],
        "rose -r\tlist lily": ["rose", "lily"], "x-r list": ["x-r", "list"],
        "-rlist rose": ["rose"],
    }
    rows = spark.createDataFrame([(a,) for a in table], "a string")
    got = {r["a"]: r["t"] for r in rows.select(
        "a", TX.install_tokens(F.col("a"), F.lit(False)).alias("t")).collect()}
    assert got == table
    prose = {"rose and lily": ["rose"], "The rose": [], "rose -r and lily": ["rose", "lily"],
             "rose, then lily": ["rose"]}
    rows = spark.createDataFrame([(a,) for a in prose], "a string")
    got = {r["a"]: r["t"] for r in rows.select(
        "a", TX.install_tokens(F.col("a"), F.lit(True)).alias("t")).collect()}
    assert got == prose
