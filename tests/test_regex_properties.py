"""The Java forms of the patterns find exactly what Python's ``re`` finds with the plain
patterns, on random texts built from tricky fragments (CRLF, U+2028, separators,
non-ASCII letters and numbers, four-backtick fences, mixed case)."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from namewatch import fixed_values as V

FRAGS = ["é", "é", "²", "Ⅻ", "ा", "_x", "\x1c", "\x1d", "\x0b", "\x85", " ", " ",
         "import os", "import a.b as c, d", "from x.y import z", "from . import q", "def f(",
         "class K", "const a = require('m')", "import x from 'y'", "import {a} from \"b\"",
         "export * from 'c'", "await import('d')", "pip install r", "npm i e@1",
         "$ pip3 install f", "uv add g", "PIP INSTALL h", "```", "```py", "```python:u.py",
         "````", "# file: a.py", "## src/b.PY", "\n", "\n", "\n", "\r\n", " ", "\t", "x", "=>",
         "function(", ";", "#", "`", "&", "|", "ß", "ǅ", "requests==2", "celery[redis, msgpack]",
         "-r req.txt", "K", "ſ"]
GROUPS = {"FENCE": 1, "FILE_DECL": 1, "PY_IMPORT": 1, "PY_FROM": 1, "PY_INSTALL": 1,
          "JS_REQUIRE": 1, "JS_IMPORT_FROM": 1, "JS_IMPORT_BARE": 1, "JS_IMPORT_DYNAMIC": 1,
          "JS_EXPORT_FROM": 1, "JS_INSTALL": 1, "REQ_LINE": 1}
_FLAGS = {"m": re.M, "s": re.S, "i": re.I}


def _py(name: str) -> re.Pattern:
    pattern, flags = V.PATTERNS[name]
    f = 0
    for ch in flags:
        f |= _FLAGS[ch]
    return re.compile(pattern, f)


def test_java_forms_match_python(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(FRAGS) for _ in range(rnd.randint(1, 18))) for _ in range(1500)]
    names = [n for n in V.PATTERNS]
    cols = [F.regexp_extract_all("t", F.lit(V.java_form(n)), F.lit(GROUPS.get(n, 0)))
            .alias(n) for n in names]
    cols.append(F.regexp_extract_all("t", F.lit(V.FENCE), F.lit(2)).alias("FENCE_BODY"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r["i"]: r for r in df.select("i", *cols).collect()}
    bad = []
    for i, t in enumerate(texts):
        for n in names:
            want = [m.group(GROUPS.get(n, 0)) for m in _py(n).finditer(t)]
            if rows[i][n] != want:
                bad.append((n, t, rows[i][n], want))
        if rows[i]["FENCE_BODY"] != [m.group(2) for m in _py("FENCE").finditer(t)]:
            bad.append(("FENCE_BODY", t))
    assert not bad, bad[:3]
