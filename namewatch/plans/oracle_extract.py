"""Oracle SQL (DuckDB) for the extraction queries.

The same rules as the Spark operators, restated with DuckDB's list functions and RE2
patterns (``re2`` drops the Java-only flags; the test texts are ASCII around every
token, where both engines agree). Generators are separate UNION ALL branches here:
clarity over speed, since this only has to be right.
"""

from __future__ import annotations

from namewatch import fixed_values as V
from namewatch.functions.text import re2
from namewatch.sources.fixtures import _TEMPLATES


def lit(s: str) -> str:
    """A DuckDB string literal (backslashes are literal; newlines via chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    if len(quoted) == 1:
        return quoted[0]
    out = []
    for i, q in enumerate(quoted):
        if q != "''":
            out.append(q)
        if i < len(quoted) - 1:
            out.append("chr(10)")
    return "concat(" + ", ".join(out) + ")"


def rx(pattern: str) -> str:
    return lit(re2(pattern))


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


# ------------------------------------------------------------------ responses
def _template_sql(parts) -> str:
    cols = ["CAST(doc_id % 7 AS VARCHAR)" if p == "#MOD7" else lit(p) for p in parts]
    return "concat(" + ", ".join(cols) + ")"


def responses_sql() -> str:
    cases = " ".join(f"WHEN {k} THEN {_template_sql(v)}" for k, v in sorted(_TEMPLATES.items()))
    return (
        "SELECT doc_id AS response_id, "
        "CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'javascript' END AS scope, "
        f"concat(text, chr(10), CASE doc_id % 20 {cases} ELSE '' END) AS response_text "
        "FROM documents"
    )


# ------------------------------------------------------------------ column rules
def lang_of(tag: str) -> str:
    key = f"split_part({tag}, ':', 1)"
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.LANG_ALIASES.items())
    return f"(CASE {key} {whens} ELSE 'other' END)"


def count_re(body: str, pattern: str) -> str:
    return f"len(regexp_extract_all({body}, {rx(pattern)}, 0))"


def infer(body: str) -> str:
    py = f"({count_re(body, V.UNTAGGED_PY_IMPORT)} + {count_re(body, V.UNTAGGED_PY_DEF)})"
    js = (f"({count_re(body, V.UNTAGGED_JS_REQUIRE)} + {count_re(body, V.UNTAGGED_JS_IMPORT)}"
          f" + {count_re(body, V.UNTAGGED_JS_DECL)} + {count_re(body, V.UNTAGGED_JS_FUNC)})")
    sh = count_re(body, V.UNTAGGED_SHELL)
    return (f"(CASE WHEN {sh} > 0 AND {sh} >= greatest({py}, {js}) THEN 'shell' "
            f"WHEN {py} > {js} THEN 'python' WHEN {js} > {py} THEN 'javascript' END)")


def tag_of(m: str) -> str:
    return f"lower({strip(f'regexp_extract({m}, {rx(V.FENCE)}, 1)')})"


def declared(text: str, fences: str) -> str:
    lines = (f"list_transform(regexp_extract_all({text}, {rx(V.FILE_DECL)}, 1), "
             "lambda p_: split_part(string_split(p_, '/')[-1], '.', 1))")
    tags = f"list_transform({fences}, lambda m_: {tag_of('m_')})"
    after = "substr(t_, strpos(t_, ':') + 1)"
    with_file = (f"list_filter({tags}, lambda t_: strpos(t_, ':') > 0 AND "
                 f"ends_with({after}, '.py'))")
    base = f"string_split({after}, '/')[-1]"
    mods = (f"list_transform({with_file}, lambda t_: "
            f"split_part(substr({base}, 1, length({base}) - 3), '.', 1))")
    return f"list_sort(list_distinct(list_concat({lines}, {mods})))"


PEEL_LEFT = "^[" + "".join("\\" + c if c in "[]\\^-" else c for c in V.PEEL_BOTH) + "]+"
PEEL_RIGHT = ("[" + "".join("\\" + c if c in "[]\\^-" else c for c in V.PEEL_BOTH + V.PEEL_RIGHT)
              + "]+$")
SPEC_PREFIX = "^[^" + V.SPEC_SPLIT[1:-1] + "]*"


def peel(t: str) -> str:
    return f"regexp_replace(regexp_replace({strip(t)}, {lit(PEEL_LEFT)}, ''), {lit(PEEL_RIGHT)}, '')"


def shaped(x: str) -> str:
    return f"regexp_matches({x}, {rx(V.NAME_SHAPE)})"


def clean(t: str) -> str:
    p = peel(t)
    rest = f"regexp_extract(substr({p}, strpos({p}, '/') + 1), {lit(SPEC_PREFIX)}, 0)"
    name = f"regexp_extract({p}, {lit(SPEC_PREFIX)}, 0)"
    low = f"lower({name})"
    ext = f"string_split({low}, '.')[-1]"
    return (
        f"(CASE WHEN {p} = '' OR starts_with({p}, '-') OR starts_with({p}, '.') "
        f"OR starts_with({p}, '/') OR starts_with({p}, '~') OR contains({p}, '://') "
        f"OR starts_with({p}, 'git+') THEN NULL "
        f"WHEN starts_with({p}, '@') THEN (CASE WHEN strpos({p}, '/') > 0 AND {rest} <> '' "
        f"AND {shaped(rest)} THEN concat(split_part({p}, '/', 1), '/', {rest}) END) "
        f"ELSE (CASE WHEN {name} <> '' AND {shaped(name)} "
        f"AND NOT (contains({name}, '.') AND {ext} IN {in_list(V.FILE_EXTS)}) "
        f"AND regexp_matches({name}, '[A-Za-z]') "
        f"AND {low} NOT IN {in_list(V.PLACEHOLDER_NAMES)} THEN {name} END) END)"
    )


def tokens(args: str) -> str:
    return f"list_filter(string_split_regex({args}, '\\s+'), lambda x_: x_ <> '')"


def install_tokens(args: str, prose: str) -> str:
    """K1 as list_reduce over a struct list (the accumulator has the elements' type)."""
    steps = (f"list_transform({tokens(args)}, lambda t_: {{'skip': false, 'stop': false, "
             f"'out': []::VARCHAR[], 'tok': t_, 'c': {clean('t_')}}})")
    init = ("{'skip': false, 'stop': false, 'out': []::VARCHAR[], "
            "'tok': NULL::VARCHAR, 'c': NULL::VARCHAR}")

    def st(skip, stop, out):
        return (f"{{'skip': {skip}, 'stop': {stop}, 'out': {out}, "
                "'tok': NULL::VARCHAR, 'c': NULL::VARCHAR}")

    body = (
        "CASE WHEN a_.stop THEN a_ "
        f"WHEN a_.skip THEN {st('false', 'a_.stop', 'a_.out')} "
        f"WHEN starts_with(s_.tok, '#') OR starts_with(s_.tok, '(') THEN {st('a_.skip', 'true', 'a_.out')} "
        f"WHEN s_.tok IN {in_list(V.VALUE_FLAGS)} THEN {st('true', 'a_.stop', 'a_.out')} "
        "WHEN s_.c IS NULL THEN a_ "
        f"WHEN ({prose}) AND lower(s_.c) IN {in_list(V.PROSE_STOPWORDS)} THEN {st('a_.skip', 'true', 'a_.out')} "
        f"ELSE {st('a_.skip', 'a_.stop', 'list_append(a_.out, s_.c)')} END"
    )
    return f"list_reduce({steps}, lambda a_, s_: {body}, {init}).out"


def import_targets(clause: str) -> str:
    inner = f"{strip(f'regexp_split_to_array({strip('q_')}, {rx(V.PY_AS_SPLIT)})[1]')}"
    return (f"list_filter(list_transform(string_split({clause}, ','), lambda q_: {inner}), "
            "lambda x_: x_ <> '')")


LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def requirement_lines(body: str) -> str:
    lines = f"string_split_regex({body}, {lit(LINE_BREAKS)})"
    s = strip("l_")
    kept = (f"list_filter({lines}, lambda l_: {s} <> '' AND NOT starts_with({s}, '#') "
            f"AND NOT starts_with({s}, '-'))")
    return (f"list_filter(list_transform({kept}, lambda l_: regexp_extract(l_, {rx(V.REQ_LINE)}, 1)),"
            " lambda x_: x_ <> '')")


def js_root(spec: str) -> str:
    s = strip(spec)
    parts = f"string_split({s}, '/')"
    return (
        f"(CASE WHEN {s} = '' THEN NULL WHEN starts_with({s}, '.') OR starts_with({s}, '/') THEN NULL "
        f"WHEN contains({s}, '://') THEN NULL "
        f"WHEN starts_with({s}, '@') THEN (CASE WHEN len({parts}) >= 2 AND {parts}[1] <> '@' "
        f"AND {parts}[2] <> '' THEN concat({parts}[1], '/', {parts}[2]) END) "
        f"ELSE split_part({s}, '/', 1) END)"
    )


def plausible(x: str) -> str:
    return (f"({x} IS NOT NULL AND length({x}) > 0 AND length({x}) <= {V.MAX_NAME_LENGTH} "
            f"AND {x} NOT IN ('-', '_', '.') AND regexp_matches({x}, '[a-zA-Z0-9]'))")


def norm_py(x: str) -> str:
    folded = f"regexp_replace({x}, {rx(V.PY_NORM_SEPARATORS)}, '-', 'g')"
    return f"lower({strip(folded)})"


def norm_js(x: str) -> str:
    return f"lower({strip(x)})"


def vocab_sql() -> str:
    rows = [("python", n) for n in V.PYTHON_STDLIB] + [
        ("javascript", n) for n in V.NODE_BUILTINS]
    return "SELECT * FROM (VALUES " + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in rows) + \
        ") v(language, name)"


def aliases_sql() -> str:
    rows = list(V.PYTHON_IMPORT_ALIASES.items())
    return "SELECT * FROM (VALUES " + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in rows) + \
        ") a(import_name, dist_name)"


# ------------------------------------------------------------------ the pipeline as CTEs
def _unnest(list_expr: str, value: str, idx: str) -> str:
    return f"unnest({list_expr}) AS {value}, generate_subscripts({list_expr}, 1) - 1 AS {idx}"


def pipeline_ctes() -> str:
    want_py = "(scope IS NULL OR scope = 'python')"
    want_js = "(scope IS NULL OR scope = 'javascript')"
    fence = rx(V.FENCE)
    cols = "response_id, scope, declared, section, block_idx"
    ctes = [
        f"resp AS ({responses_sql()})",
        f"f AS (SELECT response_id, scope, response_text AS text, "
        f"regexp_extract_all(response_text, {fence}, 0) AS fences FROM resp)",
        f"g AS (SELECT response_id, scope, fences, "
        f"regexp_replace(text, {fence}, chr(10), 'g') AS prose, "
        f"{declared('text', 'fences')} AS declared FROM f)",
        f"blk AS (SELECT response_id, scope, declared, {_unnest('fences', 'm', 'block_idx')} FROM g)",
        f"blk2 AS (SELECT response_id, scope, declared, block_idx, {tag_of('m')} AS tag, "
        f"regexp_extract(m, {fence}, 2) AS body FROM blk)",
        f"units AS (SELECT response_id, scope, declared, 0 AS section, block_idx, tag, "
        f"CASE WHEN {lang_of('tag')} = 'untagged' THEN {infer('body')} ELSE {lang_of('tag')} END AS kind, "
        f"body FROM blk2 UNION ALL SELECT response_id, scope, declared, 1 AS section, 0 AS block_idx, "
        f"NULL AS tag, 'prose' AS kind, prose AS body FROM g)",
        # python imports
        f"pyi0 AS (SELECT {cols}, {_unnest(f'regexp_extract_all(body, {rx(V.PY_IMPORT)}, 1)', 'clause', 'match_idx')} "
        f"FROM units WHERE {want_py} AND kind = 'python')",
        f"pyi AS (SELECT {cols}, 'python' AS ecosystem, 0 AS rule, match_idx, "
        f"{_unnest(import_targets('clause'), 'raw', 'item_idx')}, 'import' AS source, true AS is_import FROM pyi0)",
        f"pyf AS (SELECT {cols}, 'python' AS ecosystem, 1 AS rule, "
        f"{_unnest(f'regexp_extract_all(body, {rx(V.PY_FROM)}, 1)', 'raw', 'match_idx')}, 0 AS item_idx, "
        f"'import' AS source, true AS is_import FROM units WHERE {want_py} AND kind = 'python')",
        f"pyn0 AS (SELECT {cols}, {_unnest(f'regexp_extract_all(body, {rx(V.PY_INSTALL)}, 1)', 'args', 'match_idx')} "
        f"FROM units WHERE {want_py} AND kind IN ('python', 'shell', 'prose'))",
        f"pyn AS (SELECT {cols}, 'python' AS ecosystem, 2 AS rule, match_idx, "
        f"{_unnest(install_tokens('args', 'section = 1'), 'raw', 'item_idx')}, 'install' AS source, "
        f"false AS is_import FROM pyn0)",
        f"pyr0 AS (SELECT {cols}, {_unnest(requirement_lines('body'), 'line', 'match_idx')} FROM units "
        f"WHERE {want_py} AND (kind = 'requirements' OR (kind = 'text' AND "
        f"regexp_matches(body, {rx(V.TEXT_REQ_GATE)}))))",
        f"pyr AS (SELECT {cols}, 'python' AS ecosystem, 3 AS rule, match_idx, "
        f"{_unnest(install_tokens('line', 'false'), 'raw', 'item_idx')}, 'manifest' AS source, "
        f"false AS is_import FROM pyr0)",
    ]
    js_parts = []
    for rule, pattern in enumerate((V.JS_REQUIRE, V.JS_IMPORT_FROM, V.JS_IMPORT_BARE,
                                    V.JS_IMPORT_DYNAMIC, V.JS_EXPORT_FROM)):
        name = f"jsc{rule}"
        ctes.append(
            f"{name} AS (SELECT {cols}, 'javascript' AS ecosystem, {rule} AS rule, "
            f"{_unnest(f'regexp_extract_all(body, {rx(pattern)}, 1)', 'raw', 'match_idx')}, "
            f"0 AS item_idx, 'import' AS source, true AS is_import FROM units "
            f"WHERE {want_js} AND kind = 'javascript')"
        )
        js_parts.append(name)
    ctes += [
        f"jsn0 AS (SELECT {cols}, {_unnest(f'regexp_extract_all(body, {rx(V.JS_INSTALL)}, 1)', 'args', 'match_idx')} "
        f"FROM units WHERE {want_js} AND kind IN ('javascript', 'shell', 'prose'))",
        f"jsn AS (SELECT {cols}, 'javascript' AS ecosystem, 5 AS rule, match_idx, "
        f"{_unnest(install_tokens('args', 'section = 1'), 'raw', 'item_idx')}, 'install' AS source, "
        f"false AS is_import FROM jsn0)",
    ]
    man = []
    for k, key in enumerate(V.DEP_KEYS):
        path = lit(f"$.{key}")
        man.append(
            f"SELECT {cols}, 'javascript' AS ecosystem, 6 AS rule, {k} AS match_idx, "
            f"{_unnest(f'json_keys(body, {path})', 'raw', 'item_idx')}, 'manifest' AS source, "
            f"false AS is_import FROM units WHERE {want_js} AND kind = 'json' AND json_valid(body) "
            f"AND json_type(body) = 'OBJECT' AND json_type(body, {path}) = 'OBJECT'"
        )
    ctes.append("jsm AS (" + " UNION ALL ".join(man) + ")")
    branches = ["pyi", "pyf", "pyn", "pyr", *js_parts, "jsn", "jsm"]
    union = " UNION ALL ".join(
        f"SELECT {cols}, ecosystem, rule, match_idx, item_idx, raw, source, is_import FROM {b}"
        for b in branches
    )
    ctes.append(
        f"cands AS (SELECT *, CASE WHEN ecosystem = 'python' THEN 0 ELSE 1 END AS eco_ord, "
        f"CASE WHEN section = 1 THEN 'prose' ELSE 'code_block' END AS origin FROM ({union}))"
    )
    py_raw = "CASE WHEN is_import THEN split_part(raw, '.', 1) ELSE raw END"
    ctes += [
        f"vocab AS ({vocab_sql()})",
        f"aliases AS ({aliases_sql()})",
        f"keyed AS (SELECT *, CASE WHEN ecosystem = 'python' THEN {py_raw} END AS py_raw, "
        f"CASE WHEN ecosystem = 'javascript' THEN {js_root('raw')} END AS js_root FROM cands)",
        "keyed2 AS (SELECT *, CASE WHEN ecosystem = 'python' THEN py_raw "
        "WHEN starts_with(js_root, 'node:') THEN substr(js_root, 6) ELSE js_root END AS vocab_key "
        "FROM keyed)",
        "joined AS (SELECT k.*, v.name IS NOT NULL AS in_vocab, a.dist_name AS a_dist FROM keyed2 k "
        "LEFT JOIN vocab v ON v.language = k.ecosystem AND v.name = k.vocab_key "
        "LEFT JOIN aliases a ON k.ecosystem = 'python' AND k.is_import AND a.import_name = k.py_raw)",
        resolved_cte("resolved", "in_vocab", "a_dist"),
        "mentions AS (SELECT response_id, eco_ord, section, block_idx, rule, match_idx, item_idx, "
        "raw, name, ecosystem, source, origin, alias_resolved FROM resolved WHERE reason IS NULL)",
    ]
    return "WITH " + ",\n".join(ctes) + "\n"


def resolved_cte(cte: str, in_vocab: str, a_dist: str) -> str:
    """K15-K17 over ``joined``; ``in_vocab`` / ``a_dist`` name the vocabulary lookups (a
    stale extractor passes ``false`` / ``NULL``)."""
    return (
        f"{cte} AS (SELECT response_id, eco_ord, section, block_idx, rule, match_idx, item_idx, "
        "ecosystem, source, origin, "
        "CASE WHEN ecosystem = 'python' THEN ("
        "  CASE WHEN is_import AND starts_with(raw, '.') THEN 'relative' "
        f"  WHEN NOT {plausible('py_raw')} THEN 'malformed' "
        f"  WHEN {in_vocab} OR py_raw = '__future__' THEN 'stdlib' "
        "  WHEN is_import AND list_contains(declared, py_raw) THEN 'declared_in_response' END) "
        f"ELSE (CASE WHEN js_root IS NULL THEN 'relative' WHEN {in_vocab} THEN 'builtin' "
        f"  WHEN NOT {plausible('vocab_key')} THEN 'malformed' END) END AS reason, "
        "CASE WHEN ecosystem = 'python' THEN (CASE WHEN is_import AND starts_with(raw, '.') "
        f"THEN raw ELSE py_raw END) ELSE (CASE WHEN {in_vocab} AND js_root IS NOT NULL THEN js_root "
        "ELSE raw END) END AS audit_name, "
        "CASE WHEN ecosystem = 'python' THEN py_raw ELSE raw END AS raw, "
        f"CASE WHEN ecosystem = 'python' THEN {norm_py(f'CASE WHEN is_import THEN coalesce({a_dist}, py_raw) ELSE py_raw END')} "
        f"ELSE {norm_js('js_root')} END AS name, "
        f"CASE WHEN ecosystem = 'python' AND is_import THEN {a_dist} IS NOT NULL END AS alias_resolved "
        "FROM joined)"
    )


POS = "eco_ord, section, block_idx, rule, match_idx, item_idx"


def doc_tokens_cte() -> str:
    return ("WITH toks AS (SELECT doc_id, unnest(" + tokens("text") + ") AS token FROM documents)\n")


def all_sql() -> dict[str, str]:
    base = pipeline_ctes()
    blocks = ("SELECT response_id, CAST(block_idx AS INTEGER) AS block_idx, tag, "
              f"{lang_of('tag')} AS lang, body FROM blk2")
    note = lit("Some packages were found in prose rather than fenced code blocks; "
               "these are lower confidence and tagged origin='prose'.")
    tok = doc_tokens_cte()
    out = {
        "code_blocks": base + blocks,
        "block_langs": base + f"SELECT tag, lang, count(*) AS n FROM ({blocks}) GROUP BY tag, lang",
        "prose_text": base + "SELECT response_id, CAST(length(prose) AS INTEGER) AS prose_len, md5(prose) AS prose_md5 FROM g",
        "untagged_infer": base + f"SELECT response_id, CAST(block_idx AS INTEGER) AS block_idx, "
        f"{infer('body')} AS inferred FROM blk2 WHERE {lang_of('tag')} = 'untagged'",
        "declared_modules": base + "SELECT response_id, declared FROM g",
        "block_routing": base + "SELECT response_id, scope, section, CAST(block_idx AS INTEGER) AS block_idx, kind FROM units",
        "py_imports": base + "SELECT response_id, CAST(block_idx AS INTEGER) AS block_idx, "
        "CAST(match_idx AS INTEGER) AS match_idx, CAST(item_idx AS INTEGER) AS item_idx, raw AS target FROM pyi",
        "py_from_imports": base + "SELECT response_id, CAST(block_idx AS INTEGER) AS block_idx, "
        "CAST(match_idx AS INTEGER) AS match_idx, raw AS module FROM pyf",
        "py_installs": base + "SELECT response_id, section, CAST(block_idx AS INTEGER) AS block_idx, "
        "CAST(match_idx AS INTEGER) AS match_idx, CAST(item_idx AS INTEGER) AS item_idx, raw AS token, "
        "CASE WHEN section = 1 THEN 'prose' ELSE 'code_block' END AS origin FROM pyn",
        "py_requirements": base + "SELECT response_id, CAST(block_idx AS INTEGER) AS block_idx, "
        "CAST(match_idx AS INTEGER) AS match_idx, CAST(item_idx AS INTEGER) AS item_idx, raw AS token FROM pyr",
        "js_imports": base + "SELECT response_id, CAST(block_idx AS INTEGER) AS block_idx, rule, "
        "CAST(match_idx AS INTEGER) AS match_idx, raw AS specifier FROM cands "
        "WHERE ecosystem = 'javascript' AND rule <= 4",
        "js_installs": base + "SELECT response_id, section, CAST(block_idx AS INTEGER) AS block_idx, "
        "CAST(match_idx AS INTEGER) AS match_idx, CAST(item_idx AS INTEGER) AS item_idx, raw AS token, "
        "CASE WHEN section = 1 THEN 'prose' ELSE 'code_block' END AS origin FROM jsn",
        "js_manifest": base + "SELECT response_id, CAST(block_idx AS INTEGER) AS block_idx, "
        "CAST(match_idx AS INTEGER) AS dep_key, raw AS name FROM jsm",
        "install_tokens": base + "SELECT response_id, section, CAST(block_idx AS INTEGER) AS block_idx, "
        f"CAST(match_idx AS INTEGER) AS match_idx, args, {install_tokens('args', 'section = 1')} AS names "
        "FROM (SELECT * FROM pyn0 WHERE scope = 'python' UNION ALL SELECT * FROM jsn0 WHERE scope = 'javascript')",
        "token_peel": tok + f"SELECT {peel('token')} AS peeled, count(*) AS n FROM toks GROUP BY 1",
        "token_clean": tok + f"SELECT {clean('token')} AS cleaned, count(*) AS n FROM toks GROUP BY 1",
        "norm_py": tok + f"SELECT {norm_py('token')} AS normalised, count(*) AS n FROM toks GROUP BY 1",
        "norm_js": tok + f"SELECT {norm_js('token')} AS normalised, count(*) AS n FROM toks GROUP BY 1",
        "js_package_root": tok + f"SELECT {js_root('token')} AS root, count(*) AS n FROM toks GROUP BY 1",
        "plausible_name": tok + f"SELECT {plausible('token')} AS plausible, count(*) AS n FROM toks GROUP BY 1",
        "py_filter_reason": base + "SELECT coalesce(reason, 'kept') AS reason, audit_name, count(*) AS n "
        "FROM resolved WHERE ecosystem = 'python' GROUP BY 1, 2",
        "js_filter_reason": base + "SELECT coalesce(reason, 'kept') AS reason, audit_name, count(*) AS n "
        "FROM resolved WHERE ecosystem = 'javascript' GROUP BY 1, 2",
        "alias_resolve": base + "SELECT raw, name, alias_resolved, count(*) AS n FROM mentions "
        "WHERE ecosystem = 'python' AND source = 'import' GROUP BY 1, 2, 3",
        "filtered_audit": base + f"""
SELECT response_id, reason, name,
       CAST(row_number() OVER (PARTITION BY response_id, reason ORDER BY {POS}) AS INTEGER) AS seen_order
FROM (SELECT response_id, reason, audit_name AS name, {POS},
             row_number() OVER (PARTITION BY response_id, reason, audit_name ORDER BY {POS}) AS rn
      FROM resolved WHERE reason IS NOT NULL) WHERE rn = 1""",
        "prose_note": base + f"SELECT DISTINCT response_id, {note} AS note FROM mentions WHERE origin = 'prose'",
        "response_names": base + f"""
SELECT response_id, list(name ORDER BY {POS}) AS names
FROM (SELECT response_id, name, {POS},
             row_number() OVER (PARTITION BY response_id, name ORDER BY {POS}) AS rn FROM mentions)
WHERE rn = 1 GROUP BY response_id""",
        "extract_mentions": base + "SELECT response_id, eco_ord, section, CAST(block_idx AS INTEGER) AS block_idx, "
        "rule, CAST(match_idx AS INTEGER) AS match_idx, CAST(item_idx AS INTEGER) AS item_idx, raw, name, "
        "ecosystem, source, origin, alias_resolved FROM mentions",
        "prose_installs": base + "SELECT response_id, ecosystem, name, source FROM mentions WHERE origin = 'prose'",
        "unmapped_imports": base + "SELECT DISTINCT raw FROM mentions WHERE alias_resolved IS FALSE ORDER BY raw",
        "filtered_by_reason": base + "SELECT DISTINCT reason, audit_name AS name FROM resolved "
        "WHERE reason IS NOT NULL ORDER BY reason, name",
        "lookup_keys": base + f"""
SELECT ecosystem, name,
  CASE WHEN ecosystem = 'javascript' AND starts_with(name, '@') AND strpos(name, '/') > 0
       THEN concat(substr(name, 1, strpos(name, '/') - 1), '%2F', substr(name, strpos(name, '/') + 1))
       ELSE name END AS lookup_key,
  CASE ecosystem {' '.join(f"WHEN {lit(e)} THEN concat({lit(t.split('{name}')[0])}, CASE WHEN ecosystem = 'javascript' AND starts_with(name, '@') AND strpos(name, '/') > 0 THEN concat(substr(name, 1, strpos(name, '/') - 1), '%2F', substr(name, strpos(name, '/') + 1)) ELSE name END, {lit(t.split('{name}')[1])})" for e, t in V.REGISTRY_URL_TEMPLATES.items())} END AS url
FROM (SELECT DISTINCT ecosystem, name FROM mentions)""",
    }
    return out
