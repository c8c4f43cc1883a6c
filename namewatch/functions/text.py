"""Column builders for text segmentation and name rules (all JVM-side expressions).

Each function takes Columns and returns a Column, so the rules compose into one
projection per table and stay inside Spark's expression engine: regular expressions
from ``namewatch.fixed_values``, higher-order functions over short arrays, no UDFs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from namewatch import fixed_values as V


def lit_re(pattern: str) -> Column:
    """A pattern as a literal Column (no SQL string escaping in between)."""
    return F.lit(pattern)


def ustrip(c: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends (Spark's ``trim``
    removes spaces only)."""
    return F.regexp_replace(c, lit_re(V.STRIP), F.lit(""))


def _char_class(chars: str) -> str:
    return "[" + "".join("\\" + ch if ch in "[]\\^-" else ch for ch in chars) + "]"


# ------------------------------------------------------------------ segmentation
def fence_tags(text: Column) -> Column:
    """Raw tags of all fenced blocks, in order."""
    return F.regexp_extract_all(text, lit_re(V.FENCE), F.lit(1))


def prose_text(text: Column) -> Column:
    """The text with every fenced block replaced by one newline."""
    return F.regexp_replace(text, lit_re(V.FENCE), F.lit("\n"))


def normalise_tag(tag: Column) -> Column:
    """Stripped, lower-cased tag."""
    return F.lower(ustrip(tag))


def lang_key(tag: Column) -> Column:
    """The language part of a (normalised) tag, before the first ':'."""
    return F.substring_index(tag, ":", 1)


def _lang_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in V.LANG_ALIASES.items() for x in kv])


def block_lang(tag: Column) -> Column:
    """Content kind of a normalised tag; unknown tags are 'other'."""
    return F.coalesce(F.element_at(_lang_map(), lang_key(tag)), F.lit("other"))


def infer_untagged(body: Column) -> Column:
    """Language of an untagged block from signal counts; NULL means skip."""
    py = F.regexp_count(body, lit_re(V.UNTAGGED_PY_IMPORT)) + F.regexp_count(
        body, lit_re(V.UNTAGGED_PY_DEF)
    )
    js = (
        F.regexp_count(body, lit_re(V.UNTAGGED_JS_REQUIRE))
        + F.regexp_count(body, lit_re(V.UNTAGGED_JS_IMPORT))
        + F.regexp_count(body, lit_re(V.UNTAGGED_JS_DECL))
        + F.regexp_count(body, lit_re(V.UNTAGGED_JS_FUNC))
    )
    sh = F.regexp_count(body, lit_re(V.UNTAGGED_SHELL))
    return (
        F.when((sh > 0) & (sh >= F.greatest(py, js)), "shell")
        .when(py > js, "python")
        .when(js > py, "javascript")
    )


def effective_lang(tag: Column, body: Column) -> Column:
    """X3 + X5: the kind a block is parsed as (untagged blocks inferred, NULL = skip)."""
    lang = block_lang(normalise_tag(tag))
    return F.when(lang == "untagged", infer_untagged(body)).otherwise(lang)


def top_level(module: Column) -> Column:
    """The part before the first dot."""
    return F.substring_index(module, ".", 1)


def file_modules(paths: Column) -> Column:
    """X6 (a): module names from ``# file: path.py`` matches (last path part, top level)."""
    return F.transform(paths, lambda p: top_level(F.substring_index(p, "/", -1)))


def tag_modules(tags: Column) -> Column:
    """X6 (b): module names from ``lang:path.py`` fence tags (lower-cased tags)."""
    with_file = F.filter(
        F.transform(tags, normalise_tag),
        lambda t: (F.instr(t, ":") > 0)
        & F.endswith(F.substr(t, F.instr(t, ":") + 1), F.lit(".py")),
    )

    def module(t: Column) -> Column:
        base = F.substring_index(F.substr(t, F.instr(t, ":") + 1), "/", -1)
        return top_level(F.substr(base, F.lit(1), F.length(base) - 3))

    return F.transform(with_file, module)


def declared_modules(text: Column, tags: Column) -> Column:
    """Module names the response defines: ``# file: x.py`` style lines anywhere in
    the text (Markdown headings match too), and ``lang:path.py`` fence tags."""
    paths = F.regexp_extract_all(text, lit_re(V.FILE_DECL), F.lit(1))
    return F.array_distinct(F.concat(file_modules(paths), tag_modules(tags)))


# ------------------------------------------------------------------ token rules
_PEEL_LEFT = "^" + _char_class(V.PEEL_BOTH) + "+"
# entered at the start of a run only, so an inner run is not tried from each of its places
_PEEL_RIGHT = "(?<!{0}){0}++$".format(_char_class(V.PEEL_BOTH + V.PEEL_RIGHT))
_SPEC_PREFIX = "^[^" + V.SPEC_SPLIT[1:-1] + "]*"


def _lit_array(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def peel(token: Column) -> Column:
    """K2: quotes, backticks, commas and brackets off both ends, sentence punctuation
    off the right, to a fixpoint (one left pass, then one right pass over the union)."""
    return F.regexp_replace(
        F.regexp_replace(ustrip(token), lit_re(_PEEL_LEFT), F.lit("")),
        lit_re(_PEEL_RIGHT),
        F.lit(""),
    )


def spec_prefix(s: Column) -> Column:
    """The part before the first version/extras/marker character."""
    return F.regexp_extract(s, _SPEC_PREFIX, 0)


def name_shaped(s: Column) -> Column:
    return s.rlike(V.NAME_SHAPE)


def clean_install_token(token: Column) -> Column:
    """K2-K7: one install argument -> bare package name, or NULL to skip it."""
    t = peel(token)
    rejected = (
        (t == "")
        | t.startswith("-")
        | t.startswith(".")
        | t.startswith("/")
        | t.startswith("~")
        | t.contains("://")
        | t.startswith("git+")
    )
    # K4: scoped names keep the scope; only the part after '/' is cut and shape-checked.
    slash = F.instr(t, "/")
    rest = spec_prefix(F.substr(t, slash + 1))
    scoped = F.when(
        (slash > 0) & (rest != "") & name_shaped(rest),
        F.concat(F.substring_index(t, "/", 1), F.lit("/"), rest),
    )
    # K5-K7: unscoped names.
    name = spec_prefix(t)
    low = F.lower(name)
    unscoped = F.when(
        (name != "")
        & name_shaped(name)
        & ~(name.contains(".") & F.array_contains(_lit_array(V.FILE_EXTS), F.substring_index(low, ".", -1)))
        & name.rlike("[A-Za-z]")
        & ~F.array_contains(_lit_array(V.PLACEHOLDER_NAMES), low),
        name,
    )
    return F.when(rejected, F.lit(None).cast("string")).when(
        t.startswith("@"), scoped
    ).otherwise(unscoped)


def split_ws(s: Column) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(s, V.WHITESPACE_RUN), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before_first(items: Column, ends) -> Column:
    """The items before the first one for which ``ends`` holds."""
    at = F.array_position(F.transform(items, lambda x: F.coalesce(ends(x), F.lit(False))), True)
    return F.when(at > 0, F.slice(items, 1, F.greatest(at - 1, F.lit(0)).cast("int"))) \
        .otherwise(items)


def _flag_values() -> str:
    """A value flag and the token after it, as whole tokens."""
    space = V.WHITESPACE_CLASS
    flags = "|".join(re.escape(f) for f in sorted(V.VALUE_FLAGS, key=len, reverse=True))
    return rf"(?U)(?<![^{space}])(?:{flags})[{space}]++[^{space}]++"


def install_tokens(args: Column, prose: Column) -> Column:
    """K1: the package names in an install command's arguments.

    A value flag goes with the token after it, whatever that is. The rest ends at the first
    token that starts with ``#`` or ``(``; tokens that clean to nothing are dropped; in prose
    the names end at the first stopword. Every step is one pass over the tokens.
    """
    tokens = split_ws(F.regexp_replace(args, lit_re(_flag_values()), F.lit(" ")))
    code = let(tokens, lambda ts: _before_first(
        ts, lambda t: t.startswith("#") | t.startswith("(")))
    names = F.filter(F.transform(code, clean_install_token), lambda c: c.isNotNull())
    stopword = lambda c: prose & F.array_contains(
        _lit_array(V.PROSE_STOPWORDS), F.lower(c))
    return let(names, lambda ns: _before_first(ns, stopword))


def plausible_name(name: Column) -> Column:
    """Non-empty, at most 214 characters, not a lone separator, has an ASCII
    letter or digit."""
    return (
        name.isNotNull()
        & (F.length(name) > 0)
        & (F.length(name) <= V.MAX_NAME_LENGTH)
        & ~name.isin("-", "_", ".")
        & name.rlike("[a-zA-Z0-9]")
    )


def normalise_python(name: Column) -> Column:
    """Runs of '-', '_', '.' become '-', then strip and lower-case."""
    return F.lower(ustrip(F.regexp_replace(name, lit_re(V.PY_NORM_SEPARATORS), F.lit("-"))))


def normalise_js(name: Column) -> Column:
    """Strip and lower-case; the scope is kept."""
    return F.lower(ustrip(name))


def js_package_root(specifier: Column) -> Column:
    """The package a module specifier belongs to, or NULL (relative, absolute, URL,
    bare or empty scope)."""
    spec = ustrip(specifier)
    parts = F.split(spec, "/")
    scoped = F.when(
        (F.size(parts) >= 2)
        & (F.element_at(parts, 1) != "@")
        & (F.element_at(parts, 2) != ""),
        F.concat(F.element_at(parts, 1), F.lit("/"), F.element_at(parts, 2)),
    )
    return (
        F.when(spec == "", F.lit(None).cast("string"))
        .when(spec.startswith(".") | spec.startswith("/"), F.lit(None).cast("string"))
        .when(spec.contains("://"), F.lit(None).cast("string"))
        .when(spec.startswith("@"), scoped)
        .otherwise(F.substring_index(spec, "/", 1))
    )


def registry_lookup_key(ecosystem: Column, name: Column) -> Column:
    """P10: the name as sent to the registry: a scoped npm name gets its first '/' as
    '%2F'."""
    slash = F.instr(name, "/")
    encoded = F.concat(F.substr(name, F.lit(1), slash - 1), F.lit("%2F"), F.substr(name, slash + 1))
    return F.when(
        (ecosystem == "javascript") & name.startswith("@") & (slash > 0), encoded
    ).otherwise(name)


def registry_url(ecosystem: Column, name: Column) -> Column:
    """P10: lookup URL from the ecosystem's template."""
    key = registry_lookup_key(ecosystem, name)
    out = F.lit(None).cast("string")
    for eco, template in V.REGISTRY_URL_TEMPLATES.items():
        head, tail = template.split("{name}")
        out = F.when(ecosystem == eco, F.concat(F.lit(head), key, F.lit(tail))).otherwise(out)
    return out


def _re2_forms() -> dict[str, str]:
    return {V.java_form(n): (f"(?{f})" if f else "") + p for n, (p, f) in V.PATTERNS.items()}


def re2(pattern: str) -> str:
    """The same pattern for RE2 (the SQL oracle's engine): the plain form of a stated
    pattern, else the Java form without its Java-only flags."""
    plain = _re2_forms().get(pattern)
    if plain is not None:
        return plain
    m = re.match(r"^\(\?([a-zA-Z]+)\)", pattern)
    if not m:
        return pattern
    flags = "".join(ch for ch in m.group(1) if ch not in "dU")
    rest = pattern[m.end():]
    return (f"(?{flags})" if flags else "") + rest
