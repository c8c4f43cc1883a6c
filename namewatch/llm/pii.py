"""Personal data by bootstrapped contextual extraction, with built-in functions only.

1. Base rules find e-mail addresses, IP addresses, payment cards and phone numbers. They are
   the seeds. The same scan collects candidates: tokens with a digit or an at sign (groups of
   digits with single spaces between them also as one), with the word before them. This is the only pass over the texts.
2. Seeds and candidates make a graph between contexts (the word before) and instances (the
   token). Scores go back and forth: a context's confidence in a kind is the mean score of its
   distinct instances, damped for rare ones; an unseen instance of the kind's general shape
   scores by the contexts that hold it. A few rounds, each an aggregation by context and one
   by instance.
3. Candidates in contexts of high confidence that no base span covers become spans of their
   kind.

Positions are code points: the pieces between matches (``split``) and the matches
(``regexp_extract_all``) give running lengths, summed by a window over each text's matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namewatch.llm.common import SPACES, let, materialise, text_of

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns, in Java syntax. Possessive forms match what the plain ones do, without
# going back: the classes on both sides of each quantifier exclude each other. An address
# starts where a run of its characters starts, or where the match before ended. A chain of
# fewer than 16 digits is no card, so the pattern passes over it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
             r"(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=(?:[0-9][\x20-]?){15}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# Every pattern needs one of these characters, so other texts are passed over.
_NEEDED = "[0-9@]"
# A candidate from its first digit or at sign on. What stands before it, the rest of the
# token and the word before, ends the piece of text before the match. The piece is read
# backwards from there, so no length of either or of the gap matters. A token of digits goes on
# over single spaces as long as whole groups of digits follow.
_EDGE = r"[\"'(),.;:<>\[\]{}!?]"
_FROM_DIGIT = (r"[0-9@][0-9().-]*+(?:(?<=[0-9)])\x20\(?[0-9][0-9().-]*+"
               rf"(?={_EDGE}*+(?:[\x20\x09-\x0D]|\z)))*+[^\x20\x09-\x0D]*+")
_FIRST = r"^[^\x20]*+"
_BEFORE = r"^[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+[^\x20\x09-\x0D]*+"
LONG_CONTEXT = 64       # a longer word before it is known by its digest
# Edges of a token; a run of them inside it is looked at once.
_TRIM = rf"^{_EDGE}++|(?<!{_EDGE}){_EDGE}++\z"

ROUNDS = 3
DAMPING = 2.0           # instances of score zero that every context is given
CONFIDENCE = 0.6
MIN_INSTANCES = 5       # distinct instances of a confident context


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(_IP)
    if kind == "card":
        return F.length(digits).between(16, 19) & (_luhn(digits) % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    places = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(places, lambda d, i: F.when(
            i % 2 == 1, F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))),
                                     d.cast("int") + 1)).otherwise(d.cast("int"))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _shape(kind: str, token: Column) -> Column:
    """Whether a token could be an instance of a kind that the base rule does not know."""
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    return {
        "email": token.contains("@") & (F.length(token) > 4) & ~token.contains(" "),
        "ip": (digits >= 4) & token.rlike(r"^[0-9A-Fa-f:.]+$") & token.rlike("[.:]"),
        "card": (digits >= 12) & token.rlike(r"^[0-9\x20-]+$"),
        "phone": (digits >= 7) & token.rlike(r"^\+?[0-9().\x20-]+$"),
    }[kind]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The one pass over the texts: row number, id, and for each pattern the matches and the
    lengths of the pieces between them; for each candidate what stands before it in its token
    and, after a space, the word before, both backwards."""
    text, needed = text_of(text_col), text_of(text_col).rlike(_NEEDED)
    out = {}
    for kind, pattern in {**PATTERNS, "near": _FROM_DIGIT}.items():
        may = needed & text.contains({"email": "@", "phone": "+"}.get(kind, ""))
        out[f"{kind}_m"] = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        out[f"{kind}_p"] = F.when(may, F.split(text, pattern, -1))
    rows = docs.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in out.items()))
    rows = rows.withColumns({
        **{f"{k}_g": F.transform(f"{k}_p", lambda g: F.length(g)) for k in (*KINDS, "near")},
        "near_back": F.transform("near_p", lambda g: F.regexp_replace(
            F.regexp_extract(F.reverse(g), _BEFORE, 0), SPACES, " "))})
    return materialise(rows.drop(*(f"{k}_p" for k in (*KINDS, "near"))).withColumn(
        "rid", F.monotonically_increasing_id()), "pii-scan")


def _placed(rows: DataFrame, kind: str, *more: str) -> DataFrame:
    """``(rid, m, start, stop, *more)`` of each match of a kind."""
    fields = [F.col(f"{kind}_m").alias("m"), F.col(f"{kind}_g").alias("g"),
              *(F.col(f"{kind}_{x}").alias(x) for x in more)]
    flat = rows.where(F.size(f"{kind}_m") > 0).select(
        "rid", F.posexplode(F.arrays_zip(*fields)).alias("i", "z"))
    # the last piece follows the last match
    flat = flat.where(F.col("z.m").isNotNull()).select(
        "rid", "i", "z.m", "z.g", *(f"z.{x}" for x in more))
    upto = Window.partitionBy("rid").orderBy("i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("g") + F.length("m")).over(upto)
    flat = flat.withColumn("stop", stop.cast("int"))
    return flat.select("rid", "m", (F.col("stop") - F.length("m")).alias("start"), "stop", *more)


def base_spans(rows: DataFrame) -> DataFrame:
    """``(rid, kind, start, stop, value)`` of every valid base match."""
    out = None
    for kind in KINDS:
        part = _placed(rows, kind).where(_valid(kind, F.col("m"))).select(
            "rid", F.lit(kind).alias("kind"), "start", "stop", F.col("m").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """``(rid, ctx, token, start, stop, run, run_stop)``: tokens with a digit or an at sign, and
    the word without one before them, both trimmed of punctuation (the word keeps a final colon
    or equals sign). ``run`` is the token with the groups of digits after it, if together they
    have the shape of a kind that the token alone has not."""
    flat = _placed(rows, "near", "back").select(
        "rid", "stop", F.split_part("back", F.lit(" "), F.lit(2)).alias("w"),
        F.concat(F.reverse(F.split_part("back", F.lit(" "), F.lit(1))), "m").alias("t")).where(
        "w <> ''")
    lead = F.length("t") - F.length(F.regexp_replace("t", f"^{_EDGE}++", ""))
    token = F.regexp_replace(F.regexp_extract("t", _FIRST, 0), _TRIM, "")
    run = F.regexp_replace("t", _TRIM, "")
    start = F.col("stop") - F.length("t") + lead
    word = F.lower(F.reverse(F.regexp_replace("w", r"^[^\p{L}\p{N}_:=]++", "")))
    ctx = let(word, lambda w: F.when(F.length(w) <= LONG_CONTEXT, w).otherwise(
        F.concat(F.lit("md5:"), F.md5(w))))
    flat = flat.select("rid", ctx.alias("ctx"), token.alias("token"), start.alias("start"),
                       (start + F.length(token)).alias("stop"),
                       F.when(F.col("t").contains(" "), run).alias("run"))
    grown = F.lit(False)
    for kind in KINDS:
        grown = grown | (_shape(kind, F.col("run")) & ~_shape(kind, F.col("token")))
    return flat.where("token <> '' AND ctx <> ''").withColumn("run", F.when(
        grown, F.col("run"))).withColumn("run_stop", F.col("start") + F.length("run"))


def _instances(found: DataFrame, spans: DataFrame) -> DataFrame:
    """``found`` with the base span that a candidate overlaps, if any: ``kind`` (null: unseen),
    and its value as token. A run that no base span touches is an instance, also in place of
    its first token if that alone has no kind's shape.

    One sort of each text's spans and candidates by start: the span that reaches furthest of
    those before, and the first one after.
    """
    events = found.withColumns({"kind": F.lit(None).cast("string"), "rank": F.lit(1)}) \
        .unionByName(spans.select(
            "rid", F.lit(None).cast("string").alias("ctx"), F.col("value").alias("token"),
            "start", "stop", F.lit(None).cast("string").alias("run"),
            F.lit(None).cast("int").alias("run_stop"), "kind", F.lit(0).alias("rank")))
    span = F.when(F.col("rank") == 0, F.struct("stop", "kind", "token"))
    up = Window.partitionBy("rid").orderBy("start", "rank")
    down = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("rank"))
    upto = (Window.unboundedPreceding, Window.currentRow)
    after = F.when(F.col("rank") == 0, F.struct("start", "kind", "token"))
    rows = events.withColumn("prev", F.max(span).over(up.rowsBetween(*upto))).withColumn(
        "next", F.min(after).over(down.rowsBetween(*upto))).where("rank = 1")
    inside, ahead = F.col("prev.stop") > F.col("start"), F.col("next.start") < F.col("stop")
    pick = lambda f, other: F.when(inside, F.col(f"prev.{f}")).when(
        ahead, F.col(f"next.{f}")).otherwise(other)
    free = F.col("run").isNotNull() & ~F.coalesce(inside, F.lit(False)) \
        & ~F.coalesce(F.col("next.start") < F.col("run_stop"), F.lit(False))
    one = F.struct(pick("token", F.col("token")).alias("token"), F.col("stop").alias("stop"),
                   pick("kind", F.lit(None)).alias("kind"))
    run = F.struct(F.col("run").alias("token"), F.col("run_stop").alias("stop"),
                   F.lit(None).cast("string").alias("kind"))
    fits = F.lit(False)
    for kind in KINDS:
        fits = fits | _shape(kind, F.col("token"))
    return rows.select("rid", "ctx", "start", F.explode(
        F.when(free & fits, F.array(one, run)).when(free, F.array(run)).otherwise(
            F.array(one))).alias("x")).select("rid", "ctx", "x.token", "start", "x.stop", "x.kind")


def confident_contexts(seen: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE,
                       least: int = MIN_INSTANCES) -> DataFrame:
    """``(ctx, kind)`` of the contexts that tell a kind, after some rounds on the graph of
    ``seen (ctx, token, kind)``.

    Edges are distinct pairs, so repeated documents add nothing. In each round a context's
    confidence is the sum of its instances' scores over their number plus ``DAMPING``; an
    unseen instance's score is the chance that one of its contexts is right.
    """
    edges = materialise(seen.groupBy("ctx", "token").agg(F.min("kind").alias("seed")), "pii-graph")
    sizes = edges.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"))
    score = edges.where("seed IS NOT NULL").select(
        "ctx", "token", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    for turn in range(rounds):
        belief = score.groupBy("ctx", "kind").agg(F.sum("score").alias("sum")).join(
            sizes, "ctx").select("ctx", "kind", "n", (
                F.col("sum") / (F.col("n") + DAMPING)).alias("belief"))
        belief = materialise(belief, "pii-belief")
        if turn == rounds - 1:
            break
        unseen = edges.where("seed IS NULL").join(belief, "ctx").where(_any_shape())
        wrong = F.sum(F.log1p(-F.least(F.col("belief"), F.lit(0.999999))))
        unseen = unseen.groupBy("token", "kind").agg((1 - F.exp(wrong)).alias("score"))
        back = edges.where("seed IS NULL").join(unseen, "token").select(
            "ctx", "token", "kind", "score")
        seeds = edges.where("seed IS NOT NULL").select(
            "ctx", "token", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
        score = seeds.unionByName(back)
    return belief.where((F.col("belief") >= confidence) & (F.col("n") >= least)).select(
        "ctx", "kind")


def _any_shape() -> Column:
    out = F.lit(False)
    for kind in KINDS:
        out = out | ((F.col("kind") == kind) & _shape(kind, F.col("token")))
    return out


def discovered(seen: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(rid, kind, start, stop, value)``: unseen candidates of fitting shape in confident
    contexts; of several at one place the first kind, and the token alone before its run."""
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    hits = seen.where("kind IS NULL").drop("kind").join(contexts, "ctx").where(_any_shape())
    return hits.groupBy("rid", "start").agg(
        F.min(F.struct(rank.alias("rank"), "stop", "kind", "token")).alias("x")).select(
        "rid", "x.kind", "start", "x.stop", F.col("x.token").alias("value"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, spans)``, spans being an array of structs ``(kind, start,
    stop, value, base)`` in order of kind and start.

    Null and empty texts have no spans; repeated rows come back once each.
    """
    rows = scan(docs, id_col, text_col)
    spans = materialise(base_spans(rows), "pii-base")
    seen = materialise(_instances(candidates(rows), spans), "pii-seen")
    more = discovered(seen, confident_contexts(seen))
    every = spans.withColumn("base", F.lit(True)).unionByName(
        more.withColumn("base", F.lit(False)))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    lists = every.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
        rank.alias("rank"), "start", "stop", "kind", "value", "base"))).alias("spans"))
    none = F.array().cast("array<struct<rank:int,start:int,stop:int,kind:string,"
                          "value:string,base:boolean>>")
    return rows.select("rid", "id").join(lists, "rid", "left").select(
        F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, all spans."""
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k))
    return found.select(
        id_col, *(of(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
