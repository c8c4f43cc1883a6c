"""Mixing sources to target weights by fitting a word budget for each source.

Every document is a unit of its word count. For each source the documents of each length are
counted; the source's target is met by whole passes over the source and a rest. Of a large
rest every length first gives its share; the remaining budget is fitted by a bounded-knapsack
dynamic programme over the units that are left. So only counts by length are decided on, and
within a length a seeded hash order picks the documents.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namewatch.llm.common import SPACES, fresh, materialise, text_of

# Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240229
# Ranges of the hash order in which documents of one source and length are counted.
PARTS = 4096
# Words that are left to the dynamic programme; more than twice that is shared out first.
KNAPSACK_WORDS = 1 << 16


def size_of(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(SPACES.replace("[", "[^", 1))).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS,
            max_epochs: int = MAX_EPOCHS) -> dict[str | None, Fraction]:
    """Target words of each source.

    The weights share the words of all sources. A target that would pass ``max_epochs`` times
    its source stops there, and the excess is shared again among the others by weight.
    """
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    out: dict[str | None, Fraction] = {}
    left, open_names = Fraction(sum(sizes.values())), list(names)
    while open_names:
        total = sum(weight[n] for n in open_names)
        share = {n: left * weight[n] / total for n in open_names}
        over = [n for n in open_names if share[n] > max_epochs * sizes[n]]
        if not over:
            return out | share
        for n in over:
            out[n] = Fraction(max_epochs * sizes[n])
            left -= out[n]
        open_names = [n for n in open_names if n not in out]
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many units of each length to take: the sum nearest to ``budget`` (of two, the
    smaller one).

    Bounded knapsack by dynamic programming over sums. Bit s of a number says that sum s is
    reachable; a length's units enter in binary parts, so each part is one shift.
    """
    taken = [0] * len(lengths)
    if budget <= 0 or not lengths:
        return taken
    mask = (1 << (budget + max(lengths) + 1)) - 1
    reach, steps = 1, []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        left, part = counts[i], 1
        while left and lengths[i] and not reach >> budget & 1:
            part = min(part, left)
            wider = (reach | reach << lengths[i] * part) & mask
            if wider != reach:
                steps.append((i, part, reach))
                reach = wider
            left -= part
            part *= 2
    at = (reach & ((2 << budget) - 1)).bit_length() - 1
    above = reach >> budget
    if above and (more := (above & -above).bit_length() - 1) < budget - at:
        at = budget + more
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= lengths[i] * part
    return taken


def share_out(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Units of each length for ``budget`` words in proportion, never more than that; what a
    length cannot use whole goes on to the next."""
    total = sum(n * c for n, c in zip(lengths, counts))
    out, given, earned = [], 0, 0
    for n, c in zip(lengths, counts):
        earned += n * c
        k = min(c, (budget * earned // total - given) // n) if n else 0
        given += n * k
        out.append(k)
    return out


def allocate(lengths: list[int], counts: list[int], budget: int,
             max_epochs: int = MAX_EPOCHS) -> list[int]:
    """Copies of each length's documents, all together, for ``budget`` words.

    First every document is taken for as many whole passes as fit, and the rest is fitted
    with one more copy each at most. If that stays off by more than a ten-thousandth (few or
    very uneven documents), up to ``max_epochs`` copies are allowed, and then fewer passes.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    passes = budget // total if total else 0
    best, off = [passes * c for c in counts], budget - passes * total
    for base, most in ((passes, passes + 1), (passes, max_epochs),
                       (max(0, passes - 1), max_epochs), (0, max_epochs)):
        if off * 10_000 <= budget:
            break
        room = [(min(most, max_epochs) - base) * c for c in counts]
        rest = budget - base * total
        bulk = share_out(lengths, room, rest - KNAPSACK_WORDS) \
            if rest > 2 * KNAPSACK_WORDS and any(room) else [0] * len(room)
        rest -= sum(n * k for n, k in zip(lengths, bulk))
        fine = knapsack(lengths, [r - k for r, k in zip(room, bulk)], rest)
        gap = abs(rest - sum(n * k for n, k in zip(lengths, fine)))
        if gap < off:
            best = [base * c + k + f for c, k, f in zip(counts, bulk, fine)]
            off = gap
    return best


def plan(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, size, source_size, target, passes, last, need)`` for each source and length
    of ``units (source, size, h)``. A document takes part ``passes`` times, and once more if its
    hash ``h`` is at most ``last`` (null: none). Of the rows that have the hash ``last``, only
    ``need`` take part once more (null: all).

    A source's lengths are few (n different lengths need at least n * n / 2 words), and the
    sources are a list of names; documents are never gathered.
    """
    counts = materialise(units.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")),
                         "mix-counts")
    sizes = {r["source"]: int(r["words"]) for r in counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("words")).toLocalIterator()}
    goal = targets(sizes, weights, max_epochs)

    wanted = units.sparkSession.createDataFrame(
        [(name, sizes[name], float(t), round(t)) for name, t in goal.items()],
        "s string, source_size long, target double, budget long")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ignore_index=True)
        copies = allocate(frame["size"].tolist(), frame["n"].tolist(),
                          int(frame["budget"].iloc[0]), max_epochs)
        return frame.assign(passes=[k // n for k, n in zip(copies, frame["n"])],
                            extra=[k % n for k, n in zip(copies, frame["n"])])

    joined = counts.join(wanted, counts["source"].eqNullSafe(wanted["s"])).drop("s")
    fields = "source string, size long, n long, source_size long, target double, budget long"
    fitted = materialise(joined.groupBy("source").applyInPandas(
        fit, f"{fields}, passes long, extra long"), "mix-plan")
    return materialise(_last_hashes(units, fitted), "mix-last")


def _last_hashes(units: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds ``last``, the hash of the extra-th document of each source and length, and ``need``,
    how many of the rows with this hash belong to the first ``extra`` (null: all).

    Documents are counted by ``PARTS`` ranges of the hash; the counts show the range that
    holds the extra-th document, and only that range's hashes, with their counts, are put in
    order. So a length that most of a source has is spread like any other, and rows that
    repeat id and text are one entry.
    """
    part = F.floor(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) * PARTS).cast("long")
    placed = units.withColumn("part", part)
    by_part = placed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy("source", "size").orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    by_part = by_part.withColumn("upto", F.sum("m").over(upto)).withColumnsRenamed(
        {"source": "s", "size": "l", "part": "p"})
    some = fitted.where("extra > 0").select("source", "size", "extra")
    edge = by_part.join(some, F.col("s").eqNullSafe(some["source"])
                        & (F.col("l") == some["size"])).where(
        "upto >= extra AND upto - m < extra").select(
        "s", "l", "p", F.expr("extra - upto + m").alias("rank"))
    inside = placed.join(edge, F.col("source").eqNullSafe(F.col("s"))
                         & (F.col("size") == F.col("l")) & (F.col("part") == F.col("p")))
    inside = inside.groupBy("s", "l", "rank", "h").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("s", "l").orderBy(_unsigned("h")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.sum("m").over(order)).where(
        "upto >= rank AND upto - m < rank").select(
        "s", "l", F.col("h").alias("last"),
        F.expr("CASE WHEN upto > rank THEN rank - upto + m END").alias("need"))
    return fitted.join(last, fitted["source"].eqNullSafe(last["s"])
                       & (fitted["size"] == last["l"]), "left").select(
        "source", "size", "source_size", "target", "passes", "last", "need")


def _last_rows(tied: DataFrame) -> DataFrame:
    """``(s, l, last_row)``: the need-th of the row numbers of each source and length of
    ``tied (s, l, need, row)``.

    Row numbers are counted by the partition that wrote them, which is in their upper bits;
    only the rows of the one that holds the need-th are put in order.
    """
    placed = tied.withColumn("part", F.shiftright("row", 33))
    upto = Window.partitionBy("s", "l").orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    edge = placed.groupBy("s", "l", "need", "part").agg(F.count(F.lit(1)).alias("m")).withColumn(
        "upto", F.sum("m").over(upto)).where("upto >= need AND upto - m < need").select(
        F.col("s").alias("es"), F.col("l").alias("el"), F.col("part").alias("ep"),
        F.expr("need - upto + m").alias("rank"))
    inside = placed.join(edge, F.col("s").eqNullSafe(F.col("es")) & (F.col("l") == F.col("el"))
                         & (F.col("part") == F.col("ep")))
    at = F.row_number().over(Window.partitionBy("s", "l").orderBy("row"))
    return inside.withColumn("at", at).where("at = rank").select(
        "s", "l", F.col("row").alias("last_row"))


def _tied(chosen: DataFrame, need: str) -> bool:
    """Whether any source and length takes only some of the rows with one hash."""
    return not chosen.where(F.col(need).isNotNull()).isEmpty()


def _unsigned(h: str) -> Column:
    """Orders a 64-bit hash as an unsigned number."""
    return F.col(h).bitwiseXOR(F.lit(-(1 << 63)))


def _unit_columns(id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, Column]:
    return {"source": F.col(source_col).cast("string"), "size": size_of(text_col),
            "h": F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text_of(text_col))}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: ``(id, size, source_size, target, taken)``.

    Null sources are a source of their own, last in order. A text without words has size zero
    and takes nothing. Rows that repeat id and text have one place in the order; if only some
    of them fit, a written row number tells which. An empty table gives no rows. How often an
    id and text is taken depends on ids, texts and the seed alone.
    """
    columns = _unit_columns(id_col, text_col, source_col, seed)
    units = materialise(docs.select(F.col(id_col).alias("id"),
                                    *(c.alias(n) for n, c in columns.items()),
                                    F.monotonically_increasing_id().alias("row")), "mix-units")
    chosen = plan(units.select("source", "size", "h"), weights, max_epochs)
    chosen = chosen.withColumnsRenamed({"source": "s", "size": "l"})
    rows = units.join(chosen, units["source"].eqNullSafe(chosen["s"])
                      & (units["size"] == chosen["l"]))
    more = F.col("last").isNotNull() & (_unsigned("h") <= _unsigned("last"))
    if _tied(chosen, "need"):
        ends = _last_rows(rows.where("need IS NOT NULL AND h = last").select(
            "s", "l", "need", "row")).withColumnsRenamed({"s": "es", "l": "el"})
        rows = rows.join(ends, rows["s"].eqNullSafe(ends["es"]) & (rows["l"] == ends["el"]), "left")
        more = more & ((F.col("h") != F.col("last")) | F.col("need").isNull()
                       | (F.col("row") <= F.col("last_row")))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target",
                       (F.col("size") * (F.col("passes") + more.cast("long"))).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
              max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as :func:`mix` takes it. Texts
    without words are left out."""
    names = dict(zip(("source", "size", "h"),
                     fresh(docs.columns, "nw_source", "nw_size", "nw_hash")))
    copy, = fresh([*docs.columns, *names.values()], "nw_copy")
    columns = _unit_columns(id_col, text_col, source_col, seed)
    marked = docs.withColumns({names[n]: c for n, c in columns.items()})
    units = materialise(marked.select(*(F.col(v).alias(k) for k, v in names.items())),
                        "mix-units")
    plan_names = fresh([*docs.columns, *names.values(), copy],
                       "nw_s", "nw_l", "nw_passes", "nw_last", "nw_need", "nw_more", "nw_row",
                       "nw_end_s", "nw_end_l", "nw_end")
    s, length, passes, last, need, more, row, *end = plan_names
    chosen = plan(units, weights, max_epochs).select(
        F.col("source").alias(s), F.col("size").alias(length), F.col("passes").alias(passes),
        F.col("last").alias(last), F.col("need").alias(need)).where(F.col(length) > 0)
    rows = marked.join(chosen, F.col(names["source"]).eqNullSafe(F.col(s))
                       & (F.col(names["size"]) == F.col(length)))
    upto = F.col(last).isNotNull() & (_unsigned(names["h"]) <= _unsigned(last))
    out = rows.withColumn(more, upto)
    if _tied(chosen, need):
        # only these rows need numbers, so only they are written
        tie = F.col(need).isNotNull() & (F.col(names["h"]) == F.col(last))
        tied = materialise(rows.where(tie).withColumn(row, F.monotonically_increasing_id()),
                           "mix-tied")
        ends = _last_rows(tied.select(F.col(s).alias("s"), F.col(length).alias("l"),
                                      F.col(need).alias("need"), F.col(row).alias("row")))
        ends = ends.withColumnsRenamed(dict(zip(("s", "l", "last_row"), end)))
        tied = tied.join(ends, F.col(s).eqNullSafe(F.col(end[0]))
                         & (F.col(length) == F.col(end[1])))
        tied = tied.withColumn(more, F.col(row) <= F.col(end[2]))
        out = out.where(~tie).select(*docs.columns, passes, more).unionByName(
            tied.select(*docs.columns, passes, more))
    n = F.col(passes) + F.col(more).cast("long")
    return out.where(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n.cast("int")))) \
        .select(*docs.columns)
