"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact sizes.

1. Each partition of the input puts its rows in random order (a seeded hash) and numbers
   them; the numbered rows are written out.
2. The partitions' row counts and the shards' sizes are the margins of a matrix; it is drawn
   from the distribution that a uniform shuffle of all rows has (multivariate hypergeometric,
   row by row).
3. Every partition deals its rows in their local order: as many to each shard as its line of
   the matrix says. One exchange by shard, and a second random order there, complete a uniform
   permutation whose shard sizes differ by one row at most.

Built-in functions only. The matrix is drawn on the driver from the partitions' counts: 16
small numbers for each input partition.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namewatch.llm.common import fresh, materialise, text_of

SHARDS = 16
SEED = 20240301
# Rows of one shard that are put in order together.
ORDER_GROUP = 50_000
# Lines of the matrix that are broadcast (16 longs each, 8 MB); more are joined by a shuffle.
BROADCAST_LINES = 1 << 16
LAW = "rows"
_LOCAL_BITS = 33        # monotonically_increasing_id: partition above, row number below


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` taken without replacement from ``good + bad``.

    Inversion from the mode outwards: expected steps grow with the standard deviation.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode)
                      - log_choose(total, draws))
    left = rng.random() - p_mode
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode     # rounding left a remainder


def matrix(rows: list[tuple[int, int]], sizes: list[int],
           seed: int) -> Iterator[tuple[int, list[int]]]:
    """``(partition, counts by shard)`` with the given row counts and shard sizes."""
    rng, open_sizes = random.Random(seed), list(sizes)
    for partition, n in rows:
        left, total, line = n, sum(open_sizes), []
        for size in open_sizes:
            take = hypergeometric(rng, size, total - size, left)
            line.append(take)
            total -= size
            left -= take
        open_sizes = [a - b for a, b in zip(open_sizes, line)]
        yield partition, line


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most, the larger first."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _numbered(docs: DataFrame, key: Column, pid: str, at: str, rank: str, seed: int) -> DataFrame:
    """``docs`` in random order within each partition, with the partition, the place in it,
    and a hash for the second order."""
    first, mark = fresh([*docs.columns, pid, at, rank], "nw_first", "nw_mark")
    local = docs.withColumns({first: F.xxhash64(F.lit(seed), key),
                              rank: F.xxhash64(F.lit(seed + 1), key)})
    local = local.sortWithinPartitions(first).withColumn(mark, F.monotonically_increasing_id())
    return local.withColumns({
        pid: F.shiftright(mark, _LOCAL_BITS),
        at: F.col(mark).bitwiseAND((1 << _LOCAL_BITS) - 1)}).drop(first, mark)


def deal(docs: DataFrame, key: Column, shard_col: str, slot_col: str, shards: int = SHARDS,
         seed: int = SEED) -> DataFrame:
    """``docs`` with its shard (0 to ``shards - 1``) and its slot there (gapless from 0).

    ``key`` seeds the two orders; it should tell rows apart. Rows with equal keys are equal
    to the shuffle and get different slots. An empty table stays empty.
    """
    spark = docs.sparkSession
    pid, at, rank, bounds, p2 = fresh([*docs.columns, shard_col, slot_col],
                                      "nw_part", "nw_at", "nw_rank", "nw_bounds", "nw_p")
    rows = materialise(_numbered(docs, key, pid, at, rank, seed), "shard-rows")
    counts = sorted((int(r[0]), int(r[1])) for r in rows.groupBy(pid).count().collect())
    total = sum(n for _, n in counts)
    lines = []
    for partition, line in matrix(counts, shard_sizes(total, shards), seed):
        upto = 0
        ends = [upto := upto + n for n in line]
        lines.append((partition, ends))
    table = spark.createDataFrame(lines, f"{p2} long, {bounds} array<long>")
    # one line for each input partition; a partition deals its places in runs by shard
    table = F.broadcast(table) if len(lines) <= BROADCAST_LINES else table
    dealt = rows.join(table, rows[pid] == table[p2]).withColumn(
        shard_col, F.size(F.filter(bounds, lambda end: end <= F.col(at))).cast("int"))
    return _slots(dealt, rank, shard_col, slot_col, max(1, math.ceil(
        total / shards / ORDER_GROUP))).drop(pid, at, rank, bounds, p2)


def _slots(dealt: DataFrame, rank: str, shard_col: str, slot_col: str, parts: int) -> DataFrame:
    """The second random order: slots by the hash ``rank`` within a shard.

    A shard is cut into ``parts`` ranges of the hash; a range's rows are ordered in one task
    and start after the rows of the ranges before it.
    """
    part, s2, q2, start, upto = fresh([*dealt.columns, slot_col],
                                      "nw_range", "nw_s2", "nw_q2", "nw_start", "nw_upto")
    rows = dealt.withColumn(part, F.floor(
        F.shiftrightunsigned(rank, 11) / F.lit(float(1 << 53)) * parts).cast("long"))
    counts = rows.groupBy(shard_col, part).count()
    before = Window.partitionBy(shard_col).orderBy(part).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    starts = counts.withColumn(upto, F.sum("count").over(before)).select(
        F.col(shard_col).alias(s2), F.col(part).alias(q2),
        (F.col(upto) - F.col("count")).alias(start))
    order = Window.partitionBy(shard_col, part).orderBy(rank)
    placed = rows.withColumn(slot_col, F.row_number().over(order))
    placed = placed.join(starts, (placed[shard_col] == starts[s2]) & (placed[part] == starts[q2]))
    return placed.withColumn(slot_col, F.col(slot_col) - 1 + F.col(start)).drop(
        part, s2, q2, start)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: ``(id, size, text_crc32, law, shard, slot, grown_shard)``.

    The law is ``rows``: shard sizes differ by one row at most, and every arrangement is
    equally likely over seeds. A null text counts as empty (size 1, checksum 0).
    """
    slim = docs.select(F.col(id_col).alias("id"), *(
        c.alias(name) for name, c in _digest(text_col).items()),
        F.xxhash64(text_of(text_col)).alias("digest"))
    key = F.concat_ws(":", F.col("id").cast("string"), F.col("digest").cast("string"))
    return deal(slim, key, "shard", "slot", shards, seed).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _digest(text_col: str) -> dict[str, Column]:
    return {"size": (F.octet_length(text_of(text_col)) + 1).cast("long"),
            "text_crc32": F.crc32(F.encode(text_of(text_col), "UTF-8"))}


def write_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with columns ``shard`` and ``slot`` (renamed if taken).

    Every row keeps all its columns and moves once. Null ids and texts are values like others;
    repeated rows get a slot each; an empty table stays empty.
    """
    shard_col, slot_col = fresh(docs.columns, "shard", "slot")
    key = F.concat_ws(":", F.col(id_col).cast("string"),
                      F.xxhash64(text_of(text_col)).cast("string"))
    return deal(docs, key, shard_col, slot_col, shards, seed)


def sharded_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The documents in their shards: the columns of :func:`shard`, then the others of ``docs``.

    Places are those of :func:`shard` on the same partitions. A column of ``docs`` that has the
    name of one of them is left out. Nulls, repeats and empty tables as in :func:`write_order`.
    """
    ours = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    others = [c for c in docs.columns if c.lower() not in (*ours, id_col.lower())]
    placed = write_order(docs.select(id_col, *others), id_col, text_col, shards, seed)
    return placed.withColumns({
        **_digest(text_col), "law": F.lit(LAW), "slot": F.col("slot").cast("long"),
        "grown_shard": F.lit(None).cast("int")}).select(id_col, *ours, *others)
