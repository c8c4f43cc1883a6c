"""Conversation prefix trie, built as a burst trie.

* A turn's id is the MD5 of its role and text; a conversation is its list of turn ids (20 bytes
  a turn), and equal conversations are one weighted sequence with the digest of its members.
  The texts themselves are read once and never move.
* Sequences lie in suffix containers under trie heads; a head is the digest of the turn ids
  that lead to it. An oversized container (more than ``CONTAINER`` sequences) bursts: each of
  its sequences moves on to the head that its next turn id leads to, or stays behind at the
  head if it ends there. Only oversized containers move. Sequences of a container are distinct,
  so a container of several can always burst.
* The remaining containers are dealt to tasks by head, sorted, and swept into nodes one
  container at a time; then burst heads are summed from the heads below them, from the deepest
  up.

A round is one pass over the sequences still in oversized containers; there are as many as the
deepest head has turns above it. A conversation's own turn ids lie in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewatch.llm.common import materialise, text_of

CONTAINER = 1_000       # distinct sequences that one container may hold
SHARED = 100            # conversations that share a head conversation
HEAD_TURNS = 6          # turns taken from it: checksum modulo this

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.md5(b"").hexdigest()

_NODE = ("path string, parent string, depth long, conv_id long, parent_conv_id long, "
         "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def turn_lists(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
               role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns ``(tid, len)`` in order of turn, null
    first; turns of one number by role, then by id. Null roles and texts are empty; rows
    without a conversation id belong to none and are left out."""
    role, text = text_of(role_col), text_of(text_col)
    tid = F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"),
                        F.struct(F.col(turn_col).alias("turn"), role.alias("role"),
                                 tid.alias("tid"), F.length(text).cast("long").alias("len"))
                        .alias("t")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list("t")),
        lambda t: F.struct(t["tid"].alias("tid"), t["len"].alias("len"))).alias("turns"))


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEAD_TURNS).cast("int")


def rebuild(lists: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` with every conversation's first turns replaced by those of its head
    conversation (``conv_id - conv_id % 100``; none if it is absent)."""
    heads = lists.where(F.col("conv_id") % SHARED == 0).select(
        F.col("conv_id").alias("head"),
        F.slice("turns", 1, HEAD_TURNS - 1).alias("shared"))
    h = head_length(F.col("conv_id"))
    none = F.lit(0).cast("int")
    return lists.withColumn("head", F.col("conv_id") - F.col("conv_id") % SHARED) \
        .join(heads, "head", "left").select("conv_id", F.concat(
            F.coalesce(F.slice("shared", F.lit(1), h), F.slice("turns", F.lit(1), none)),
            F.slice("turns", h + 1, F.greatest(F.size("turns") - h, none))).alias("turns"))


def _prefix(tids: Column, depth: Column) -> Column:
    """The head that the first ``depth`` turn ids lead to."""
    return F.md5(F.unhex(F.array_join(F.slice(tids, F.lit(1), depth), "")))


def _members(convs: DataFrame) -> DataFrame:
    """``(path, conv_id, n, ends)`` of ``convs (path, conv_id)``: members of equal
    conversations, their smallest id, number, and digest of the sorted ids. Ids stream through
    the digest in sorted order; none are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first, n, digest = None, None, 0, None

        def row(out):
            out.append((path, first, n, digest.hexdigest()))

        for batch in batches:
            out: list[tuple] = []
            for p, c in zip(*(x.to_pylist() for x in batch.columns)):
                if p != path:
                    if path is not None:
                        row(out)
                    path, first, n, digest = p, c, 0, hashlib.sha256()
                digest.update(f",{c}".encode() if n else str(c).encode())
                n += 1
            yield _members_batch(out)
        last: list[tuple] = []
        if path is not None:
            row(last)
        yield _members_batch(last)

    return convs.select("path", "conv_id").repartition("path").sortWithinPartitions(
        "path", "conv_id").mapInArrow(run, "path string, conv_id long, n long, ends string")


def _members_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(),
                                                  pa.string()))],
        names=["path", "conv_id", "n", "ends"])


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct sequences of ``convs (conv_id, turns)``: ``(path, tids, lens, conv_id, n,
    ends)``, conv_id being the smallest member."""
    tids = F.transform("turns", lambda t: t["tid"])
    convs = materialise(convs.select(
        "conv_id", tids.alias("tids"), F.transform("turns", lambda t: t["len"]).alias("lens"))
        .withColumn("path", _prefix(F.col("tids"), F.size("tids"))), "trie-convs")
    return convs.join(_members(convs), ["path", "conv_id"])


def burst(seqs: DataFrame, container: int = CONTAINER) -> tuple[DataFrame, list[DataFrame]]:
    """Containers ``(head, depth, path, tids, lens, conv_id, n, ends)`` of at most ``container``
    sequences, and for each round the sequences of the containers that burst in it, with ``next``,
    the head they moved on to (null for one that ended at the burst head)."""
    weight = F.count(F.lit(1))
    state = seqs.withColumns({"head": F.lit(ROOT), "depth": F.lit(0)})
    left, closed, rounds = state.count(), [], []
    if left <= container:
        return state, []
    while True:
        if rounds:
            big = state.groupBy("head").agg(weight.alias("w")).where(
                F.col("w") > container).select("head", F.lit(True).alias("big"))
            state = state.join(big, "head", "left")
        else:
            state = state.withColumn("big", F.lit(True))
        more = F.size("tids") > F.col("depth")
        state = materialise(state.withColumn("next", F.when(
            F.col("big") & more, _prefix(F.col("tids"), F.col("depth") + 1))), "trie-burst")
        closed.append(state.where("big IS NULL").drop("big", "next"))
        moved = state.where("big")
        if moved.limit(1).count() == 0:
            break
        rounds.append(moved.drop("big"))
        state = moved.where("next IS NOT NULL").withColumns(
            {"head": F.col("next"), "depth": F.col("depth") + 1}).drop("big", "next")
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out, rounds


def sweep(rows: list[tuple]) -> list[list]:
    """Nodes of one container of sorted distinct ``(tids, lens, depth, conv_id, n, ends)``,
    head first: ``[path, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved, ends]``; the head's parent_conv_id is left open."""
    nodes: list[list] = []
    stack: list[tuple[int, "hashlib._Hash"]] = []      # (node, digest of its path)
    before: tuple = ()

    def close(depth: int) -> None:
        """Fold the open nodes below the stack's first ``depth`` into their parents."""
        while len(stack) > depth:
            node = nodes[stack.pop()[0]]
            if stack:
                above = nodes[stack[-1][0]]
                above[3] = min(above[3], node[3])
                above[5] += node[5]
                above[6] += 1

    lengths: list[int] = []
    parents: list[int] = []
    for tids, lens, top, conv, n, ends in rows:
        if not stack:
            digest = hashlib.md5(bytes.fromhex("".join(tids[:top])))
            parent = hashlib.md5(bytes.fromhex("".join(tids[:top - 1]))).hexdigest() \
                if top else None
            nodes.append([digest.hexdigest(), parent, top, conv, None, 0, 0, 0, 0, EMPTY_SHA])
            lengths.append(lens[top - 1] if top else 0)
            parents.append(-1)
            stack.append((0, digest))
        same = top
        while same < len(before) and same < len(tids) and before[same] == tids[same]:
            same += 1
        close(same - top + 1)
        for depth in range(same, len(tids)):
            above, digest = stack[-1][0], stack[-1][1].copy()
            digest.update(bytes.fromhex(tids[depth]))
            nodes.append([digest.hexdigest(), nodes[above][0], depth + 1, conv, None, 0, 0, 0,
                          0, EMPTY_SHA])
            lengths.append(lens[depth])
            parents.append(above)
            stack.append((len(nodes) - 1, digest))
        end = nodes[stack[-1][0]]
        end[3], end[5], end[9] = min(end[3], conv), end[5] + n, ends
        before = tids
    close(0)
    for i, node in enumerate(nodes):    # a node without children is a leaf
        node[7] = 0 if node[6] else 1
        node[8] = (node[5] - 1) * lengths[i]
    for i in range(len(nodes) - 1, 0, -1):      # parents come before their children
        above = nodes[parents[i]]
        above[7] += nodes[i][7]
        above[8] += nodes[i][8]
        nodes[i][4] = above[3]
    return nodes


def _swept(containers: DataFrame) -> DataFrame:
    """Nodes of all containers; a container's head has a null parent_conv_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []
        for batch in batches:
            out: list[list] = []
            for h, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if h != head:
                    out += sweep(held)
                    head, held = h, []
                held.append(row)
            yield _nodes_batch(out)
        yield _nodes_batch(sweep(held))

    return containers.select("head", "tids", "lens", "depth", "conv_id", "n", "ends") \
        .repartition("head").sortWithinPartitions("head", "tids").mapInArrow(run, _NODE)


def _nodes_batch(nodes: list[list]) -> pa.RecordBatch:
    s, i = pa.string(), pa.int64()
    columns = list(zip(*nodes)) if nodes else [()] * 10
    names = [c.split(" ")[0] for c in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (s, s, i, i, i, i, i, i, i, s))], names=names)


def nodes(turns: DataFrame, container: int = CONTAINER, **columns: str) -> DataFrame:
    """Nodes of the trie over rebuilt conversations: ``(path, parent, depth, conv_id,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    Ties in turn numbers, nulls and rows without a conversation: see :func:`turn_lists`.
    Repeated rows are turns of their own. An empty table gives no node, not even a root, as it
    has no conversation.
    """
    return trie_of(rebuild(turn_lists(turns, **columns)), container)


def trie_of(convs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The trie of ``convs (conv_id, turns)``, one row per conversation."""
    seqs = materialise(sequences(convs), "trie-sequences")
    containers, rounds = burst(seqs, container)
    swept = materialise(_swept(containers), "trie-nodes")
    if not rounds:
        return swept
    tops = swept.where("parent_conv_id IS NULL")
    burst_nodes = []
    for moved in reversed(rounds):
        # the burst heads of a round, from the sequences that passed and the heads below
        own = moved.groupBy("head").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
            F.max("depth").cast("long").alias("depth"),
            F.max(F.when(F.col("next").isNull(), F.col("ends"))).alias("ends"),
            F.max(F.when(F.col("depth") > 0, F.element_at("lens", F.greatest(
                F.col("depth"), F.lit(1))))).alias("len"),
            F.max(F.when(F.col("depth") > 0, _prefix(F.col("tids"), F.col("depth") - 1)))
            .alias("parent"))
        below = tops.groupBy(F.col("parent").alias("head")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved"))
        done = materialise(own.join(below, "head", "left").select(
            F.col("head").alias("path"), "parent", "depth", "conv_id",
            F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0).cast("long"))
             + (F.col("n_convs") - 1) * F.coalesce("len", F.lit(0).cast("long")))
            .alias("saved_tokens"),
            F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256")), "trie-heads")
        burst_nodes.append(done)
        tops = tops.unionByName(done)
    heads = burst_nodes[0]
    for part in burst_nodes[1:]:
        heads = heads.unionByName(part)
    # only heads hang under burst heads; all other nodes know their parent already
    open_nodes = tops.drop("parent_conv_id").join(
        heads.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id")),
        "parent", "left")
    inner = swept.where("parent_conv_id IS NOT NULL")
    return inner.unionByName(open_nodes)


def digest(found: DataFrame) -> DataFrame:
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                        "n_leaves", "saved_tokens", "ends_sha256")
