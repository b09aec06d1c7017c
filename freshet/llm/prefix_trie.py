"""Prefix trie of conversations, with count-min screening of prefixes that nobody shares.

A node of the trie is a distinct sequence of first turns; conversations that begin with it are its
members. Each turn is hashed once and only hashes are moved: the digest of a prefix is the
exclusive or of 128-bit hashes of its turns, each keyed by its place, so running digests are a
window sum. A count-min sketch counts the digests of all prefixes. Its estimates are never too
low, so an estimate of one proves that a prefix has one member, and all that follows it as well:
that tail of the conversation is emitted where it is. Only the prefixes before, and the first
proven one, are shuffled and grouped exactly.

Sums over subtrees need no walk over the tree. The least member of a node represents it; a
conversation represents all its prefixes from some depth on. What a node saves below it is the sum,
over its members, of the bytes between the node and the first prefix that the member represents,
and its leaves are those of its members that represent a leaf. Both are partial aggregates by digest,
so a node that all conversations share is no task of its own. A conversation of any length is
read row by row.

The sketch has about four cells for each turn and row, up to `MOST_CELLS` in a row; it is built from sparse
blocks and only a bit per cell reaches the driver and the tasks (32 MB at most). A fuller sketch
proves less and lets more rows be grouped; results do not change.

Defined cases: rows without a conversation are left out; a null role or text is empty; a null turn
comes first; equal turns of a conversation follow the order of their roles, then of a hash of
their texts; repeated rows are turns of their own; an empty table has no node, not even a root;
further columns are ignored. Conversations are numbered by integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import cut_lineage

#: Rows of the sketch, and the least and the most cells in a row (powers of two).
SKETCH_ROWS = 4
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 26
#: Cells of the sketch that are added up together.
BLOCK = 1 << 16
#: Ids that one piece of a list of ends spans.
PIECE_IDS = 512


def ordered_turns(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, pos, a, b, bytes): place of each turn from 1, two hashes of role and text, bytes of the text."""
    role_of, text_of = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    hashed = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("_turn"), role_of.alias("_role"),
        F.xxhash64(role_of, text_of).alias("a"), F.xxhash64(F.lit(1), role_of, text_of).alias("b"),
        F.octet_length(text_of).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("_turn").asc_nulls_first(), "_role", "a", "b")
    return hashed.withColumn("pos", F.row_number().over(order).cast("long")).select("conv", "pos", "a", "b", "bytes")


def with_roots(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """`turns` and the empty prefix, place 0, of every conversation in `convs` (conv)."""
    zero = F.lit(0).cast("long")
    return turns.unionByName(convs.select("conv", *(zero.alias(c) for c in ("pos", "a", "b", "bytes"))))


def prefix_rows(turns: DataFrame) -> DataFrame:
    """One row per prefix of each conversation, in order, from turns with roots.

    (conv, d, p1, p2 digest, q1, q2 digest of the parent, before, bytes, len, total): `before` are the
    bytes of the turns before the last one of the prefix, `len` and `total` turns and bytes of the conversation.
    """
    order = Window.partitionBy("conv").orderBy("pos")
    until, whole = (order.rowsBetween(Window.unboundedPreceding, k) for k in (Window.currentRow, Window.unboundedFollowing))
    numbered = turns.select("conv", "pos", (F.row_number().over(order) - 1).cast("long").alias("d"), "a", "b", "bytes")
    first, second = F.xxhash64("d", "a", "b"), F.xxhash64(F.lit(1), "d", "a", "b")
    own = numbered.select("conv", "pos", "d", "bytes", *(F.when(F.col("d") > 0, x).otherwise(0).alias(n) for n, x in (("x1", first), ("x2", second))))
    rows = own.select(
        "conv", "d", *(F.bit_xor(x).over(until).alias(p) for x, p in (("x1", "p1"), ("x2", "p2"))), "x1", "x2", "bytes",
        F.sum("bytes").over(until).alias("cum"), F.max("d").over(whole).alias("len"), F.sum("bytes").over(whole).alias("total"),
    )
    return rows.select(
        "conv", "d", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"),
        (F.col("cum") - F.col("bytes")).alias("before"), "bytes", "len", "total",
    )


def cells(p1: np.ndarray, p2: np.ndarray, width: int) -> np.ndarray:
    """Cell of each digest in each row of the sketch, as (rows, digests)."""
    first, step = p1.view(np.uint64), p2.view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(first + np.uint64(r) * step) % np.uint64(width) + np.uint64(r * width) for r in range(SKETCH_ROWS)])


def count_min(rows: DataFrame, width: int) -> np.ndarray:
    """The sketch over the digests of `rows` (p1, p2): a bit per cell, set if it counts two or more."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = np.unique(cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), width), return_counts=True)
            blocks, starts = np.unique(at // BLOCK, return_index=True)
            low, n = (at % BLOCK).astype(np.uint16), np.minimum(n, 2).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(blocks.astype(np.int32)), pa.array([x.tobytes() for x in np.split(low, starts[1:])] if len(blocks) else [], pa.binary()),
                    pa.array([x.tobytes() for x in np.split(n, starts[1:])] if len(blocks) else [], pa.binary()),
                ],
                ["block", "at", "n"],
            )

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            total += np.bincount(np.frombuffer(at, np.uint16), np.frombuffer(n, np.uint8), BLOCK).astype(np.int64)
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(total > 1).tobytes()], pa.binary())})

    merged = rows.select("p1", "p2").mapInArrow(parts, "block int, at binary, n binary").groupBy("block").applyInArrow(added, "block int, bits binary")
    out = np.zeros(-(-SKETCH_ROWS * width // BLOCK) * BLOCK // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row.block * BLOCK // 8:(row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def screen(rows: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """`rows` with `tail`: true behind the first prefix of a conversation that the sketch proves unshared.

    The rows of a conversation lie together and in order, as `prefix_rows` leaves them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, proven = None, np.iinfo(np.int64).max
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = cells(batch.column(2).to_numpy(), batch.column(3).to_numpy(), width)
            several = shared.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            first = np.minimum.reduceat(np.where(several.min(axis=0) == 0, d, np.iinfo(np.int64).max), starts)
            if conv[0] == last:
                first[0] = min(first[0], proven)
            last, proven = conv[-1], first[-1]
            tail = d > np.repeat(first, np.diff(np.append(starts, len(conv))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail)], [*batch.schema.names, "tail"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in rows.columns) + ", tail boolean")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(p1, p2, sha): SHA-256 of the ascending ids in `ends` (p1, p2, conv), comma-joined.

    Ids are joined in pieces of bounded span by any task; the pieces of a node are then hashed one
    after the other as they come sorted, so no list of ids is held.
    """
    pieces = ends.groupBy("p1", "p2", F.floor(F.col("conv") / PIECE_IDS).alias("at")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("piece")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None
        for batch in batches:
            out = []
            for key, piece in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
                if key == open_key:
                    state.update(b"," + piece.encode())
                else:
                    if state:
                        out.append((*open_key, state.hexdigest()))
                    open_key, state = key, hashlib.sha256(piece.encode())
            yield named(out)
        if state:
            yield named([(*open_key, state.hexdigest())])

    def named(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["p1", "p2", "sha"])

    return pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "at").select("p1", "p2", "piece").mapInArrow(run, "p1 long, p2 long, sha string")


def _sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def trie_nodes(turns: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per node, from turns with roots (see `with_roots`).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and local (true for nodes that were proven unshared and never grouped).
    """
    rows = cut_lineage(prefix_rows(turns))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("root")).first()
    width = LEAST_CELLS
    while width < min(4 * found.n, most_cells):
        width *= 2
    screened = cut_lineage(screen(rows, count_min(rows, width), width))
    tails = screened.where("tail").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("d") == F.col("len"), _sha(F.col("conv").cast("string"))).otherwise(_sha(F.lit(""))).alias("ends_sha256"), F.lit(True).alias("local"),
    )

    shared = screened.where("not tail")
    at_end = F.col("d") == F.col("len")
    nodes = shared.groupBy("p1", "p2").agg(
        F.min("conv").alias("conv"), F.min("d").alias("d"), F.count(F.lit(1)).alias("n"), F.sum(at_end.cast("long")).alias("n_end"),
        F.min("before").alias("before"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
    )
    nodes = cut_lineage(nodes)
    # Of each conversation that represents nodes: bytes ahead of the first of them, and whether one is a leaf or above a single one.
    represents = nodes.groupBy(F.col("conv").alias("_conv")).agg(
        F.min("before").alias("_upto"), F.max((F.col("n") == F.col("n_end")) | (F.col("n") == 1)).alias("_leaf")
    )
    member = shared.join(represents, shared["conv"] == represents["_conv"], "left")
    saved = F.greatest(F.coalesce("_upto", "total") - F.col("before"), F.lit(0))
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))

    def part(df: DataFrame, **given: Column) -> DataFrame:
        kinds = {"conv": "long", "d": "long", "n": "long", "leaves": "long", "saved": "long", "children": "long", "sha": "string", "parent": "long"}
        return df.select("p1", "p2", *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))

    one = F.lit(1)
    top = F.lit(found.root).cast("long")
    merged = (
        part(nodes, conv=F.col("conv"), d=F.col("d"), n=F.col("n"), parent=F.when(F.col("d") == 1, top))
        .unionByName(part(member, leaves=F.coalesce("_leaf", F.lit(False)).cast("long"), saved=saved))
        .unionByName(part(nodes.where("d > 0").select(F.col("q1").alias("p1"), F.col("q2").alias("p2")), children=one))
        .unionByName(part(nodes.where("d > 1").select("p1", "p2", "q1", "q2").join(parents, ["q1", "q2"]), parent=F.col("parent")))
        .unionByName(part(ends_digest(shared.where(at_end).select("p1", "p2", "conv")), sha=F.col("sha")))
    )
    grouped = merged.groupBy("p1", "p2").agg(
        F.max("conv").alias("conv_id"), F.max("d").alias("depth"), F.max("parent").alias("parent_conv_id"), F.max("n").alias("n_convs"),
        # The first prefix proven unshared has its only child, if any, among the tails.
        F.coalesce(F.sum("children"), F.lit(0)).alias("_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("sha").alias("_sha"),
    )
    alone = (F.col("n_convs") == 1) & F.col("_sha").isNull()
    exact = grouped.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.when(alone, 1).otherwise(F.col("_children")).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("_sha", _sha(F.lit(""))).alias("ends_sha256"), F.lit(False).alias("local"),
    )
    return exact.unionByName(tails)


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_cells: int = MOST_CELLS
) -> DataFrame:
    """The trie of all conversations of a table; see `trie_nodes`."""
    turns = ordered_turns(conversations, conv, turn, role, text)
    return trie_nodes(with_roots(turns, turns.select("conv").distinct()), most_cells)
