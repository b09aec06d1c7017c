"""Ranked lexical search with two trees: the best documents of every item, by weighted terms.

`build_index` turns the documents into shards of postings: for each term (by a 64-bit hash) the
documents of the shard that hold it and how often. The index is kept in the checkpoint folder and
does not depend on what is searched. Items come in blocks with a bounded number of terms; for a
block the document counts of its terms are added up over all shards, then every shard is searched.

Inside a shard the items and the documents form one binary tree each. A node holds, for every term,
the largest weight of its items or the largest impact of its documents, so the product of two
nodes bounds the score of any pair below them. The trees are walked together; a pair of nodes is
left out if its bound is below the weakest k-th score of the items under it, which no document there
can then beat. Pairs of leaves are scored exactly. The k-th scores grow from shard to shard of a
task, and start from those of a first pass over a part of the shards, so most batches of documents
are never scored. Bounds are sums of integers below 2 ** 53 in doubles, hence exact.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms with tf of them equal
to the term has the impact (10^9 tf) div (1000 tf + 8 m), where m = 10 + (90 n N) div L. N counts the
documents with a term, L all terms.

Terms are runs of letters, digits and non-ASCII characters with A-Z lower-cased. Defined cases: a
null or empty text has no terms and is never found; an item without terms finds nothing; repeated
documents are ranked one by one, repeated items each get a list; equal scores follow the key, a
null key comes last; empty tables give no rows; further columns are ignored. Two different terms
share a hash with a probability of 2 ** -64 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from freshet.llm.arrow_text import slices, word_table, words
from freshet.session import cut_lineage

#: Documents in a shard at most, besides the bytes of a slice.
SHARD_DOCS = 8192
#: Documents and items in a leaf.
DOC_LEAF, ITEM_LEAF = 32, 4
#: Terms and items of a block, at most (one item at least).
BLOCK_TERMS, BLOCK_ITEMS = 4096, 1024
#: The first pass takes one of so many shards.
FIRST_PASS = 16

INDEX = "shard long, n array<int>, terms array<long>, ends array<int>, docs array<int>, tf array<int>"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Index shards, one row per run of whole documents: keys, n (terms of each), and postings by term."""
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    table = word_table()

    def shard(part: pa.RecordBatch) -> pa.RecordBatch:
        found = words(part.column(1), table)
        names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.names), np.uint64, len(found.names)).view(np.int64)
        terms = np.unique(names)
        rank = np.searchsorted(terms, names)[found.codes] if len(names) else np.zeros(0, np.int64)
        size = max(part.num_rows, 1)
        posted, tf = np.unique(rank * size + found.doc, return_counts=True)
        ends = np.cumsum(np.bincount(posted // size, minlength=len(terms)))
        number = xxhash.xxh3_64_intdigest(terms.tobytes() + found.bounds.tobytes()) >> 1

        def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)), pa.array([number], pa.int64()),
                listed(np.diff(found.bounds).astype(np.int32), pa.int32()), listed(terms, pa.int64()), listed(ends.astype(np.int32), pa.int32()),
                listed((posted % size).astype(np.int32), pa.int32()), listed(tf.astype(np.int32), pa.int32()),
            ],
            ["keys", *(f.strip().split(" ")[0] for f in INDEX.split(","))],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                for at in range(0, part.num_rows, SHARD_DOCS):
                    yield shard(part.slice(at, SHARD_DOCS))

    kind = slim.schema["_key"].dataType.simpleString()
    return cut_lineage(slim.mapInArrow(run, f"keys array<{kind}>, {INDEX}"))


@dataclass
class Block:
    """Some items: their ids, and their distinct terms as places in `terms` (sorted hashes)."""

    ids: list
    terms: np.ndarray
    items: list[np.ndarray]


def item_terms(text: str | None) -> list[int]:
    return sorted({xxhash.xxh3_64_intdigest(w) - (1 << 64 if xxhash.xxh3_64_intdigest(w) >> 63 else 0) for w in (text or "").encode().translate(word_table()).split()})


def item_blocks(items: DataFrame, key: str, text: str, most_terms: int = BLOCK_TERMS, most_items: int = BLOCK_ITEMS) -> Iterator[Block]:
    """The items in blocks; the driver holds one block at a time."""
    ids, held, union = [], [], set()

    def block() -> Block:
        terms = np.array(sorted(union), np.int64)
        return Block(ids, terms, [np.searchsorted(terms, x) for x in held])

    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        found = item_terms(row.t)
        if not found:
            continue
        if ids and (len(ids) >= most_items or len(union | set(found)) > most_terms):
            yield block()
            ids, held, union = [], [], set()
        ids.append(row.k)
        held.append(np.array(found, np.int64))
        union |= set(found)
    if ids:
        yield block()


class Shard:
    """Postings of one index row, cut to the terms of a block."""

    def __init__(self, batch: pa.RecordBatch, k: int, wanted: np.ndarray) -> None:
        def numbers(name: str) -> np.ndarray:
            return batch.column(batch.schema.get_field_index(name))[k].values.to_numpy(zero_copy_only=False)

        self.keys = batch.column(batch.schema.get_field_index("keys"))[k].values
        self.n = numbers("n").astype(np.int64)
        terms, ends = numbers("terms"), numbers("ends").astype(np.int64)
        at = np.searchsorted(terms, wanted)
        at[at == len(terms)] = 0
        self.here = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, np.int64)  # places in `wanted`
        at = at[self.here]
        starts = np.concatenate([[0], ends[:-1]])[at] if len(at) else at
        self.df = ends[at] - starts
        where = np.repeat(starts - np.concatenate([[0], np.cumsum(self.df)[:-1]]), self.df) + np.arange(int(self.df.sum())) if len(at) else at
        self.column = np.repeat(np.arange(len(at)), self.df)
        self.doc, self.tf = numbers("docs").astype(np.int64)[where], numbers("tf").astype(np.int64)[where]


def document_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents that hold each of `terms`, over all shards; as many numbers as terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch, k, terms)
                total[shard.here] += shard.df
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for row in index.mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], float)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of terms that occur `tf` times in documents of `n` terms; integers below 10^6."""
    most = (1 << 63) // (90 * n_docs) if n_docs else 0
    # Beyond 64 bits Python's integers take over; that needs a text of more terms than `most`.
    over = np.array([90 * int(x) * n_docs // n_terms for x in n], np.int64) if n.size and n.max() >= most else 90 * n * n_docs // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (10 + over))


def levels(rows: np.ndarray) -> list[np.ndarray]:
    """Coordinate maxima of a binary tree over `rows` (leaves, a power of two of them), from the root down."""
    out = [rows]
    while len(out[0]) > 1:
        out.insert(0, np.maximum(out[0][0::2], out[0][1::2]))
    return out


def leaf_count(n: int, leaf: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, -(-n // leaf)))))


class ItemTree:
    """Items of a block in the order of their weightiest term, with the maxima of each node."""

    def __init__(self, block: Block, weights: np.ndarray) -> None:
        self.weights = weights
        heaviest = [int(x[np.argmax(weights[x])]) for x in block.items]
        self.order = np.lexsort((heaviest, -weights[heaviest]))
        self.leaves = leaf_count(len(block.items), ITEM_LEAF)
        self.matrix = np.zeros((len(block.items), len(block.terms)))
        for place, k in enumerate(self.order):
            self.matrix[place, block.items[k]] = weights[block.items[k]]
        self.first_item = np.argmax(self.matrix > 0, axis=0)  # of each term, the first item that holds it
        padded = np.zeros((self.leaves * ITEM_LEAF, len(block.terms)))
        padded[:len(self.matrix)] = self.matrix
        self.levels = levels(padded.reshape(self.leaves, ITEM_LEAF, -1).max(axis=1))

    def weakest(self, least: np.ndarray) -> list[np.ndarray]:
        """The lowest of the k-th scores under each node, level by level."""
        padded = np.full(self.leaves * ITEM_LEAF, np.inf)
        padded[:len(least)] = least
        return [-x for x in levels(-padded.reshape(self.leaves, ITEM_LEAF).min(axis=1))]


class Best:
    """The k best documents of each item so far, in the order of the item tree."""

    def __init__(self, items: int, k: int, least: np.ndarray) -> None:
        self.k, self.lists = k, [[] for _ in range(items)]
        # A score must be above 0 and at least the k-th score known from elsewhere.
        self.least = np.maximum(least, 1.0)

    def add(self, item: int, scores: np.ndarray, keys: list) -> None:
        both = self.lists[item] + [(-int(s), key is None, key) for s, key in zip(scores, keys, strict=True)]
        self.lists[item] = sorted(both, key=lambda x: x[:2] if x[1] else x)[:self.k]
        if len(self.lists[item]) == self.k:
            self.least[item] = max(self.least[item], -self.lists[item][-1][0])


@dataclass
class Visits:
    """Pairs of leaves that were scored, and all there are."""

    scored: int = 0
    all: int = 0


def search_shard(shard: Shard, tree: ItemTree, best: Best, n_docs: int, n_terms: int, visits: Visits | None = None) -> None:
    """Walk both trees and put what can rank into `best`."""
    if not len(shard.here):
        return
    f = impacts(shard.tf, shard.n[shard.doc], n_docs, n_terms)
    # Documents in the order of the term that tells most in them, next to those of the same item, so leaves hold like documents.
    worth = f * tree.weights[shard.here][shard.column]
    by = np.lexsort((worth, shard.doc))
    last = np.flatnonzero(np.append(shard.doc[by][1:] != shard.doc[by][:-1], True))
    docs, top = shard.doc[by][last], shard.column[by][last]
    order = np.lexsort((-worth[by][last], top, tree.first_item[shard.here][top]))
    place = np.zeros(len(shard.n), np.int64)
    place[docs[order]] = np.arange(len(docs))
    docs = docs[order]
    at = place[shard.doc]
    leaves = leaf_count(len(docs), DOC_LEAF)
    lowest = np.zeros((leaves, len(shard.here)), np.float32)
    np.maximum.at(lowest, (at // DOC_LEAF, shard.column), f.astype(np.float32))
    down = levels(lowest)
    by_leaf = np.argsort(at // DOC_LEAF, kind="stable")
    edges = np.searchsorted((at // DOC_LEAF)[by_leaf], np.arange(leaves + 1))

    # Pairs of nodes, level by level from both roots; the tree that is at its leaves waits.
    depth = max(len(tree.levels), len(down))
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    weakest = tree.weakest(best.least)
    for step in range(depth):
        i, d = min(step, len(tree.levels) - 1), min(step, len(down) - 1)
        if step:
            if step < len(tree.levels):
                a, b = np.concatenate([2 * a, 2 * a + 1]), np.concatenate([b, b])
            if step < len(down):
                a, b = np.concatenate([a, a]), np.concatenate([2 * b, 2 * b + 1])
        bound = np.zeros(len(a))
        for node in np.unique(a):
            mine = np.flatnonzero(a == node)
            bound[mine] = down[d][b[mine]].astype(float) @ tree.levels[i][node][shard.here]
        alive = bound >= weakest[i][a]
        a, b, bound = a[alive], b[alive], bound[alive]
    if visits:
        visits.all += tree.leaves * leaves
    # Leaves with the highest bounds come first and raise the k-th scores for the rest.
    peak = np.zeros(leaves)
    np.maximum.at(peak, b, bound)
    for leaf in np.argsort(-peak, kind="stable"):
        mine = np.flatnonzero(b == leaf)
        if not len(mine):
            break
        items = (a[mine][:, None] * ITEM_LEAF + np.arange(ITEM_LEAF)).ravel()
        bounds = np.repeat(bound[mine], ITEM_LEAF)[items < len(tree.matrix)]
        items = items[items < len(tree.matrix)]
        items = items[bounds >= best.least[items]]
        if not len(items):
            continue
        if visits:
            visits.scored += len(np.unique(items // ITEM_LEAF))
        posted = by_leaf[edges[leaf]:edges[leaf + 1]]
        dense = np.zeros((DOC_LEAF, len(shard.here)))
        dense[at[posted] % DOC_LEAF, shard.column[posted]] = f[posted]
        scores = tree.matrix[items][:, shard.here] @ dense.T
        fit = scores >= best.least[items][:, None]
        for row in np.flatnonzero(fit.any(axis=1)):
            found = np.flatnonzero(fit[row])
            keys = shard.keys.take(pa.array(docs[leaf * DOC_LEAF + found], pa.int64())).to_pylist()
            best.add(int(items[row]), scores[row][found], keys)


def search_block(index: DataFrame, block: Block, k: int, n_docs: int, n_terms: int, kind: str, first_pass: int = FIRST_PASS) -> DataFrame:
    """(item, key, score): at least the k best documents of each item of a block; `item` is its place."""
    weights = term_weights(document_counts(index, block.terms), n_docs)
    context = index.sparkSession.sparkContext
    shared = context.broadcast((block, weights))

    def best_of(part: DataFrame, least: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, weights = shared.value
            tree = ItemTree(block, weights)
            best = Best(len(block.ids), k, least[tree.order])
            for batch in batches:
                for j in range(batch.num_rows):
                    search_shard(Shard(batch, j, block.terms), tree, best, n_docs, n_terms)
            rows = [(int(tree.order[p]), key, -score) for p, found in enumerate(best.lists) for score, _, key in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], key_type), pa.array([r[2] for r in rows], pa.int64())], ["item", "key", "score"]
            )

        return part.mapInArrow(run, f"item int, key {kind}, score long")

    key_type = to_arrow_type(index.schema["keys"].dataType.elementType)
    chosen = F.col("shard") % first_pass == 0
    early = cut_lineage(ranked(best_of(index.where(chosen), np.zeros(len(block.ids))), k))
    # The k-th score of the first pass holds for all documents: k of them reach it.
    least = np.zeros(len(block.ids))
    for row in early.where(F.col("rank") == k).select("item", "score").collect():
        least[row.item] = row.score
    return early.drop("rank").unionByName(best_of(index.where(~chosen), least))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """`found` (item, key, score) cut to the k best of each item, with `rank` from 1."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", block_terms: int = BLOCK_TERMS, first_pass: int = FIRST_PASS,
) -> DataFrame:
    """One row per item and rank: item_key, rank (1 to k), key, score above 0."""
    index = build_index(docs, key, text)
    kind = index.schema["keys"].dataType.elementType.simpleString()
    counts = index.select(F.size(F.filter("n", lambda x: x > 0)).cast("long").alias("d"), F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("t"))
    n_docs, n_terms = counts.agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    id_kind = items.schema[item_key].dataType
    spark = index.sparkSession
    parts = []
    for block in item_blocks(items, item_key, item_text, block_terms) if n_docs else ():
        best = ranked(search_block(index, block, k, n_docs, n_terms, kind, first_pass), k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, `_id` {id_kind.simpleString()}")
        parts.append(best.join(F.broadcast(names), "item").select(F.col("_id").alias(item_key), "rank", F.col("key").alias(key), "score"))
    if not parts:
        return spark.createDataFrame([], f"`{item_key}` {id_kind.simpleString()}, rank int, `{key}` {kind}, score long")
    # Blocks are joined two by two, so the plan stays shallow.
    while len(parts) > 1:
        parts = [x[0].unionByName(x[1]) if len(x) > 1 else x[0] for x in (parts[i:i + 2] for i in range(0, len(parts), 2))]
    return parts[0]
