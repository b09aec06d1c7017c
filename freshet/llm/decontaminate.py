"""Benchmark decontamination with a distributed positional inverted index.

`build_index` turns the documents into shards. A shard holds the postings of all its words: for each
term the ascending positions at which it occurs, counted over the documents of the shard with a
gap between documents. The index is kept in the checkpoint folder, does not depend on what is searched
and may be searched any number of times. A search takes the test items in blocks of bounded size;
inside each shard the windows whose words all occur are looked up by their rarest term, and its
postings are intersected with the offset-adjusted lists of the next rarer ones, step by step for all
windows together. No posting is shuffled, so a term that a third of all documents share costs each
shard its own share only.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A window is
`width` consecutive words of an item; an item of fewer words is one window.

Defined cases: a null text has no words; an item without words has no window; repeated rows are
searched one by one; a null item id is written as an empty string; no documents give no rows and
no items give rows without hits. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.arrow_text import slices, word_table
from freshet.session import cut_lineage

WIDTH = 13
#: Bytes of item texts in a block, and blocks that one pass over the index searches.
BLOCK_BYTES = 4 << 20
BLOCKS_AT_ONCE = 4
#: Bytes of text in an index shard, one document at least.
SHARD_BYTES = 2 << 20
#: Positions that are looked up at once.
CANDIDATES = 1 << 20
#: Bytes that valid UTF-8 never has; stands between two documents.
BREAK = b"\xff"

INDEX = (
    "n_words array<int>, starts array<int>, terms array<binary>, ends array<int>, positions array<int>, "
    "hit_starts array<int>, hit_ends array<int>, item_docs array<int>, item_ids array<string>"
)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(word_table()).split()


@dataclass
class Block:
    """Windows of some items: word tuples and the items that have them."""

    windows: dict[tuple[bytes, ...], set[str]] = field(default_factory=dict)
    size: int = 0

    def add(self, item: object, text: str | None, width: int) -> None:
        found = split_words(text)
        self.size += len(text or "")
        name = "" if item is None else str(item)
        for k in range(max(1, len(found) - width + 1) if found else 0):
            self.windows.setdefault(tuple(found[k:k + width]), set()).add(name)

    def arrays(self) -> tuple[list[bytes], list[tuple[np.ndarray, list[list[str]]]]]:
        """The terms, and for each length of windows their terms by number (a row each) with the items that have them."""
        terms = sorted({w for window in self.windows for w in window})
        number = {w: k for k, w in enumerate(terms)}
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for window in self.windows:
            by_length.setdefault(len(window), []).append(window)
        return terms, [
            (np.array([[number[w] for w in window] for window in same], np.int32), [sorted(self.windows[window]) for window in same])
            for same in by_length.values()
        ]


def item_blocks(items: DataFrame, key: str, text: str, width: int, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of about `most` bytes; the driver holds one block at a time."""
    block = Block()
    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        block.add(row.k, row.t, width)
        if block.size >= most:
            yield block
            block = Block()
    if block.windows:
        yield block


def _lists(values: list[np.ndarray | list], kind: pa.DataType) -> pa.Array:
    return pa.array([v.tolist() if isinstance(v, np.ndarray) and kind == pa.binary() else v for v in values], pa.list_(kind))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Index shards of whole documents, one row per run of a few MB of text."""
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    table = word_table()

    def shard(part: pa.RecordBatch) -> pa.RecordBatch:
        # Each text is followed by a break, so windows never run over its end.
        texts = [(t or "").encode() for t in part.column(1).to_pylist()]
        tokens = (b" " + BREAK + b" ").join([*texts, b""]).translate(table).split()
        names = sorted(set(tokens) - {BREAK})
        number = {w: k for k, w in enumerate(names, 1)}
        number[BREAK] = -1
        ids = np.fromiter(map(number.get, tokens, repeat(0)), np.int32, len(tokens))
        breaks = np.flatnonzero(ids == -1)
        starts = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
        # Positions in order of term: the postings lists, one after the other.
        listed = np.flatnonzero(ids > 0)
        counts = np.bincount(ids[listed], minlength=len(names) + 1)[1:]
        positions = listed[np.argsort(ids[listed], kind="stable")].astype(np.int32)
        here = np.flatnonzero(counts)
        none = np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)),
                _lists([(breaks - starts).astype(np.int32)], pa.int32()), _lists([starts.astype(np.int32)], pa.int32()),
                pa.array([[names[k] for k in here]], pa.list_(pa.binary())),
                _lists([np.cumsum(counts[here]).astype(np.int32)], pa.int32()), _lists([positions], pa.int32()),
                _lists([none], pa.int32()), _lists([none], pa.int32()), _lists([none], pa.int32()), pa.array([[]], pa.list_(pa.string())),
            ],
            ["keys", *(f.strip().split(" ")[0] for f in INDEX.split(","))],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SHARD_BYTES):
                yield shard(part)

    kind = slim.schema["_key"].dataType.simpleString()
    return cut_lineage(slim.mapInArrow(run, f"keys array<{kind}>, {INDEX}"))


class Shard:
    """Postings of one index row."""

    def __init__(self, row: dict[str, pa.ListScalar]) -> None:
        def numbers(name: str) -> np.ndarray:
            return row[name].values.to_numpy(zero_copy_only=False)

        self.n_words, self.starts, self.positions = numbers("n_words"), numbers("starts"), numbers("positions")
        self.ends = numbers("ends").astype(np.int64)
        self.sizes = np.diff(self.ends, prepend=0)
        self.rank = {w: k for k, w in enumerate(row["terms"].values.to_pylist())}
        self.total = int(self.n_words.sum()) + len(self.n_words)
        # Positions of all lists, each list in a range of its own.
        self.keys = np.repeat(np.arange(len(self.sizes)), self.sizes) * self.total + self.positions

    def postings(self, term: bytes) -> np.ndarray:
        k = self.rank[term]
        return self.positions[self.ends[k] - self.sizes[k]:self.ends[k]]

    def size(self, term: bytes) -> int:
        return int(self.sizes[self.rank[term]]) if term in self.rank else 0

    def ranks(self, terms: list[bytes]) -> np.ndarray:
        """Place of each term among those of the shard, -1 if it has none."""
        return np.fromiter((self.rank.get(w, -1) for w in terms), np.int64, len(terms))

    def occurrences(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, position) pairs at which rows of `windows` (ranks of terms) start, for some rows after the other.

        Each row begins with the postings of its rarest term; what is left of them is looked up in the next
        rarer list at its offset. Lists lie one behind the other, so one sorted array answers for all rows.
        """
        rows = np.flatnonzero((windows >= 0).all(axis=1))
        sizes = self.sizes[windows[rows]]
        order = np.argsort(sizes, axis=1, kind="stable")
        width = windows.shape[1]
        starts = np.cumsum(sizes[np.arange(len(rows)), order[:, 0]]) if len(rows) else np.zeros(0, np.int64)
        low = 0
        while low < len(rows):
            high = max(low + 1, int(np.searchsorted(starts, (starts[low - 1] if low else 0) + CANDIDATES, "right")))
            own, by = windows[rows[low:high]], order[low:high]
            first = own[np.arange(high - low), by[:, 0]]
            counts = self.sizes[first]
            at = np.repeat(np.arange(high - low), counts)
            begins = self.ends[first] - counts
            where = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(at))
            position = self.positions[where].astype(np.int64) - by[at, 0]
            fits = (position >= 0) & (position + width <= self.total)
            at, position = at[fits], position[fits]
            for k in range(1, width):
                if not len(at):
                    break
                offset = by[at, k]
                wanted = own[at, offset] * self.total + position + offset
                found = np.searchsorted(self.keys, wanted)
                found[found == len(self.keys)] = 0
                hit = self.keys[found] == wanted
                at, position = at[hit], position[hit]
            yield rows[low:high][at], position
            low = high

    def near(self, terms: list[bytes], reach: int) -> np.ndarray:
        """Positions of the rarest of `terms` that have all others within `reach` words in the same document."""
        order = sorted(set(terms), key=self.size)
        if not order or not self.size(order[0]):
            return np.zeros(0, np.int32)
        found = self.postings(order[0])
        home = np.searchsorted(self.starts, found, "right") - 1
        low = np.maximum(found - reach, self.starts[home])
        high = np.minimum(found + reach, self.starts[home] + self.n_words[home] - 1)
        keep = np.ones(len(found), bool)
        for term in order[1:]:
            if not self.size(term):
                return np.zeros(0, np.int32)
            listed = self.postings(term)
            keep &= np.searchsorted(listed, high, "right") > np.searchsorted(listed, low)
        return found[keep]

    def home(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, pa.ListScalar]]:
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}


Hits = tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]


def _hits(row: dict[str, pa.ListScalar], shared: list[Broadcast]) -> Hits:
    """Starts and ends of the hit runs of a shard and its (document, item) pairs: those it has and those of the blocks."""
    starts, ends = row["hit_starts"].values.to_numpy(), row["hit_ends"].values.to_numpy()
    pairs = list(zip(row["item_docs"].values.to_pylist(), row["item_ids"].values.to_pylist(), strict=True))
    if not shared:
        return starts, ends, pairs
    shard, found_pairs = Shard(row), set(pairs)
    edge = np.zeros(shard.total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    for block in shared:
        terms, groups = block.value
        ranks = shard.ranks(terms)
        for windows, names in groups:
            for at, found in shard.occurrences(ranks[windows]):
                np.add.at(edge, found, 1)
                np.add.at(edge, found + windows.shape[1], -1)
                each = np.unique(np.stack([shard.home(found), at]), axis=1)
                found_pairs.update((d, name) for d, k in each.T.tolist() for name in names[k])
    covered = np.diff(np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]]).astype(np.int8))
    return np.flatnonzero(covered == 1).astype(np.int32), np.flatnonzero(covered == -1).astype(np.int32), sorted(found_pairs)


def _search(index: DataFrame, shared: list[Broadcast]) -> DataFrame:
    """The index with the hits of some blocks of items added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(_rows(batch)):
                starts, ends, pairs = _hits(row, shared)
                kept = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept.columns[:-4], _lists([starts], pa.int32()), _lists([ends], pa.int32()),
                        _lists([[d for d, _ in pairs]], pa.int32()), pa.array([[name for _, name in pairs]], pa.list_(pa.string())),
                    ],
                    batch.schema.names,
                )

    return index.mapInArrow(run, index.schema)


def _documents(index: DataFrame, key: str, shared: list[Broadcast]) -> DataFrame:
    """Shards back to one row per document, the last blocks searched on the way, so postings are read and not passed on.

    Hits are word ranges within the document.
    """
    kind = index.schema["keys"].dataType.elementType.simpleString()
    schema = f"`{key}` {kind}, n_words long, n_hit long, hits array<struct<start:int,stop:int>>, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                starts, n_words = row["starts"].values.to_numpy(), row["n_words"].values.to_numpy()
                hit, stop, pairs = _hits(row, shared)
                home = np.searchsorted(starts, hit, "right") - 1
                spans: list[list[dict[str, int]]] = [[] for _ in starts]
                items: list[list[str]] = [[] for _ in starts]
                for d, a, b in zip(home.tolist(), hit.tolist(), stop.tolist(), strict=True):
                    spans[d].append({"start": a - int(starts[d]), "stop": b - int(starts[d])})
                for d, name in pairs:
                    items[d].append(name)
                yield pa.RecordBatch.from_arrays(
                    [
                        row["keys"].values, pa.array(n_words, pa.int64()),
                        pa.array(np.bincount(home, stop - hit, len(starts)).astype(np.int64)),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    [key, "n_words", "n_hit", "hits", "items"],
                )

    return index.mapInArrow(run, schema)


def phrase_matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: key, n_words, n_hit, hits (word ranges), items (ids with occurring windows)."""
    index = build_index(docs, key, text)
    context = index.sparkSession.sparkContext
    shared: list[Broadcast] = []
    for block in item_blocks(items, item_key, item_text, width, block_bytes):
        if len(shared) == BLOCKS_AT_ONCE:
            index, shared = cut_lineage(_search(index, shared)), []
        shared.append(context.broadcast(block.arrays()))
    return _documents(index, key, shared)


def proximity_matches(index: DataFrame, phrases: dict[str, list[str]], reach: int, key: str = "doc_id") -> DataFrame:
    """(key, phrase, position) where all words of a phrase lie within `reach` words of its rarest one.

    `phrases` names a bounded set of word lists; a phrase without words matches nothing.
    """
    kind = index.schema["keys"].dataType.elementType.simpleString()
    wanted = {name: [w for x in listed for w in split_words(x)] for name, listed in phrases.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                shard = Shard(row)
                keys = row["keys"].values
                for name, terms in wanted.items():
                    found = shard.near(terms, reach)
                    home = shard.home(found)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(home, pa.int64())), pa.array([name] * len(found), pa.string()), pa.array(found - shard.starts[home], pa.int32())],
                        [key, "phrase", "position"],
                    )

    return index.mapInArrow(run, f"`{key}` {kind}, phrase string, position int")


def judge(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """`phrase_matches` with `contaminated`: some word is hit, and hits are a twentieth of the words or more."""
    return phrase_matches(docs, items, **options).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options: object) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns."""
    bad = judge(docs, items, key=key, **options).where("contaminated").select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["_bad"]), "left_anti")
