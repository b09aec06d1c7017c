"""Near-duplicate join on word shingles with Bayesian pruning of candidates.

1. Every whole text becomes its set of `WIDTH`-word shingles; equal sets are one node. MinHash
   values of a node are cut into bands; nodes that agree in a band are candidates. With 24 bands
   of 4 values a pair at similarity 0.8 is missed with probability (1 - 0.8^4)^24 = 3e-6.
2. Members of a bucket are compared in tiles of bounded size: a bucket with many members is dealt
   into blocks, and each pair of blocks is a tile, so no task holds an unbounded group. A pair
   that shares several buckets is taken in the first one only.
3. In a tile MinHash values are compared a few at a time. With a uniform prior the similarity
   has a Beta posterior; a pair whose probability of reaching the threshold falls below the
   tolerance is dropped. The rest is verified on the exact sets.
4. A tile returns one row per linked node, with its number of links and the leader of its group in
   the tile: pairs are never written out. The groups are joined by connected components.

Words are runs without ASCII white space, A-Z lower-cased. Defined cases: a text of fewer than
`WIDTH` words is one shingle; null counts as empty, and texts without words are equal to each
other; repeated rows and equal sets share a node and count as no links; a null key is above all
others; empty tables give no rows; further columns are ignored (`keep_one` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.arrow_text import lower_table, mix, shingle_hashes, slices, text_bytes, words
from freshet.llm.components import components
from freshet.session import cut_lineage

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Values compared before each look at the posterior, and the probability below which a pair is dropped.
STEP = 16
TOLERANCE = 1e-5
#: Members of a block; a tile has two.
BLOCK = 1000
#: Pairs compared at once.
PAIRS = 1 << 17

_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(0, 1 << 31, (2, BANDS * ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def text_shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in order, and their n + 1 bounds; short texts have one shingle."""
    found = words(texts, lower_table())
    hashes = found.hashes()
    rolled, bounds = shingle_hashes(hashes, found.bounds, width)
    lengths = np.diff(found.bounds)
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if not len(short):
        return rolled, bounds
    extra = np.fromiter(
        (xxhash.xxh3_64_intdigest(hashes[found.bounds[d]:found.bounds[d + 1]].tobytes(), 1) for d in short), np.uint64, len(short)
    )
    rolled = np.insert(rolled, bounds[short], extra)
    counts = np.diff(bounds)
    counts[short] = 1
    return rolled, np.concatenate([[0], np.cumsum(counts)])


def minhashes(rolled: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (texts x BANDS * ROWS); a text without shingles has the largest values."""
    out = np.full((len(bounds) - 1, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        base = (rolled >> np.uint64(32)).astype(np.uint32) ^ rolled.astype(np.uint32)
        at = bounds[:-1][filled]
        for k in range(BANDS * ROWS):
            v = base * FACTORS[0, k] + OFFSETS[k]
            v ^= v >> np.uint32(16)
            v *= FACTORS[1, k]
            out[filled, k] = np.minimum.reduceat(v, at)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (texts x BANDS)."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS)).copy()
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys


def _binaries(values: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as binary values."""
    width = values.shape[1] * values.dtype.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int64) * width
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(offsets), data]).cast(pa.binary())


def _sets(rolled: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Sorted distinct shingles of each text, as bytes."""
    return [np.unique(rolled[a:b]).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, sig, bands) for each row: digest of the shingle set, MinHash values, band keys."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rolled, bounds = text_shingles(part.column(1))
                sig = minhashes(rolled, bounds)
                keys = band_keys(sig).view(np.int64)
                offsets = np.arange(len(keys) + 1, dtype=np.int32) * BANDS
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([xxhash.xxh3_128_digest(s) for s in _sets(rolled, bounds)], pa.binary()), _binaries(sig),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                    ],
                    ["key", "node", "sig", "bands"],
                )

    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return slim.mapInArrow(run, f"key {kind}, node binary, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, shingles) with the sorted set of each text as binary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = _sets(*text_shingles(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "node binary, shingles binary")


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n values that keep P(similarity >= threshold) at the tolerance or above.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at the threshold is
    the chance of at most m successes in n + 1 trials.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


class Tile:
    """Members of one or two blocks of a bucket."""

    def __init__(self, band: int, one: bool, side: np.ndarray, sig: np.ndarray, bands: np.ndarray, shingles: np.ndarray, bounds: np.ndarray) -> None:
        self.band, self.one, self.side, self.sig, self.bands, self.bounds = band, one, side, sig, bands, bounds
        self.ids = np.unique(shingles, return_inverse=True)[1]
        self.sizes = np.diff(bounds)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members that meet here first, a bounded number at a time."""
        n = len(self.side)
        other = np.arange(n) if self.one else np.flatnonzero(self.side == 1)
        mine = np.arange(n) if self.one else np.flatnonzero(self.side == 0)
        rows = max(1, PAIRS // max(1, len(other)))
        for at in range(0, len(mine), rows):
            a = np.repeat(mine[at:at + rows], len(other))
            b = np.tile(other, len(mine[at:at + rows]))
            if self.one:
                a, b = a[a < b], b[a < b]
            for t in range(self.band):
                here = self.bands[a, t]
                fresh = (here == 0) | (here != self.bands[b, t])
                a, b = a[fresh], b[fresh]
            yield a, b

    def likely(self, a: np.ndarray, b: np.ndarray, cuts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that the posterior leaves after each look."""
        matches = np.zeros(len(a), np.int32)
        for low, high, least in cuts:
            matches += (self.sig[a, low:high] == self.sig[b, low:high]).sum(1, dtype=np.int32)
            keep = matches >= least
            a, b, matches = a[keep], b[keep], matches[keep]
        return a, b

    def verified(self, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose exact similarity reaches the threshold."""
        if not len(a):
            return a, b
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        common = np.zeros(len(a), np.int64)
        mark = np.zeros(int(self.ids.max()) + 1 if len(self.ids) else 1, np.int8)
        firsts = np.flatnonzero(np.diff(a, prepend=-1))
        for low, high in zip(firsts.tolist(), [*firsts[1:].tolist(), len(a)], strict=True):
            own = self.ids[self.bounds[a[low]]:self.bounds[a[low] + 1]]
            mark[own] = 1
            partners = b[low:high]
            at = np.concatenate([np.arange(self.bounds[p], self.bounds[p + 1]) for p in partners.tolist()])
            starts = np.cumsum(self.sizes[partners]) - self.sizes[partners]
            common[low:high] = np.add.reduceat(mark[self.ids[at]].astype(np.int64), starts)
            mark[own] = 0
        union = self.sizes[a] + self.sizes[b] - common
        keep = common >= threshold * union - 1e-9
        return a[keep], b[keep]

    def links(self, threshold: float, cuts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.verified(*self.likely(a, b, cuts), threshold) for a, b in self.pairs()]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


def leaders(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the group of each of n members under the links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal (bucket, i, j) in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(key[:, low].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def tile_links(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, leader, links) for each linked node of each tile of `members`."""
    ends = [*range(STEP, BANDS * ROWS, STEP), BANDS * ROWS]
    cuts = [(e - STEP, e, least_matches(e, threshold, tolerance)) for e in ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tiles(batches):
            t = table.combine_chunks()
            column = {name: t.column(name).combine_chunks() for name in t.column_names}

            def fixed(name: str, kind: type, column: dict = column) -> np.ndarray:
                return text_bytes(column[name])[0].view(kind).reshape(t.num_rows, -1)

            raw, bounds = text_bytes(column["shingles"])
            tile = Tile(
                int(column["band"][0].as_py()), column["i"][0].as_py() == column["j"][0].as_py(), column["side"].to_numpy(),
                fixed("sig", np.uint32), fixed("kept", np.int64), raw.view(np.uint64), bounds // 8,
            )
            a, b = tile.links(threshold, cuts)
            if len(a):
                count = np.bincount(np.concatenate([a, b]), minlength=t.num_rows)
                linked = np.flatnonzero(count)
                nodes = column["node"]
                yield pa.RecordBatch.from_arrays(
                    [nodes.take(pa.array(linked)), nodes.take(pa.array(leaders(t.num_rows, a, b)[linked])), pa.array(count[linked], pa.int64())],
                    ["node", "leader", "links"],
                )

    return members.mapInArrow(run, "node binary, leader binary, links long")


def linked_nodes(docs: DataFrame, signed: DataFrame, threshold: float, tolerance: float, key: str, text: str) -> DataFrame:
    """(node, leader, links) over all tiles; `signed` is the table of `signatures`."""
    nodes = cut_lineage(signed.groupBy("node").agg(F.min("key").alias("key"), F.min_by("sig", F.col("node")).alias("sig"), F.min_by("bands", F.col("node")).alias("bands")))
    placed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    # Buckets with the same members bring the same pairs: one of them is enough.
    buckets = (
        placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
        .where("n > 1").groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket"))
    )
    chosen = cut_lineage(placed.join(buckets.select("bucket", "n"), "bucket"))
    kept = chosen.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("by_band"))
    # The chosen bucket of each band, 0 where there is none, as one binary value.
    packed = F.unhex(F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.lpad(F.hex(F.coalesce(F.try_element_at("by_band", b), F.lit(0).cast("long"))), 16, "0"),
    ), ""))
    kept = cut_lineage(kept.join(nodes.select("node", "key", "sig"), "node").select("node", "key", "sig", packed.alias("kept")))
    wanted = kept.select(F.col("key").alias("_wanted")).distinct()
    texts = docs.join(wanted, docs[key].eqNullSafe(wanted["_wanted"]), "left_semi")
    sets = shingle_sets(texts, key, text).join(kept.select("node"), "node", "left_semi").groupBy("node").agg(F.min("shingles").alias("shingles"))
    load = kept.select("node", "sig", "kept").join(sets, "node")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = chosen.withColumn("_n", blocks).withColumn("_mine", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    dealt = dealt.select("node", "bucket", "band", "_mine", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))
    dealt = dealt.select(
        "node", "bucket", F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"), "band",
        (F.col("_mine") > F.col("_other")).cast("int").alias("side"),
    )
    members = dealt.join(load, "node").select("bucket", "i", "j", "band", "side", "node", "sig", "kept", "shingles")
    parted = members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return cut_lineage(tile_links(parted, threshold, tolerance))


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, class_id (least key of its group), n_links (similar texts that differ), copy_of (least key of equal sets)."""
    signed = cut_lineage(signatures(docs, key, text))
    found = linked_nodes(docs, signed, threshold, tolerance, key, text)
    groups = components(found.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    nodes = signed.groupBy("node").agg(F.min("key").alias("copy_of"))
    placed = nodes.join(groups, "node", "left").join(links, "node", "left")
    placed = placed.select("node", "copy_of", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    named = placed.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    by_node = placed.join(named, "component").select("node", "class_id", "copy_of", "n_links")
    return signed.select("key", "node").join(by_node, "node").select(F.col("key").alias(key), "class_id", "copy_of", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """`docs` with one document of each group, the one with the least key, and all its columns.

    Rows that share a key stay or go together; rows equal in key and text stay once.
    """
    found = cut_lineage(classes(docs, key=key, text=text, **options))
    stays = found.where(F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("_stays")).distinct()
    kept = docs.join(stays, docs[key].eqNullSafe(stays["_stays"]), "left_semi")
    # Only rows of keys that occur more than once in a set are compared as wholes.
    repeated = found.groupBy(key, "copy_of").count().where("count > 1").select(F.col(key).alias("_again")).distinct()
    once = kept.join(repeated, kept[key].eqNullSafe(repeated["_again"]), "left_anti")
    again = kept.join(repeated, kept[key].eqNullSafe(repeated["_again"]), "left_semi").dropDuplicates([key, text])
    return once.unionByName(again)
