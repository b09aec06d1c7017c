"""Scores of whole texts under a smoothed bigram model run as a weighted backoff automaton.

The states of the automaton are the words of the model and a start; a state has an arc for each
word that followed it in training, weighted by its log probability, and a failure arc to the empty
state, which has an arc for every word. A text is read once from left to right, carrying the state
and adding up weights. Smoothing is Witten-Bell: with c counts and T the number of different
followers, P(w|h) = (c(hw) + T(h) P(w)) / (c(h) + T(h)), and P(w) = (c(w) + a) / (N + a (V + 1)).

The model grows with the corpus, so no task and no driver holds it. Documents are dealt into chunks
of a few MB. A chunk asks for the counts of the words and bigrams that it has and tells its own
training counts; requests are dealt by word into buckets, which add up all chunks and send the totals
back in the order of the request. From these a chunk builds the part of the automaton that its
texts can reach, and walks it. Followers of words with a large share of all tokens are dealt by
bigram, so a hot word has no bucket of its own; their T is summed over the buckets.

Words are runs without ASCII white space, A-Z lower-cased, and each text has an end token. Defined
cases: a null or empty text is its end token alone; a null key counts as training; repeated rows
count and are scored one by one; without training rows every probability is that of an unseen
word; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.arrow_text import lower_table, mix, words

#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 6 << 20
#: Added to each count of a single word.
ADDED = 0.1
#: Hashes of the start and the end; no word contains white space.
START, END = np.uint64(xxhash.xxh3_64_intdigest(b"\n<")), np.uint64(xxhash.xxh3_64_intdigest(b"\n>"))
#: Bytes kept of a follower's hash; followers are only told apart within one history.
FOLLOWER_BYTES = 6

_ODD = np.uint64(0x9E3779B97F4A7C15)


def planes(values: np.ndarray) -> bytes:
    """64-bit integers as eight planes of bytes: equal high bytes lie together and compress well."""
    return np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def rising(values: np.ndarray) -> bytes:
    """Ascending integers as planes of their differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def from_rising(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def follower_bytes(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :FOLLOWER_BYTES].tobytes()


def from_follower_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // FOLLOWER_BYTES, 8), np.uint8)
    out[:, :FOLLOWER_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, FOLLOWER_BYTES)
    return out.view(np.uint64).ravel()


class Chunk:
    """Words and bigrams of a chunk in an order that does not depend on the order of its rows.

    `vocabulary` are the sorted hashes of its words, the start and the end; `bigrams` are sorted by
    history and follower, as history * len(vocabulary) + follower.
    """

    def __init__(self, texts: pa.Array, held: np.ndarray) -> None:
        found = words(texts, lower_table())
        names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.names), np.uint64, len(found.names))
        self.vocabulary = np.unique(np.concatenate([names, np.array([START, END], np.uint64)]))
        codes = np.searchsorted(self.vocabulary, names)[found.codes]
        self.start, self.end = np.searchsorted(self.vocabulary, [START, END]).tolist()
        # Every text reads its words and the end; before the first word stands the start.
        self.targets = np.insert(codes, found.bounds[1:], self.end)
        self.bounds = found.bounds + np.arange(len(found.bounds))
        histories = np.insert(codes, found.bounds[:-1], self.start)
        train = ~np.repeat(held, np.diff(self.bounds))
        size = len(self.vocabulary)
        keys = histories.astype(np.int64) * size + self.targets
        self.bigrams = np.unique(keys)
        self.counts = np.bincount(self.targets[train], minlength=size)
        self.counts[self.start] = int((~held).sum())
        own, n = np.unique(keys[train], return_counts=True)
        self.bigram_counts = np.zeros(len(self.bigrams), np.int64)
        self.bigram_counts[np.searchsorted(self.bigrams, own)] = n

    def dealt(self, buckets: int, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, its words, its bigrams of other words, its bigrams of hot words), as positions."""
        size = len(self.vocabulary)
        home = (mix(self.vocabulary) % np.uint64(buckets)).astype(np.int64)
        history, follower = self.bigrams // size, self.bigrams % size
        is_hot = np.isin(self.vocabulary, hot)[history]
        spread = (mix(self.vocabulary[history] * _ODD + self.vocabulary[follower]) % np.uint64(buckets)).astype(np.int64)
        to = np.where(is_hot, spread, home[history])

        def split(at: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
            order = np.argsort(where, kind="stable")
            return np.split(at[order], np.searchsorted(where[order], np.arange(1, buckets)))

        every = np.arange(len(self.bigrams))
        parts = zip(split(np.arange(size), home), split(every[~is_hot], to[~is_hot]), split(every[is_hot], to[is_hot]), strict=True)
        for k, (w, b, h) in enumerate(parts):
            if len(w) or len(h):
                yield k, w, b, h


REQUEST = "bucket int, chunk int, words binary, counts binary, followers binary, ids binary, id_counts binary, hot binary, hot_ids binary, hot_counts binary"


def requests(table: pa.Table, buckets: int, hot: np.ndarray) -> pa.Table:
    """What a chunk asks and tells, one row per bucket that it needs."""
    chunk = Chunk(table.column("text").combine_chunks(), table.column("held").to_numpy())
    size = len(chunk.vocabulary)
    history, follower = chunk.bigrams // size, chunk.vocabulary[chunk.bigrams % size]
    number = table.column("chunk")[0].as_py()
    rows = []
    for k, w, b, h in chunk.dealt(buckets, hot):
        of_word = np.bincount(np.searchsorted(w, history[b]), minlength=len(w))
        rows.append((
            k, number, rising(chunk.vocabulary[w]), planes(chunk.counts[w]), planes(of_word), follower_bytes(follower[b]), planes(chunk.bigram_counts[b]),
            planes(np.searchsorted(hot, chunk.vocabulary[history[h]])), follower_bytes(follower[h]), planes(chunk.bigram_counts[h]),
        ))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 8]
    names = [f.strip().split(" ")[0] for f in REQUEST.split(",")]
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})


ANSWER = "chunk int, bucket int, counts binary, followers binary, id_counts binary, hot_counts binary"
#: Bucket number of the row with the sums over all buckets.
ALL = -1


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, for each key its place among them, and the sums of counts."""
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, counts.astype(np.int64))
    return distinct, place, total


class Bucket:
    """Requests of all chunks to one bucket, added up."""

    def __init__(self, table: pa.Table) -> None:
        self.asked = table.select(["chunk", "bucket"]).to_pylist()

        def each(name: str, decode: Callable[[bytes], np.ndarray]) -> list[np.ndarray]:
            return [decode(x) for x in table.column(name).to_pylist()]

        words, followers = each("words", from_rising), each("followers", from_planes)
        ids, hot = each("ids", from_follower_bytes), each("hot", from_planes)
        self.sizes = [(len(w), len(b), len(h)) for w, b, h in zip(words, ids, hot, strict=True)]
        histories = np.concatenate([np.repeat(w, f.astype(np.int64)) for w, f in zip(words, followers, strict=True)])
        self.vocabulary, self.place, self.counts = _summed(np.concatenate(words), np.concatenate(each("counts", from_planes)))
        pairs, self.at, self.pair_counts = _summed(mix(histories * _ODD + np.concatenate(ids)), np.concatenate(each("id_counts", from_planes)))
        # Of each distinct bigram one history; those seen in training count as followers.
        owner = np.zeros(len(pairs), np.uint64)
        owner[self.at] = histories
        self.followers = np.bincount(np.searchsorted(self.vocabulary, owner[self.pair_counts > 0]), minlength=len(self.vocabulary))
        hot = np.concatenate(hot)
        hot_pairs, self.hot_at, self.hot_counts = _summed(
            mix((hot + np.uint64(1)) * _ODD + np.concatenate(each("hot_ids", from_follower_bytes))), np.concatenate(each("hot_counts", from_planes))
        )
        self.hot_owner = np.zeros(len(hot_pairs), np.int64)
        self.hot_owner[self.hot_at] = hot.astype(np.int64)


def bucket_sums(table: pa.Table, n_hot: int) -> pa.Table:
    """Training tokens, distinct words, and followers of each hot word in one bucket."""
    found = Bucket(table)
    token = found.vocabulary != START
    hot = np.bincount(found.hot_owner[found.hot_counts > 0], minlength=n_hot)
    return pa.table({"sums": pa.array([[int(found.counts[token].sum()), int(((found.counts > 0) & token).sum()), *hot.tolist()]], pa.list_(pa.int64()))})


def answers(table: pa.Table) -> pa.Table:
    """Totals of a bucket for each chunk that asked, in the order of its request."""
    found = Bucket(table)
    rows, w, b, h = [], 0, 0, 0
    for row, (nw, nb, nh) in zip(found.asked, found.sizes, strict=True):
        mine = found.place[w:w + nw]
        rows.append((
            row["chunk"], row["bucket"], planes(found.counts[mine]), planes(found.followers[mine]),
            planes(found.pair_counts[found.at[b:b + nb]]), planes(found.hot_counts[found.hot_at[h:h + nh]]),
        ))
        w, b, h = w + nw, b + nb, h + nh
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    names = [f.strip().split(" ")[0] for f in ANSWER.split(",")]
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})


@dataclass
class Automaton:
    """Arcs of the states that a chunk can reach. State and word numbers are places in its vocabulary."""

    size: int
    arcs: np.ndarray
    weights: np.ndarray
    failure: np.ndarray
    words: np.ndarray

    def step(self, states: np.ndarray, read: np.ndarray) -> np.ndarray:
        """Weight of reading one word in each state: its arc, or the failure arc and that of the empty state."""
        keys = states * self.size + read
        at = np.searchsorted(self.arcs, keys)
        at[at == len(self.arcs)] = 0
        hit = self.arcs[at] == keys if len(self.arcs) else np.zeros(len(keys), bool)
        out = self.failure[states] + self.words[read]
        out[hit] = self.weights[at[hit]]
        return out

    def walk(self, tokens: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
        """Score of each text: all texts advance a word at a time, the longest ones last."""
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        firsts, ends = bounds[:-1][order], lengths[order]
        score = np.zeros(len(order))
        states = np.full(len(order), start, np.int64)
        active = len(order)
        for t in range(int(lengths.max(initial=0))):
            while active and ends[active - 1] <= t:
                active -= 1
            read = tokens[firsts[:active] + t]
            score[:active] += self.step(states[:active], read)
            states[:active] = read
        out = np.zeros(len(order))
        out[order] = score
        return out


def scored(docs: pa.Table, told: pa.Table, buckets: int, hot: np.ndarray) -> pa.Table:
    """Scores of the texts of a chunk from the totals that the buckets sent."""
    names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if not docs.num_rows:
        kinds = [docs.column("key").type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
        return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
    held = docs.column("held").to_numpy()
    chunk = Chunk(docs.column("text").combine_chunks(), held)
    size = len(chunk.vocabulary)
    counts, followers = np.zeros(size), np.zeros(size)
    pairs = np.zeros(len(chunk.bigrams))
    by_bucket = {row["bucket"]: row for row in told.to_pylist()}
    n, v, *hot_followers = from_planes(by_bucket[ALL]["counts"]).astype(np.int64).tolist()
    hot_followers = np.array(hot_followers, float)
    for k, w, b, h in chunk.dealt(buckets, hot):
        row = by_bucket[k]
        counts[w], followers[w] = from_planes(row["counts"]), from_planes(row["followers"])
        pairs[b], pairs[h] = from_planes(row["id_counts"]), from_planes(row["hot_counts"])
    at = np.flatnonzero(np.isin(chunk.vocabulary, hot))
    followers[at] = hot_followers[np.searchsorted(hot, chunk.vocabulary[at])]
    token_counts = counts.copy()
    token_counts[chunk.start] = 0
    single = (token_counts + ADDED) / (n + ADDED * (v + 1))
    history, follower = chunk.bigrams // size, chunk.bigrams % size
    seen = pairs > 0
    history, follower, pairs = history[seen], follower[seen], pairs[seen]
    whole = counts + followers
    with np.errstate(divide="ignore", invalid="ignore"):
        back = np.where(followers > 0, np.log10(followers / whole), 0.0)
    weights = np.log10((pairs + followers[history] * single[follower]) / whole[history])
    automaton = Automaton(size, chunk.bigrams[seen], weights, back, np.log10(single))
    base = np.concatenate([[0.0], np.cumsum(automaton.words[chunk.targets])])
    known = np.concatenate([[0], np.cumsum(token_counts[chunk.targets] > 0)])
    low, high = chunk.bounds[:-1], chunk.bounds[1:]
    columns = [
        docs.column("key"), docs.column("held"), pa.array(high - low, pa.int64()), pa.array(known[high] - known[low], pa.int64()),
        pa.array(np.full(len(low), n), pa.int64()), pa.array(base[high] - base[low]),
        pa.array(automaton.walk(chunk.targets, chunk.bounds, chunk.start)),
    ]
    return pa.table(dict(zip(names, columns, strict=True)))


def _planes_column(name: str) -> Column:
    """`planes` of an array of integers: byte 0 of each, then byte 1, and so on."""
    def plane(k: int) -> Column:
        return F.transform(F.col(name), lambda x: F.lpad(F.hex(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0"))

    return F.unhex(F.concat(*(F.array_join(plane(k), "") for k in range(8))))


def hot_words(docs: DataFrame, text: str, share: float) -> np.ndarray:
    """Sorted hashes of words with more than `share` of the tokens, by a sample of documents.

    The list only decides where counts are added up, not what they are; it has at most 1 / share words.
    """
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(256)) == 0).select(F.explode(F.split(lowered, r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    counts = sample.groupBy("w").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    found = [r["w"] for r in counts.where(F.col("count") > share * total).collect()] if total else []
    return np.unique(np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in found], np.uint64))


def score_texts(
    docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows for which `held` is true are scored but not learnt from.
    """
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    size = slim.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    chunks = -(-size // chunk_bytes) or 1
    buckets = chunks
    hot = hot_words(slim, "text", 1 / (4 * buckets))
    dealt = slim.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(chunks)).cast("int"))
    kind = slim.schema["key"].dataType.simpleString()

    # One plan without a stop: the exchanges of texts and of requests are each read twice.
    asked = dealt.groupBy("chunk").applyInArrow(lambda t: requests(t, buckets, hot), REQUEST).groupBy("bucket")
    told = asked.applyInArrow(answers, ANSWER)
    sums = asked.applyInArrow(lambda t: bucket_sums(t, len(hot)), "sums array<long>")
    added = sums.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"))
    whole = added.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("sums"))
    everywhere = whole.select("sums", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    empty = F.lit(None).cast("binary")
    for_all = everywhere.select(
        "chunk", F.lit(ALL).alias("bucket"), _planes_column("sums").alias("counts"), *(empty.alias(c) for c in ("followers", "id_counts", "hot_counts"))
    )
    per_chunk = told.unionByName(for_all)
    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = dealt.groupBy("chunk").cogroup(per_chunk.groupBy("chunk")).applyInArrow(
        lambda d, t: scored(d, t, buckets, hot), schema
    )
    return found.withColumnRenamed("key", key)
