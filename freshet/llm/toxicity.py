"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a linear model of hashed
words and of the byte runs inside them, and the document is toxic if at least one sentence is: p = 1 - prod(1 - p_sentence), a
noisy-or. Training sees document labels only; the gradient finds the sentences behind them, and
`locate` returns these.

The model is fitted on at most `most` labelled documents, chosen by a hash, in one task. It has
a fixed size, so scoring tasks get it as a broadcast of 4 MB; scoring covers every whole text.

Defined cases: a null text counts as empty; a text without words is one sentence without words;
rows with a null label are not used, and of several labels of a document the largest holds;
repeated rows are scored one by one; without labelled rows of both kinds every score is the share
of toxic ones (0 if there are none). Further columns are ignored by `score` and kept by `reject`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.arrow_text import mix, slices, text_bytes, word_table, words

#: Hash buckets of words and of the byte runs inside words.
BUCKETS = 1 << 20
#: Lengths of the byte runs; a word's start counts as a byte, so prefixes are told apart.
RUNS = (4, 5, 6, 7)
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Labelled documents used for the fit, at most.
SAMPLE = 8_000
SENTENCE_ENDS = np.frombuffer(b".!?\n", np.uint8)


@dataclass
class Bags:
    """Word codes of a slice, the sentence of each word, the document of each sentence."""

    codes: np.ndarray
    names: list[bytes]
    sentence: np.ndarray
    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    n_docs: int


def bags(texts: pa.Array) -> Bags:
    raw, bounds = text_bytes(texts)
    found = words(texts, word_table())
    breaks = np.cumsum(np.isin(raw, SENTENCE_ENDS))
    doc = found.doc
    part = breaks[found.starts] if len(found.starts) else np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    # A document without words gets one sentence without words.
    empty = np.flatnonzero(np.diff(found.bounds) == 0)
    docs = np.concatenate([doc[first], empty])
    last = np.concatenate([first[1:], [len(doc)]])[:len(first)] - 1
    at = np.concatenate([found.starts[first], bounds[empty]])
    to = np.concatenate([found.ends[last], bounds[empty]])
    return Bags(found.codes, found.names, np.cumsum(new) - 1, docs, at, to, len(bounds) - 1)


def feature_runs(names: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, words that have them): first whole words, then the byte runs of each length."""
    whole = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    yield (whole & np.uint64(BUCKETS - 1)).astype(np.int32), np.arange(len(names), dtype=np.int32)
    raw = np.frombuffer(b"\0" + b"\0".join(names), np.uint8)
    lengths = np.fromiter(map(len, names), np.int32, len(names)) + 1
    owner = np.repeat(np.arange(len(names), dtype=np.int32), lengths)
    left = np.cumsum(lengths, dtype=np.int32)[owner] - np.arange(len(owner), dtype=np.int32)  # bytes to the end of the word
    rolled = np.zeros(len(raw), np.uint64)
    for k in range(max(RUNS)):
        rolled = rolled[:len(raw) - k]
        with np.errstate(over="ignore"):
            rolled = rolled * np.uint64(0x100000001B3) + raw[k:] + np.uint64(1)
        if k + 1 in RUNS:
            inside = np.flatnonzero(left[:len(rolled)] > k)
            yield (mix(rolled[inside]) & np.uint64(BUCKETS - 1)).astype(np.int32), owner[inside]


def word_features(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of each word, and the word that each bucket belongs to."""
    buckets, owners = zip(*feature_runs(names), strict=True)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, b: Bags) -> np.ndarray:
        if not len(b.names):
            return np.full(len(b.doc), self.bias)
        worth = np.zeros(len(b.names))
        for buckets, owners in feature_runs(b.names):
            worth += np.bincount(owners, self.weights[buckets], len(b.names))
        return self.bias + np.bincount(b.sentence, worth[b.codes], len(b.doc))

    def scores(self, b: Bags) -> np.ndarray:
        """Noisy-or over the sentences of each document."""
        quiet = -np.logaddexp(0, self.sentence_logits(b))  # log(1 - p)
        return np.clip(-np.expm1(np.bincount(b.doc, quiet, b.n_docs)), 0.0, 1.0)


def fit(
    b: Bags, labels: np.ndarray, steps: int = 100, rate: float = 0.05, ridge: float = 1e-5,
    least_docs: int = 4, significant: float = 5.0,
) -> Model:
    """Maximum likelihood of the document labels under the noisy-or, by Adam on all bags."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1 or not len(b.names):
        share = min(max(share, 1e-12), 1 - 1e-12)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    # Only features that toxic documents have markedly more often than others can carry a weight.
    owner = b.doc[b.sentence].astype(np.int64)
    pairs = np.unique(owner * len(b.names) + b.codes)
    word, truth = pairs % len(b.names), labels[pairs // len(b.names)].astype(float)
    docs_of, toxic_of = np.bincount(word, minlength=len(b.names)), np.bincount(word, truth, len(b.names))
    base = truth.mean()
    del pairs, word, truth, owner
    n_docs, n_toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for buckets, owners in feature_runs(b.names):
        n_docs += np.bincount(buckets, docs_of[owners], BUCKETS)
        n_toxic += np.bincount(buckets, toxic_of[owners], BUCKETS)
    excess = (n_toxic - n_docs * base) / np.sqrt(np.maximum(n_docs, 1) * base * (1 - base) + 1e-12)
    usable = (excess >= significant) & (n_docs >= least_docs)
    kept = [(f[usable[f]], w[usable[f]]) for f, w in feature_runs(b.names)]
    buckets, owners = (np.concatenate(x) for x in zip(*kept, strict=True))
    sentences = np.bincount(b.doc, minlength=b.n_docs)
    bias = float(np.log(share / max(1.0, float(sentences.mean()))))
    w, y = np.zeros(BUCKETS), labels.astype(bool)
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, steps + 1):
        worth = np.bincount(owners, w[buckets], len(b.names))
        quiet = -np.logaddexp(0, bias + np.bincount(b.sentence, worth[b.codes], len(b.doc)))
        p = -np.expm1(quiet)
        none = np.exp(np.bincount(b.doc, quiet, b.n_docs))
        factor = np.where(y, none / np.maximum(1 - none, 1e-9), -1.0)
        pull = p * factor[b.doc] / b.n_docs
        by_word = np.bincount(b.codes, pull[b.sentence], len(b.names))
        grad = np.append(np.bincount(buckets, by_word[owners], BUCKETS) - ridge * w, pull.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        w += move[:-1]
        bias += float(move[-1])
    return Model(w.astype(np.float32), bias)


def train(
    docs: DataFrame, labels: DataFrame, use: Column | None = None, key: str = "doc_id", text: str = "text",
    label: str = "toxic", most: int = SAMPLE,
) -> Model:
    """Fit on at most `most` rows of `docs` that have a label and meet `use` (a condition on `key`)."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    total = known.count()
    if use is not None:
        known = known.withColumnRenamed("_key", key).where(use).withColumnRenamed(key, "_key")
    share = min(1_000_000, int(1_000_000 * most / max(total, 1)) + 1)
    chosen = known.where(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < share)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, "_key").select("_text", "_label").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        sample = pa.Table.from_batches(held).combine_chunks() if held else pa.table({"t": pa.array([], pa.string()), "y": pa.array([], pa.int32())})
        texts = sample.column(0).cast(pa.large_string()).combine_chunks()
        model = fit(bags(texts), sample.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["weights", "bias"])

    fitted = rows.coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    if fitted is None:
        return fit(bags(pa.array([], pa.string())), np.zeros(0))
    return Model(np.frombuffer(bytes(fitted["weights"]), np.float32), fitted["bias"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for each row of `docs`."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                scores = held.scores(bags(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["key", "score"])

    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return slim.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def locate(docs: DataFrame, model: Model, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Offending sentences: (key, start, stop, score, sentence), offsets in code points."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                b = bags(part.column(1))
                raw, bounds = text_bytes(part.column(1))
                p = 1 / (1 + np.exp(-held.sentence_logits(b)))
                at = np.flatnonzero(p >= threshold)
                points = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
                home = points[bounds[b.doc[at]]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(b.doc[at])), pa.array(points[b.starts[at]] - home, pa.int32()),
                        pa.array(points[b.ends[at]] - home, pa.int32()), pa.array(p[at], pa.float64()),
                        pa.array([raw[i:j].tobytes().decode() for i, j in zip(b.starts[at], b.ends[at], strict=True)], pa.string()),
                    ],
                    ["key", "start", "stop", "score", "sentence"],
                )

    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return slim.mapInArrow(run, f"key {kind}, start int, stop int, score double, sentence string").withColumnRenamed("key", key)


def reject(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of `docs` that score below `threshold`, with all their columns."""
    names = docs.columns
    at = names.index(text)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                yield part.filter(pa.array(held.scores(bags(part.column(at))) < threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
