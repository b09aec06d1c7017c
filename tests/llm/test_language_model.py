"""The automaton against counts in plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from freshet.llm import catalog  # noqa: F401
from freshet.llm import language_model as lm
from freshet.llm.registry import QUERIES


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n>"]


def brute(rows):
    """(key, text, held) to key -> (held, n, known, N, base, score)."""
    one, two, followers, starts = Counter(), Counter(), defaultdict(set), 0
    for _, text, held in rows:
        if not held:
            h = "\n<"
            starts += 1
            for w in tokens(text):
                one[w] += 1
                two[h, w] += 1
                followers[h].add(w)
                h = w
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for key, text, held in rows:
        t, h, base, score = tokens(text), "\n<", 0.0, 0.0
        for w in t:
            c, f = starts if h == "\n<" else one[h], len(followers[h])
            base += math.log10(p(w))
            score += math.log10((two[h, w] + f * p(w)) / (c + f) if f else p(w))
            h = w
        out.append((key, held, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


def compare(got, want):
    got = sorted(((r[0], r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_query_equals_counts(spark, sf_dir):
    got = QUERIES["op4_backoff_automaton"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(d.doc_id, d.text, zlib.crc32(str(d.doc_id).encode()) % 10 == 0) for d in docs])
    compare(got, want)
    assert sum(w[6] for w in want) > sum(w[5] for w in want)


def test_many_chunks_and_hot_words(spark, monkeypatch):
    rows = [(k, f"the a{k} the b{k % 7} The c Été w{k % 3}\n" * (1 + k % 4), k % 5 == 0) for k in range(120)]
    rows += [(1000, None, False), (1001, "", True), (None, "the end", False), (7, "x", False), (7, "x", False), (2000, "the z " * 30_000, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").withColumn("key", F.lit(1)).withColumn("chunk", F.lit("c"))
    monkeypatch.setattr(lm, "hot_words", lambda d, t, s: lm.np.unique(lm.np.array([lm.xxhash.xxh3_64_intdigest(w) for w in (b"the", b"c", b"none")], lm.np.uint64)))
    compare(lm.score_texts(docs, F.col("held"), chunk_bytes=2000).collect(), brute(rows))
    monkeypatch.undo()
    compare(lm.score_texts(docs, F.col("held"), chunk_bytes=1 << 20).collect(), brute(rows))


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held boolean")
    compare(lm.score_texts(docs, F.col("held")).collect(), brute([(1, "a b", True), (2, None, True)]))
    assert lm.score_texts(docs.where("false"), F.col("held")).count() == 0
