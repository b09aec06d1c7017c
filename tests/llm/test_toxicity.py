"""Held-out accuracy of the noisy-or, its gradient, and the sentences it finds."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from freshet.llm import catalog  # noqa: F401
from freshet.llm import toxicity as tox
from freshet.llm.registry import QUERIES


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    vocab = [f"wort{k}" for k in range(400)]
    rows = []
    for k in range(n):
        sentences = [" ".join(rng.choices(vocab, k=8)).capitalize() + "." for _ in range(rng.randint(1, 9))]
        toxic = rng.random() < 0.25
        if toxic:
            # One sentence has a word of a bad stem; endings differ.
            at = rng.randrange(len(sentences))
            sentences[at] = sentences[at][:-1] + f" schlumpf{rng.randrange(500)}!"
        rows.append((k, " ".join(sentences), int(toxic)))
    return rows


def test_held_out_documents_and_sentences(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None)], "doc_id long, toxic int")
    model = tox.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    scores = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = sum((scores[k] >= tox.THRESHOLD) == bool(y) for k, _, y in held)
    assert len(held) > 150 and right >= 0.97 * len(held)
    found = tox.locate(docs, model).collect()
    texts = {r[0]: r[1] for r in rows}
    assert found and all(texts[r.doc_id][r.start:r.stop].startswith(r.sentence[:5]) for r in found)
    assert sum("schlumpf" in r.sentence for r in found) >= 0.95 * len(found)
    kept = {r.doc_id for r in tox.reject(docs, model, tox.THRESHOLD).collect()}
    assert kept == {k for k, s in scores.items() if s < tox.THRESHOLD}


def test_noisy_or_of_sentences():
    b = tox.bags(pa.array(["Good day. Bad night! Bad", None, "", "..."]))
    weights = np.zeros(tox.BUCKETS)
    bad = tox.word_features([b"bad"])[0]
    weights[bad] = 1.0
    model = tox.Model(weights, -2.0)
    p = 1 / (1 + np.exp(-np.array([-2.0, -2.0 + len(bad), -2.0 + len(bad)])))
    want = [1 - np.prod(1 - p), *[1 / (1 + np.exp(2.0))] * 3]
    assert np.allclose(model.scores(b), want)


def test_edges(spark):
    rows = [(1, "a b. c"), (1, "a b. c"), (2, None), (3, ""), (None, "x"), (4, "word " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("c0", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.train(docs, none)
    got = tox.score(docs, model).collect()
    assert len(got) == 6 and all(r.score < 1e-3 for r in got)
    kept = tox.reject(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == 6
    assert tox.score(docs.where("false"), model).count() == 0 and tox.locate(docs.where("false"), model).count() == 0
    ones = spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, toxic int")
    assert all(r.score > 0.99 for r in tox.score(docs, tox.train(docs, ones)).collect())


def test_query(spark, sf_dir):
    rows = QUERIES["op5_noisy_or_toxicity"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
