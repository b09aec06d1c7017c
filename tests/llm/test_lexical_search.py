"""Search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counted = [(key, Counter(terms(t))) for key, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for (key, c), n in zip(counted, sizes, strict=True):
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                found.append((-score, key is None, key or 0))
        out += [(item, r, None if null else key, -s) for r, (s, null, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def make(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Éa", "x9"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(n)]


DOCS = [(k, t) for k, t in enumerate(make(300, 1))] + [(500, None), (501, ""), (502, "-,;"), (7, "w1 W2 w3"), (7, "w1 W2 w3"), (None, "w1 w2 w3"), (503, "w1 " * 60_000 + "w2 éa")]
ITEMS = [(k, t) for k, t in enumerate(make(40, 2))] + [(60, None), (61, ""), (62, "unknown words"), (3, "w1 w2"), (None, "w2,W3")]


@pytest.mark.parametrize("block_terms, first_pass, shard_docs", [(4096, 16, 8192), (60, 2, 16), (1, 1, 64)])
def test_equals_all_pairs(spark, monkeypatch, block_terms, first_pass, shard_docs):
    monkeypatch.setattr(ls, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(ls, "DOC_LEAF", 4)
    items_of = ITEMS if block_terms > 1 else ITEMS[:6] + ITEMS[-3:]
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("keys", F.lit(1)).repartition(3)
    items = spark.createDataFrame(items_of, "item_id int, text string").withColumn("rank", F.lit("x"))
    got = ls.search(docs, items, block_terms=block_terms, first_pass=first_pass)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(DOCS, items_of)


def test_ties_text_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(f"d{k}", "same text here") for k in range(30)] + [(None, "same text here")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "text"), ("j", "here text")], "item_id string, text string")
    # Terms that all documents hold still weigh something here, so ties are cut by the key.
    assert {r.doc_id for r in ls.search(docs, items).collect()} == {"d0", "d1", "d10", "d11", "d12", "d13", "d14", "d15", "d16", "d17"}
    more = docs.unionByName(spark.range(40).select(F.col("id").cast("string").alias("doc_id"), F.lit("other words").alias("text")))
    rows = ls.search(more, items, k=3).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in rows] == [(i, k + 1, d) for i in "ij" for k, d in enumerate(["d0", "d1", "d10"])]
    assert ls.search(more.where("false"), items).count() == 0 and ls.search(more, items.where("false")).count() == 0


def test_trees_prune_exactly():
    """Node bounds leave out most pairs of leaves once the k-th scores are known."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    table = ls.word_table()
    texts = [" ".join(f"t{g}x{rng.integers(30)}" for _ in range(40)) + " common" for g in range(64) for _ in range(32)]
    found = ls.words(pa.array(texts), table)
    names = np.array([ls.item_terms(w.decode())[0] for w in found.names])
    hashes = np.unique(names)
    rank = np.searchsorted(hashes, names)[found.codes]
    posted, tf = np.unique(rank * len(texts) + found.doc, return_counts=True)
    row = {
        "keys": list(range(len(texts))), "shard": 1, "n": np.diff(found.bounds).tolist(), "terms": hashes.tolist(),
        "ends": np.cumsum(np.bincount(posted // len(texts))).tolist(), "docs": (posted % len(texts)).tolist(), "tf": tf.tolist(),
    }
    batch = pa.RecordBatch.from_pylist([row])
    held = [np.array(ls.item_terms(texts[g * 32]), np.int64) for g in range(64)]
    wanted = np.unique(np.concatenate(held))
    block = ls.Block(list(range(64)), wanted, [np.searchsorted(wanted, x) for x in held])
    shard = ls.Shard(batch, 0, wanted)
    df = np.zeros(len(wanted), np.int64)
    df[shard.here] = shard.df
    tree = ls.ItemTree(block, ls.term_weights(df, len(texts)))
    best = ls.Best(64, 10, np.zeros(64))
    ls.search_shard(shard, tree, best, len(texts), int(found.bounds[-1]))
    again, visits = ls.Best(64, 10, best.least), ls.Visits()
    ls.search_shard(shard, tree, again, len(texts), int(found.bounds[-1]), visits)
    assert again.lists == best.lists
    assert visits.scored < 0.35 * visits.all
