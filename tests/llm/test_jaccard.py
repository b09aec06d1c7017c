"""The pruned join against all pairs, and its parts."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from freshet.llm import catalog  # noqa: F401
from freshet.llm import jaccard_join as jj
from freshet.llm.components import components
from freshet.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4) if w else 0))


def brute(rows, threshold=0.8):
    """(key, class, links) by comparing all pairs of distinct sets."""
    sets = {}
    for key, text in rows:
        sets.setdefault(shingles(text), []).append(key)
    listed = list(sets)
    parent = list(range(len(listed)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for k, s in enumerate(listed):
        for x in s:
            by_shingle.setdefault(x, set()).add(k)
    links = [0] * len(listed)
    for k, s in enumerate(listed):
        for other in {o for x in s for o in by_shingle[x] if o > k}:
            t = listed[other]
            if len(s & t) >= threshold * len(s | t) - 1e-9:
                links[k] += 1
                links[other] += 1
                parent[find(other)] = find(k)
    order = lambda v: (v is None, v or 0)
    least = {}
    for k, s in enumerate(listed):
        least[find(k)] = min([*sets[s], *([least[find(k)]] if find(k) in least else [])], key=order)
    return sorted(((key, least[find(k)], links[k]) for k, s in enumerate(listed) for key in sets[s]), key=str)


def test_query_equals_all_pairs(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = QUERIES["op3_bayesian_jaccard"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute(docs)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == want
    assert sum(w[2] for w in want) > 10


def varied(seed, n, length=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_group_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 20)
    monkeypatch.setattr(jj, "PAIRS", 100)
    texts = [t for s in range(2) for t in varied(s, 90)] + ["unrelated text " * 20]
    rows = list(enumerate(texts))
    got = jj.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)


def test_edges(spark):
    a = varied(7, 1)[0]
    rows = [(5, a), (3, a.upper()), (3, a.upper()), (9, a + " tail"), (None, a), (None, None), (8, ""), (7, " \n"), (6, "one two"), (4, "one  two"), (2, "one two three"), (1, "z " * 50_000), (0, "z " * 49_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("key", F.lit("k"))
    got = jj.classes(docs).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 7]
    assert jj.classes(docs.where("false")).count() == 0 and jj.keep_one(docs.where("false")).count() == 0


def test_posterior_and_minhash():
    assert jj.least_matches(16, 0.8, 1e-5) < 12.8 and jj.least_matches(96, 0.8, 1e-5) > 40
    texts = varied(3, 2)
    sig = jj.minhashes(*jj.text_shingles(pa.array(texts)))
    s, t = map(shingles, texts)
    assert abs((sig[0] == sig[1]).mean() - len(s & t) / len(s | t)) < 0.2
    assert (jj.leaders(6, np.array([5, 4, 1]), np.array([4, 1, 2])) == [0, 1, 1, 3, 1, 1]).all()


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, x) for x in range(201, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
