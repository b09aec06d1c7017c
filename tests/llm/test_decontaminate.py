"""The positional index against a plain search over every window."""

import hashlib
import re

from freshet.llm import decontaminate as dc
from freshet.llm.registry import QUERIES
from freshet.llm import catalog  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + width]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w = WORD.findall(lower(text))
        hit, names = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k:k + size])):
                    names |= found
                    hit.update(range(k, k + size))
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_query_equals_plain_search(spark, sf_dir):
    got = QUERIES["op9_positional_index"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    want = brute(docs, items)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(r[5] for r in want)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
DOCS = [
    (1, f"Ahead. {PASSAGE.upper()} after", "x", 7), (2, None, "x", 7), (3, "", None, 7), (4, "one two three", "x", None),
    (5, "one two " * 30, "x", 7), (6, PASSAGE, "x", 7), (6, PASSAGE, "x", 7), (7, "éa ÉA éa", "x", 7), (None, "one TWO", "x", 7),
    (8, PASSAGE[:40], "x", 7), (9, PASSAGE[40:], "x", 7), (10, "w " * 90_000 + PASSAGE, "x", 7),
]
ITEMS = [(1, PASSAGE), (2, "one two"), (3, None), (4, "é"), (5, ""), (6, "éa"), (7, PASSAGE), (None, "three")]


def test_edge_cases_and_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, items string, n_words int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute([d[:2] for d in DOCS], [("" if k is None else k, t) for k, t in ITEMS])
    for size in (1 << 20, 1):
        got = dc.judge(docs, items, block_bytes=size).collect()
        rows = [
            (r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), r.contaminated)
            for r in got
        ]
        assert sorted(rows, key=str) == want
        spans = {r.doc_id: [tuple(h) for h in r.hits] for r in got}
        assert spans[1] == [(1, 15)] and spans[5] == [(0, 60)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.judge(docs, items).count() == 0
    some = spark.createDataFrame(DOCS[:4], "doc_id long, text string, a string, b int")
    assert dc.judge(some, items).where("contaminated or n_hit > 0").count() == 0
    assert dc.remove_contaminated(some, items).count() == 4
    full = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r.doc_id for r in dc.remove_contaminated(some, full).collect()} == {2, 3}
    assert dc.remove_contaminated(some, full).columns == ["doc_id", "text", "a", "b"]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "far cat a b c dog"), (2, "cat dog"), (3, "cat"), (4, "dog")], "doc_id long, text string")
    index = dc.build_index(docs)
    got = {(r.doc_id, r.phrase, r.position) for r in dc.proximity_matches(index, {"pets": ["Cat", "dog"], "none": []}, 3).collect()}
    assert got == {(2, "pets", 0)} or got == {(2, "pets", 1)}


def test_lookups_in_small_steps(spark, monkeypatch):
    """Windows are looked up a few positions at a time with the same result."""
    monkeypatch.setattr(dc, "CANDIDATES", 3)
    docs = spark.createDataFrame([d[:2] for d in DOCS[:-1]], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute([d[:2] for d in DOCS[:-1]], [("" if k is None else k, t) for k, t in ITEMS])
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), r.contaminated) for r in dc.judge(docs, items, width=2).collect()]
    short = brute([d[:2] for d in DOCS[:-1]], [("" if k is None else k, t) for k, t in ITEMS], 2)
    assert sorted(got, key=str) == sorted(((k, n, h, i, c) for k, n, h, i, _, c in short), key=str) and want != short
