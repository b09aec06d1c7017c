"""Counts, base rule and adaptive fences against plain Python."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from freshet.llm import catalog  # noqa: F401
from freshet.llm import quality
from freshet.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    twice = {w for w, c in Counter(windows).items() if c > 1}
    covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered),
    )


def test_counts_of_random_texts():
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x\nx\n \n\nx\r\nx\r"]
    texts += ["".join(rng.choices("ab é😀\n\t#|", k=rng.randint(0, 120))) for _ in range(300)]
    texts += [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(100)]
    got = quality.measure(pa.array(texts))
    assert [tuple(int(got[c][k]) for c in quality.COUNTS) for k in range(len(texts))] == [brute(t) for t in texts]


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op10_adaptive_quality"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, chars, symbols, _, dup, repeat = brute(d.text)
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert r.kept == (not r.base_failed and not r.beyond)


def test_thresholds_follow_their_group(spark):
    # In one source every text has many symbols, in the other a single one has.
    rows = [(k, "en", "code", "ab| cd| ef| " * 20) for k in range(300)] + [(1000 + k, "en", "prose", "plain words here " * 20) for k in range(300)]
    rows += [(5000, "en", "prose", "ab| cd| ef| " * 20), (5001, "en", "tiny", "plain words here " * 20), (5002, None, None, None), (5003, None, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("n_words", F.lit("x"))
    fences = (quality.Fence("symbol_ratio", 4.0, 0.02),)
    got = {r.doc_id: r for r in quality.judge(docs, fences=fences).collect()}
    assert all(got[k].kept for k in [*range(300), *range(1000, 1300), 5001, 5002, 5003]) and not got[5000].kept
    assert list(got[5000].beyond) == ["symbol_ratio"]
    kept = quality.filter_documents(docs, fences=fences)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert quality.judge(docs.where("false"), fences=fences).count() == 0


def plain_fences(rows, prior=20.0):
    """{(lang, source): {signal: (low, high)}} from plain sorted lists; rows are (lang, source, {signal: value or None})."""
    def quantile(values, q):
        values = sorted(values)
        return values[max(0, math.ceil(q * len(values)) - 1)] if values else None

    def blend(n, own, wider):
        return wider if n == 0 else (own * n + wider * prior) / (n + prior)

    out = {}
    for group in {r[:2] for r in rows}:
        out[group] = {}
        for f in quality.FENCES:
            sets = [[r[2][f.signal] for r in rows if fits(r) and r[2][f.signal] is not None] for fits in (lambda r: r[:2] == group, lambda r: r[0] == group[0], lambda r: True)]
            q1, q3 = (blend(len(sets[0]), quantile(sets[0], q), blend(len(sets[1]), quantile(sets[1], q), quantile(sets[2], q))) for q in (0.25, 0.75))
            spread = max(q3 - q1, f.least) * f.reach
            out[group][f.signal] = (q1 - spread if f.low else -math.inf, q3 + spread if f.high else math.inf)
    return out


def test_verdicts_equal_plain_fences(spark, sf_dir):
    """The registered query against fences restated from the texts alone."""
    rows = {r.doc_id: r for r in QUERIES["op10_adaptive_quality"](spark, sf_dir).collect()}
    measured = []
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, chars, symbols, lines, dup, repeat = brute(d.text)
        pairs = {"symbol_ratio": (symbols, chars), "word_length": (chars, n), "dup_line_ratio": (dup, lines), "repeat_ratio": (repeat, n)}
        measured.append((d.lang, d.source, {k: a / b if b else None for k, (a, b) in pairs.items()}, d.doc_id))
    fences = plain_fences(measured)
    beyond = 0
    for lang, source, values, doc in measured:
        want = [f.signal for f in quality.FENCES if values[f.signal] is not None and not fences[lang, source][f.signal][0] <= values[f.signal] <= fences[lang, source][f.signal][1]]
        assert rows[doc].beyond == ",".join(want), doc
        assert rows[doc].kept == (not rows[doc].base_failed and not want)
        beyond += bool(want)
    assert beyond > 0
