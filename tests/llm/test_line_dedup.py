"""Shared lines against a plain count over all lines."""

import pytest
from pyspark.sql import functions as F

from freshet.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def form(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, least_chars=10, least_docs=2):
    """(key, text, n_lines, n_dropped) of each row; a null key comes after all others."""
    holders = {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            if len(form(line)) >= least_chars:
                holders.setdefault(form(line), set()).add(key)
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(form(line), set())
            keeper = min(held, key=lambda k: (k is None, k or 0), default=None)
            if len(held) < least_docs or keeper == key:
                kept.append(line)
        out.append((key, "\n".join(kept) if len(kept) < len(lines) else text, len(lines), len(lines) - len(kept)))
    return out


A, B = "a line that is long enough", "another line of some length"
ROWS = [
    (5, f"{A}\nshort\n{A.upper()}  \n{B}"), (2, f"\t{A}\r\nown line of document two"), (9, "short\nshort"), (3, None), (4, ""), (7, "\n\n"),
    (8, f"{B}\n" * 3), (8, f"ahead\n{B}"), (8, f"ahead\n{B}"), (None, f"{A}\n\xa0{A}\nonly here, no key"), (None, f"only here, no key\n{A}"), (11, "ÄÖÜ ist zehn"), (12, "äÖÜ ist zehn\nÄÖÜ ist ZEHN"),
    (13, "123456789"), (14, "123456789"), (15, "1234567890"), (16, "1234567890\n" + "x y\n" * 50_000 + A), (17, f"{A}"),
]


@pytest.mark.parametrize("hot_parts", [1, 5, 10_000])
def test_equals_plain_count(spark, monkeypatch, hot_parts):
    monkeypatch.setattr(line_dedup, "HOT_PARTS", hot_parts)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("_key", F.lit("x")).withColumn("n_lines", F.lit(-1)).withColumn("line key", F.lit(1))
    for least_chars, least_docs in ((10, 2), (1, 3), (10, 4)):
        got = line_dedup.drop_shared_lines(docs, least_chars=least_chars, least_docs=least_docs)
        assert got.columns == ["doc_id", "text", "_key", "line key", "n_lines", "n_dropped"]
        found = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)
        assert found == sorted(plain(ROWS, least_chars, least_docs), key=str)


def test_hot_line_and_empty_table(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("The same first line\n"), F.col("id").cast("string"), F.lit(" is its own line")).alias("text"))
    got = line_dedup.drop_shared_lines(docs).collect()
    assert sorted(r.doc_id for r in got if r.n_dropped) == list(range(1, 3000)) and {r.n_dropped for r in got} == {0, 1}
    assert line_dedup.drop_shared_lines(docs.where("false")).count() == 0
