"""Anchor expansion against the regular expressions that define the base kinds."""

import hashlib
import random
import re

import pytest

from freshet.llm import pii
from freshet.llm.registry import QUERIES
from freshet.llm import catalog  # noqa: F401

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text = text or ""
    out = {"email": [m.span() for m in EMAIL.finditer(text)]}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, *s) for k in out for s in out[k]]


def base(text):
    return [s for s in pii.spans(text, pii.automaton()) if s[0] in pii.KINDS[:4]]


@pytest.mark.parametrize("alphabet", ["a@.-1", "12. -", "+12 ().-", "0123456789 -", "a1@.%+-é 😀", "129.256 @"])
def test_base_spans_equal_expressions(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert base(text) == brute(text), text


def test_added_spans():
    text = 'x token = "abc123def" GB82 WEST 1234 5698 7654 32 y ftp://me:pw@host.org/p https://host.org/ notoken=abc1234 account: none'
    got = [(k, text[a:b]) for k, a, b in pii.spans(text, pii.automaton()) if k in ("account", "address")]
    assert got == [("account", "abc123def"), ("account", "GB82 WEST 1234 5698 7654 32"), ("address", "ftp://me:pw@host.org/p")]


def test_query_equals_expressions(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op2_anchor_pii"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = brute(d.text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in want) for k in pii.KINDS[:4]]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_mask_and_edges(spark):
    rows = [
        (1, "mail a.b@c.de now", "s", 1), (1, "mail a.b@c.de now", "s", 1), (2, None, "s", None), (3, "", None, 2), (None, "+1 (017) 555-7713", "t", 3),
        (4, "é" * 70_000 + " 1.2.3.4 5" + "x" * 9, "t", 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, c1 int")
    got = sorted(pii.mask(docs).collect(), key=str)
    assert pii.mask(docs).columns == docs.columns
    texts = {r.doc_id: r.text for r in got}
    assert len(got) == 6 and texts[1] == "mail <EMAIL> now" and texts[2] is None and texts[3] == "" and texts[None] == "<PHONE>"
    assert texts[4] == "é" * 70_000 + " <IP> 5" + "x" * 9
    assert [len(r.found) for r in pii.with_spans(docs, to="found").collect()] == [1, 1, 0, 0, 1, 1]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.mask(empty).count() == 0 and pii.find_spans(empty).count() == 0


@pytest.mark.parametrize("part", ["a://", "a://u@", "://", "a://u@h/", "://@", "@", "a@", "+1", "1.", "account ", "account: 1 ", "password=", "DE89", "DE8 9", "12 ", "a.", "a@b."])
def test_long_runs_are_read_once(part):
    """A long run of one anchor takes seconds, not hours."""
    import time

    anchors, text = pii.automaton(), part * (300_000 // len(part))
    start = time.process_time()
    pii.spans(text, anchors)
    assert time.process_time() - start < 15


def test_addresses_that_name_a_user():
    text = "see ftp://u:p@h.org/x?y=1 and http://h.org/u@v or x://@h, a://u@b://c@d"
    assert [text[a:b] for k, a, b in pii.spans(text, pii.automaton()) if k == "address"] == ["ftp://u:p@h.org/x?y=1", "a://u@b://c@d"]
