"""Whole licence texts, wrapped at several widths and before every mention of copyright."""

import re
import textwrap

from freshet.llm import licenses


def wrapped(text, width):
    """Paragraphs wrapped anew; lines that name a holder stay lines."""
    parts = re.split(r"(\n\s*\n|\n(?=[ \t]*[Cc]opyright[ \t]+(?:\([Cc]\)|\[)[^\n]*)|(?<=\.)\n(?=[ \t]*Everyone))", text)
    return "\n\n".join(x if re.match(r"\s*copyright \(c\)|\s*copyright \[", x, re.I) else textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in parts)


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.license for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    return [found[k] for k in range(len(texts))]


def test_texts_wrapped_before_each_mention_of_copyright(spark):
    texts, want = [], []
    for name, form, text in [*licenses.KNOWN, *licenses.whole_texts()]:
        if form != "text":
            continue
        for m in re.finditer(r"(?i)(?<=[^\n]) (?=copyright\b|\(c\))(?!\S+\s+[(<\[])", text):
            if not re.search(r"(?i)copyright([ ]*\[[^\n]*)?$", text[:m.start()]):  # else a notice
                texts.append(text[:m.start()] + "\n" + text[m.end():])
                want.append(name)
    assert len(texts) > 100
    got = scanned(spark, texts)
    wrong = [(w, g, t) for w, g, t in zip(want, got, texts, strict=True) if g is None]
    assert not wrong, [(w, re.findall(r"(?im)^[ \t*#/;-]*(?:copyright|\(c\)).*", t)) for w, _, t in wrong[:5]]


def test_short_texts_wrapped_at_widths(spark):
    rows = [(n, wrapped(t, w)) for n, f, t in [*licenses.KNOWN, *licenses.whole_texts()] if f == "text" and len(t) < 3000 for w in (40, 60, 66, 72, 80, 100)]
    got = scanned(spark, [t for _, t in rows])
    assert all(got), [r for r, g in zip(rows, got, strict=True) if not g][:2]


def test_usual_copies(spark):
    texts = {x: t for x, f, t in licenses.whole_texts() if f == "text" and x in ("Apache-2.0", "GPL-3.0-only", "MPL-2.0", "Unlicense", "CC0-1.0", "LGPL-2.1-only")}
    assert len(texts) == 6
    rows = [
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2013 A. Person\n\n" + licenses._MIT), ("MIT", "Copyright The Foo Authors\n(c) Acme Corp\n© B\nCopyright 2020-2021 C\n" + licenses._MIT),
        ("ISC", "Copyright <year> D\n\n" + textwrap.fill(licenses._ISC.split("\n\n")[0], 75) + "\n\n" + licenses._ISC.split("\n\n")[1]),
        *texts.items(), (None, "Copyright holders\n(c) You must retain"), (None, texts["Apache-2.0"].replace("(c) You must retain", "(d) You must retain")),
    ]
    assert scanned(spark, [t for _, t in rows]) == [n for n, _ in rows]
