"""Lines that name a holder go, clauses that begin with the same words stay."""

import textwrap

import pytest

from freshet.llm import licenses


@pytest.mark.parametrize("name, text", [("ISC", licenses._ISC), ("MIT", licenses._MIT)])
def test_wrapped_clauses_stay(spark, name, text):
    before = text.replace(" copyright ", "\ncopyright ").replace(" COPYRIGHT ", "\nCOPYRIGHT ")
    texts = [before, *("Copyright (c) 2020 X\n\n" + "\n\n".join(textwrap.fill(p, w) for p in text.split("\n\n")) for w in range(40, 100, 3))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.license for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()} == {name}


def test_lines_of_holders(spark):
    gone = ["Copyright (c) 2020 X", "(C) 1999 Y", "# Copyright The Foo Authors", "Copyright: 2020 Z", "(c) Acme Corp", "© B", "Copyright [yyyy] [name]"]
    kept = ["copyright notice and", "(c) You must retain", "COPYRIGHT HOLDERS OR", "copyrighted work", "copyright, patent", "copyright"]
    df = spark.createDataFrame([(x,) for x in gone + kept], "t string")
    forms = {r.t: r.f for r in df.select("t", licenses.whole_form(licenses.canonical_lines(df.t)).alias("f")).collect()}
    assert [x for x in gone if forms[x]] == [] and [x for x in kept if not forms[x]] == []


@pytest.mark.parametrize("sign", ["(c)", "(c) ", "copyright", "copyright ", "©", "© ", "Copyright (c) ", "-", "\t"])
def test_long_repeats_of_a_sign(spark, sign):
    """Lines of a hundred thousand signs neither overflow the stack nor take long."""
    rows = [(1, sign * 100_000), (2, "Copyright " + sign * 100_000 + " Someone\nReleased under the MIT License."), (3, "x\n" + sign * 100_000 + "and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.notices for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()} == {1: "", 2: "MIT", 3: ""}


LINES = [
    "Copyright (c) 2020 X", "(C) 1999 Y", "# Copyright The Foo Authors", "Copyright: 2020 Z", "(c) Acme Corp", "© B", "Copyright [yyyy] [name]", "copyright notice and",
    "(c) You must retain", "COPYRIGHT HOLDERS OR", "copyrighted work", "copyright, patent", "copyright", "Copyright (c) holders", "Copyright the", "copyright the  ", "copyright the software",
    "copyright the softwares", "(c)copyrighted by x", "copyright (c)copyrighted by x", "copyright - x", "copyright-x", "copyright :: (c) -- 2020", "* copyright © © 1", "copyright © in all",
    "(c) - the license", "copyright ) x", "copyright  . x", "copyright a9", "copyright andy", "©copyright", "x copyright 2020", "copyright\r", "ÄCopyright 2020", "(c)", "(c) 2", "copyright the authors",
]


def test_sql_states_the_same_rule(spark):
    """Query and SQL agree on lines of holders and on whole texts, which the test tables lack."""
    import duckdb
    import pandas as pd

    from check import normalise
    from freshet.llm.licenses_query import SQL

    texts = [*LINES, "\n".join(LINES), *(f"{x}\nReleased under the MIT License.\n{x}" for x in LINES)]
    for _, _, text in licenses.whole_texts()[::4]:
        texts += [text, "Copyright (c) 2020 X\n" + text.replace("license", "licence"), text.upper(), text.replace(" copyright", "\ncopyright"), text + "\nmore"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.execute(SQL).df()
    got = licenses.scan(spark.createDataFrame(docs), licenses.known_licenses(spark)).toPandas()
    a, b = normalise(got), normalise(want)
    assert len(a) == len(texts) and list(a.columns) == list(b.columns)
    differing = (a != b).any(axis=1)
    assert not differing.any(), f"{a[differing].head(5)}\n{b[differing].head(5)}"
    assert got["license"].notna().sum() > 60
