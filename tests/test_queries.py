"""Every query with SQL, run side by side with DuckDB on the smallest tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from check import normalise

ORACLE, QUERIES = oracle_sql(), queries()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = normalise(QUERIES[name](spark, sf_dir).toPandas())
    want = normalise(duck.execute(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    differing = (got != want).any(axis=1)
    assert not differing.any(), f"{got[differing].head(3)}\n{want[differing].head(3)}"
