"""Splines solved by recurrences against dense solves, and their edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import impute, splines

START = dt.date(2020, 1, 1)


def dense_cubic(x, y, at):
    """Truncated powers: a cubic and one cube per inner knot but the second and the second-last point."""
    knots = x[2:-2]
    scale = lambda t: (t - x[0]) / (x[-1] - x[0])

    def powers(t):
        return np.column_stack([scale(t) ** k for k in range(4)] + [np.maximum(scale(t) - scale(c), 0) ** 3 for c in knots])

    return powers(at) @ np.linalg.solve(powers(x), y)


def dense_parabolas(x, y, at):
    knots = (x[1:-2] + x[2:-1]) / 2
    scale = lambda t: (t - x[0]) / (x[-1] - x[0])

    def powers(t):
        return np.column_stack([scale(t) ** k for k in range(3)] + [np.maximum(scale(t) - scale(c), 0) ** 2 for c in knots])

    return powers(at) @ np.linalg.solve(powers(x), y)


def frame(spark, rows):
    return spark.createDataFrame([(k, START + dt.timedelta(int(t)), None if v is None else float(v)) for k, t, v in rows], "k string, time date, v double")


@pytest.mark.parametrize(("order", "dense"), [(3, dense_cubic), (2, dense_parabolas)])
def test_equal_to_dense_solves(spark, order, dense):
    rng = np.random.default_rng(order)
    rows, want = [], {}
    for key, n in (("few", splines.LEAST_POINTS[order]), ("some", 9), ("more", 21)):
        x = np.cumsum(rng.integers(1, 6, n)).astype(float)
        y = rng.normal(size=n)
        at = np.arange(x[0], x[-1] + 4)
        value = dict(zip(at, dense(x, y, at), strict=True))
        known = dict(zip(x, y, strict=True))
        rows += [(key, t, known.get(t)) for t in at]
        want |= {(key, START + dt.timedelta(int(t))): known.get(t, value[t]) for t in at}
    out = impute.interpolate_spline(frame(spark, rows), ["k"], ["v"], order=order)
    got = {(r.k, r.time): r.v for r in out.collect()}
    assert got.keys() == want.keys()
    for at in want:
        assert got[at] == pytest.approx(want[at], rel=1e-6, abs=1e-6), at


def test_states_across_runs(spark):
    """Recurrences over more items than a run holds."""
    n = 3 * splines.RUN + 5
    sums = spark.range(1).select(splines.running(F.sequence(F.lit(1), F.lit(n)), F.lit(0.0), lambda s, x: s + x, "double").alias("s")).first().s
    assert sums == [k * (k + 1) / 2 for k in range(1, n + 1)]
    x = np.arange(0, 2 * n, 2)
    cubic = lambda t: 1e-6 * t**3 - 1e-3 * t**2 + t + 4
    rows = [("a", t, float(cubic(t)) if t % 2 == 0 else None) for t in range(int(x[-1]) + 1)]
    for r in impute.interpolate_spline(frame(spark, rows), ["k"], ["v"]).collect():
        assert r.v == pytest.approx(cubic((r.time - START).days), rel=1e-9)


def test_edge_cases(spark):
    rows = [
        ("none", 0, None), ("none", 1, None),
        ("two", 0, 1.0), ("two", 1, None), ("two", 2, 3.0),
        ("again", 0, 0.0), ("again", 2, 2.0), ("again", 2, 5.0), ("again", 2, None), ("again", 3, None), ("again", 4, 4.0), ("again", 6, 6.0),
        ("nan", 0, None), ("nan", 1, 1.0), ("nan", 2, float("nan")), ("nan", 3, 3.0), ("nan", 4, 4.0), ("nan", 5, 5.0),
        (None, 0, 0.0), (None, 1, 1.0), (None, 2, None), (None, 3, 3.0), (None, 4, 4.0),
    ]
    df = frame(spark, rows).withColumn("_x", F.lit("extra"))

    def values(**how):
        found = impute.interpolate_spline(df.withColumnRenamed("_x", "x"), ["k"], ["v"], **how).collect()
        return {(k, t): sorted((r.v for r in found if r.k == k and (r.time - START).days == t), key=str) for k, t, _ in rows}

    got = values()
    assert got["none", 0] == [None] and got["two", 1] == [None] and got["nan", 0] == [None]
    assert got["again", 2] == [pytest.approx(2.0), pytest.approx(2.0), 5.0] and got["again", 3] == [pytest.approx(3.0)]
    assert got["nan", 2] == [pytest.approx(2.0)] and got[None, 2] == [pytest.approx(2.0)]
    assert values(backfill=True)["nan", 0] == [1.0] and values(backfill=True)["none", 0] == [None]
    empty = impute.interpolate_spline(frame(spark, []), ["k"], ["v"])
    assert empty.columns == ["k", "time", "v"] and empty.count() == 0


def test_one_shuffle_and_no_python(spark):
    df = frame(spark, [("a", t, float(t)) for t in range(5)]).withColumn("w", F.col("v"))
    plan = impute.interpolate_spline(df, ["k"], ["v", "w"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Pandas" not in plan and "Arrow" not in plan
