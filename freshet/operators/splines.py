"""Splines through the known points of a series, solved in JVM expressions.

A spline couples all points of a series. Its equations are tridiagonal, so they are solved by two
ordered recurrences over the array of points: elimination forwards, substitution backwards. A daily
series is bounded by the calendar, so its array fits a task; series are independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A state is copied at each step, so results are gathered in runs of this many.
RUN = 64
LEAST_POINTS = {2: 3, 3: 4}


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states (of type `kind`) that a fold of `items`, a column, from `zero` has after each item."""
    none = F.array().cast(f"array<{kind}>")
    runs = F.transform(F.sequence(F.lit(1), F.size(items), F.lit(RUN)), lambda at: F.slice(items, at, RUN))

    def one(state: Column, item: Column) -> Column:
        return F.struct(step(state["last"], item).alias("last"), F.concat(state["open"], F.array(step(state["last"], item))).alias("open"))

    def whole(state: Column, run: Column) -> Column:
        start = F.struct(state["last"].alias("last"), none.alias("open"))
        return F.aggregate(run, start, one, lambda s: F.struct(s["last"].alias("last"), F.concat(state["done"], F.array(s["open"])).alias("done")))

    start = F.struct(zero.cast(kind).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.flatten(F.aggregate(runs, start, whole, lambda s: s["done"]))


def followers(equations: Column) -> Column:
    """Elimination in rows of tridiagonal (lower, main, upper, right) equations: the share c of x[i + 1] in x[i]."""
    return running(equations, F.lit(0.0), lambda c, row: row["upper"] / (row["main"] - row["lower"] * c), "double")


def pivots(equations: Column, shares: Column) -> Column:
    """(lower, right, pivot) of each row once the unknown before it is replaced."""
    def row(r: Column, i: Column) -> Column:
        before = F.coalesce(F.get(shares, i - 1), F.lit(0.0))
        return F.struct(r["lower"].alias("lower"), r["right"].alias("right"), (r["main"] - r["lower"] * before).alias("pivot"))

    return F.transform(equations, row)


def eliminated(rows: Column) -> Column:
    """The constants d of the eliminated rows: x[i] = d[i] - c[i] * x[i + 1]."""
    return running(rows, F.lit(0.0), lambda d, r: (r["right"] - r["lower"] * d) / r["pivot"], "double")


def backwards(constants: Column, shares: Column) -> Column:
    """(d, c) of the eliminated rows from the last to the first."""
    return F.reverse(F.transform(constants, lambda d, i: F.struct(d.alias("d"), F.get(shares, i).alias("c"))))


def substituted(rows: Column) -> Column:
    """The unknowns of eliminated rows that come from the last to the first."""
    return F.reverse(running(rows, F.lit(0.0), lambda later, r: r["d"] - r["c"] * later, "double"))


def _equation(lower: Column, main: Column, upper: Column, right: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in {"lower": lower, "main": main, "upper": upper, "right": right}.items()])


def gaps(points: Column) -> Column:
    """Width `h` and slope `d` of each gap between neighbouring points."""
    def gap(i: Column) -> Column:
        h = F.get(points, i + 1)["x"] - F.get(points, i)["x"]
        return F.struct(h.alias("h"), ((F.get(points, i + 1)["y"] - F.get(points, i)["y"]) / h).alias("d"))

    return F.transform(F.sequence(F.lit(0), F.size(points) - 2), gap)


def slope_equations(gap: Column) -> Column:
    """Equations of the slopes at the points of a cubic spline.

    The third derivative is continuous at the second and the second-last point, so the ends need no slope of their own.
    """
    n = F.size(gap)

    def end(near: Column, far: Column) -> tuple[Column, Column]:
        """The coefficient of the inner neighbour and the right side at one end."""
        both = near["h"] + far["h"]
        return both, ((near["h"] + 2 * both) * far["h"] * near["d"] + near["h"] * near["h"] * far["d"]) / both

    def row(i: Column) -> Column:
        a, b, zero = F.get(gap, i - 1), F.get(gap, i), F.lit(0.0)
        first, first_right = end(F.get(gap, F.lit(0)), F.get(gap, F.lit(1)))
        last, last_right = end(F.get(gap, n - 1), F.get(gap, n - 2))
        inner = _equation(b["h"], 2 * (a["h"] + b["h"]), a["h"], 3 * (b["h"] * a["d"] + a["h"] * b["d"]))
        return (
            F.when(i == 0, _equation(zero, F.get(gap, F.lit(1))["h"], first, first_right))
            .when(i == n, _equation(last, F.get(gap, n - 2)["h"], zero, last_right)).otherwise(inner)
        )

    return F.transform(F.sequence(F.lit(0), n), row)


def breaks(points: Column) -> Column:
    """Ends of the pieces of a spline of order two: midway between points, except beside the first and the last."""
    n = F.size(points)
    at = lambda i: F.get(points, i)["x"]
    return F.transform(
        F.sequence(F.lit(0), n - 2), lambda i: F.when(i == 0, at(i)).when(i == n - 2, at(n - 1)).otherwise((at(i) + at(i + 1)) / 2)
    )


def parabola_weights(cuts: Column, piece: Column, x: Column) -> tuple[Column, Column, Column]:
    """Weights at `x` of the three coefficients that shape a piece."""
    low, high = F.get(cuts, piece), F.get(cuts, piece + 1)
    before, after = F.coalesce(F.get(cuts, piece - 1), low), F.coalesce(F.get(cuts, piece + 2), high)
    falling = (high - x) * (high - x) / ((high - low) * (high - before))
    rising = (x - low) * (x - low) / ((high - low) * (after - low))
    return falling, 1 - falling - rising, rising


def coefficient_equations(points: Column, cuts: Column) -> Column:
    """Equations of the coefficients of a spline of order two; the ends are the first and the last value."""
    n = F.size(points)

    def row(i: Column) -> Column:
        point, zero = F.get(points, i), F.lit(0.0)
        weights = parabola_weights(cuts, i - 1, point["x"])
        return F.when((i == 0) | (i == n - 1), _equation(zero, F.lit(1.0), zero, point["y"])).otherwise(_equation(*weights, point["y"]))

    return F.transform(F.sequence(F.lit(0), n - 1), row)


def cubic_value(points: Column, slopes: Column, before: Column, x: Column) -> Column:
    """The cubic between point `before` (from 0) and the next one."""
    i = F.greatest(F.lit(0), F.least(before, F.size(points) - 2))
    left, right = F.get(points, i), F.get(points, i + 1)
    h = right["x"] - left["x"]
    t = (x - left["x"]) / h
    u = 1 - t
    return (
        (1 + 2 * t) * u * u * left["y"] + t * u * u * h * F.get(slopes, i)
        + t * t * (3 - 2 * t) * right["y"] - t * t * u * h * F.get(slopes, i + 1)
    )


def parabola_value(points: Column, cuts: Column, coefficients: Column, before: Column, x: Column) -> Column:
    """The parabola of the piece that holds `x`, which lies after point `before` (from 0)."""
    middle = (F.get(points, before)["x"] + F.get(points, before + 1)["x"]) / 2
    piece = F.greatest(F.lit(0), F.least(before - F.when(x < middle, 1).otherwise(0), F.size(points) - 3))
    weights = parabola_weights(cuts, piece, x)
    first, second, third = (w * F.get(coefficients, piece + k) for k, w in enumerate(weights))
    return first + second + third


def fill(df: DataFrame, keys: list[str], columns: list[str], time: str = "time", backfill: bool = False, order: int = 3) -> DataFrame:
    """Gaps of `columns` filled by the spline of order 3 or 2 of each series; one shuffle serves all columns.

    Rows before the first known value stay null unless `backfill` copies it there; rows after the
    last continue the last piece. NaN counts as unknown. Series with fewer points than the order
    needs (4 or 3) keep their gaps. Of repeated days the least value is a point; all rows stay.
    """
    names, least = df.columns, LEAST_POINTS[order]
    number = {c: k for k, c in enumerate(columns)}
    kinds = {f.name: f.dataType for f in df.schema}
    day = F.unix_date(F.col(time).cast("date")).cast("double")
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_v{k}") for c, k in number.items()]
    rows = df.select("*", day.alias("_x"), *known)
    ordered = Window.partitionBy(*keys).orderBy("_x", *[F.col(f"_v{k}") for k in number.values()])
    earlier, so_far = (ordered.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    last = rows.select("*", *[
        F.last(F.when(F.col(f"_v{k}").isNotNull(), F.col("_x")), ignorenulls=True).over(earlier).alias(f"_l{k}") for k in number.values()
    ])
    fresh = {k: F.col(f"_v{k}").isNotNull() & (F.col(f"_l{k}").isNull() | (F.col(f"_l{k}") < F.col("_x"))) for k in number.values()}
    counted = last.select("*", *[e.alias(f"_f{k}") for k, e in fresh.items()]).select(
        "*", *[F.count(F.when(F.col(f"_f{k}"), 1)).over(so_far).cast("int").alias(f"_n{k}") for k in number.values()]
    ).drop(*[f"_l{k}" for k in number.values()])
    # Rows arrive in the order of the window; the sort only makes sure of it.
    in_time = lambda a, b: F.when(a["_x"] < b["_x"], -1).when(a["_x"] > b["_x"], 1).otherwise(0)
    series = counted.groupBy(*keys).agg(F.collect_list(F.struct(*counted.columns)).alias("_rows")).select(
        F.array_sort("_rows", in_time).alias("_rows")
    )

    def points(k: int) -> Column:
        found = F.filter("_rows", lambda r: r[f"_f{k}"])
        return F.transform(found, lambda r: F.struct(r["_x"].alias("x"), r[f"_v{k}"].alias("y")))

    def stage(name: str, make: Callable[[int], Column]) -> None:
        nonlocal series
        series = series.select("*", *[make(k).alias(f"_{name}{k}") for k in number.values()])

    stage("all", points)
    stage("p", lambda k: F.when(F.size(f"_all{k}") >= least, F.col(f"_all{k}")))
    stage("g", lambda k: gaps(F.col(f"_p{k}")) if order == 3 else breaks(F.col(f"_p{k}")))
    stage("q", lambda k: slope_equations(F.col(f"_g{k}")) if order == 3 else coefficient_equations(F.col(f"_p{k}"), F.col(f"_g{k}")))
    stage("c", lambda k: followers(F.col(f"_q{k}")))
    stage("w", lambda k: pivots(F.col(f"_q{k}"), F.col(f"_c{k}")))
    stage("d", lambda k: eliminated(F.col(f"_w{k}")))
    stage("b", lambda k: backwards(F.col(f"_d{k}"), F.col(f"_c{k}")))
    stage("s", lambda k: substituted(F.col(f"_b{k}")))

    def filled(r: Column, c: str) -> Column:
        k = number[c]
        p, g, s, before = F.col(f"_p{k}"), F.col(f"_g{k}"), F.col(f"_s{k}"), r[f"_n{k}"] - 1
        inner = cubic_value(p, s, before, r["_x"]) if order == 3 else parabola_value(p, g, s, before, r["_x"])
        head = F.get(F.col(f"_all{k}"), F.lit(0))["y"] if backfill else F.lit(None).cast("double")
        value = F.when(before < 0, head).otherwise(inner).cast(kinds[c])
        return F.when(r[f"_v{k}"].isNotNull(), r[c]).otherwise(value)

    made = F.transform("_rows", lambda r: F.struct(*[(filled(r, c) if c in number else r[c]).alias(c) for c in names]))
    return series.select(F.explode(made).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in names])
