"""Exact interpolated quantiles of groups of any size, and robust scaling.

`percentile` keeps a group's values in one task, which is fine for the block maxima of
a series but not for a whole panel. Here a mergeable sketch brackets each quantile and one
more pass counts what lies below the bracket and each distinct value inside. The inside is
then narrowed by counts per bin, pass by pass, until it fits a stated number of values, and
only those are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.session import cut_lineage, shuffled

ACCURACY = 100_000
# Sketch errors, and rows, that a bracket spans at least on either side; the pass after it proves the bracket holds.
SLACK = 4
# Distinct values of one quantile that a task puts in order, and bins of a narrowing pass.
MOST_CELLS, BINS = 100_000, 4096
# Brackets, some 5 MB, up to which they are sent to every task; parts that the values of a group are dealt to beyond that.
SENT_BRACKETS, PARTS = 100_000, 64


def _brackets(flat: DataFrame, by: list[str], qs: list[float], accuracy: int) -> DataFrame:
    """(by, _b): for each quantile q its place _p among the values and bounds _lo, _hi around it.

    Bounds are values of the sketch at distances of SLACK errors, twice that and so on; the nearest that is
    also SLACK rows away is taken, the extremes if there is none.
    """
    margin = SLACK / accuracy
    steps = [margin * 2**j for j in range(64) if margin * 2**j < 1.0]
    wanted = [p for q in qs for d in steps for p in (q - d, q + d) if 0.0 < p < 1.0]
    aggregates = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    if wanted:
        aggregates.append(F.percentile_approx("_v", F.array(*[F.lit(p) for p in wanted]), accuracy).alias("_s"))
    ends = flat.groupBy(*by).agg(*aggregates)

    def bound(q: float, sign: int, extreme: str) -> Column:
        out = F.col(extreme)
        for d in reversed(steps):
            if 0.0 < q + sign * d < 1.0:
                out = F.when(F.col("_n") * F.lit(d) >= SLACK, F.col("_s")[wanted.index(q + sign * d)]).otherwise(out)
        return out

    return ends.select(*by, F.array(*[
        F.struct(
            F.lit(float(q)).alias("q"), ((F.col("_n") - 1) * F.lit(float(q))).alias("_p"),
            bound(q, -1, "_min").alias("_lo"), bound(q, 1, "_max").alias("_hi"),
        ) for q in qs
    ]).alias("_b"))


def _upto(cells: DataFrame, by: list[str], order: Column) -> DataFrame:
    """`cells` with `_upto`: values up to and with each cell of a quantile."""
    w = Window.partitionBy(*by, "q").orderBy(order)
    return cells.withColumn("_upto", F.col("_below") + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def narrowed(cells: DataFrame, by: list[str], most_cells: int, few_groups: bool, bins: int = BINS) -> DataFrame:
    """`cells` (by, q, _p, _lo, _hi, _below, _x, _c) cut to the ones around each quantile, at most `most_cells` of each.

    A pass counts the values in equal bins of a range, finds the bins with the ranks below and above the
    quantile and keeps their cells; their own extremes are the next range. Counts combine before the
    shuffle and a quantile has at most `bins` of them, so no task holds its values before they are few.
    """
    state, most_cells = ["q", "_p", "_lo", "_hi", "_below"], max(most_cells, 2)
    while True:
        cells = cut_lineage(cells)
        most = cells.groupBy(*by, "q").agg(F.count(F.lit(1)).alias("_m")).agg(F.max("_m")).first()[0]
        if (most or 0) <= most_cells:
            return cells
        # Halves first, so that a range of doubles does not overflow.
        place = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        unbounded = (F.col("_lo") == float("-inf")) | (F.col("_hi") == float("inf"))
        endless = F.when(F.col("_x") == float("-inf"), 0).when(F.col("_x") == float("inf"), 2).otherwise(1)
        number = F.when(F.col("_lo") == F.col("_hi"), 0).when(unbounded, endless).otherwise(F.least(F.floor(place * bins), F.lit(bins - 1)))
        counts = cells.groupBy(*by, *state, number.cast("long").alias("_bin")).agg(
            F.sum("_c").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most")
        )
        summed = _upto(counts, by, F.col("_bin"))
        lower, upper = F.col("_upto") > F.floor("_p"), F.col("_upto") > F.ceil("_p")
        chosen = summed.groupBy(*by, "q").agg(
            F.min(F.when(lower, F.struct("_bin", "_least", "_most", (F.col("_upto") - F.col("_c")).alias("_under"), "_upto"))).alias("_a"),
            F.min(F.when(upper, F.struct("_bin", "_least", "_most"))).alias("_z"),
        )
        # Ranks in different bins are the last value of one and the first of the other: two cells are left.
        split = F.col("_a._bin") < F.col("_z._bin")
        chosen = chosen.select(
            *by, "q", split.alias("_split"), F.when(split, F.col("_a._most")).otherwise(F.col("_a._least")).alias("_from"),
            F.when(split, F.col("_z._least")).otherwise(F.col("_z._most")).alias("_to"), F.when(split, F.col("_a._upto") - 1).otherwise(F.col("_a._under")).alias("_under"),
        )
        kept = cells.join(F.broadcast(chosen) if few_groups else chosen, [*by, "q"]).where(F.col("_x").between(F.col("_from"), F.col("_to")))
        cells = kept.select(
            *by, "q", "_p", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), F.col("_under").alias("_below"), "_x",
            F.when(F.col("_split") & (F.col("_x") == F.col("_from")), F.lit(1).cast("long")).otherwise(F.col("_c")).alias("_c"),
        )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, qs: list[float], accuracy: int = ACCURACY,
    few_groups: bool = False, most_cells: int = MOST_CELLS
) -> DataFrame:
    """One row per (keys, q) with the linearly interpolated quantile of `value`.

    All passes combine before their shuffle, so a hot group costs no more than others, and at
    most `most_cells` values of a quantile are ordered in one task.
    `few_groups` states that the number of groups is fixed by the caller (columns, say),
    and lets the brackets be broadcast; else they are counted. Few go to the values, where these are;
    of many each is copied to PARTS parts of its group, so no task sorts the values of a whole group.
    """
    by = list(keys) or ["_all"]
    flat = df.where(F.col(value).isNotNull()).select(
        *keys, *([] if keys else [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v")
    )
    brackets = _brackets(flat, by, qs, accuracy)
    if not few_groups:
        brackets = cut_lineage(brackets)
        few_groups = brackets.count() * len(qs) <= SENT_BRACKETS
    if few_groups:
        met = flat.join(F.broadcast(brackets), by)
    else:
        parts = brackets.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        met = flat.withColumn("_part", F.pmod(F.xxhash64("_v"), F.lit(PARTS)).cast("int")).join(shuffled(parts), [*by, "_part"])
    placed = (
        met
        .select(*by, "_v", F.explode("_b").alias("_b"))
        .select(*by, "_b.*", "_v")
        .where(F.col("_v") <= F.col("_hi"))
    )
    # Values below the bracket share the NULL cell.
    counted = cut_lineage(placed.groupBy(*by, "q", "_p", "_lo", "_hi", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_x")).agg(
        F.count(F.lit(1)).alias("_c")
    ))
    below = counted.where("_x IS NULL").select(*by, "q", F.col("_c").alias("_below"))
    inside = counted.where("_x IS NOT NULL").join(F.broadcast(below) if few_groups else below, [*by, "q"], "left").select(
        *by, "q", "_p", "_lo", "_hi", F.coalesce("_below", F.lit(0)).cast("long").alias("_below"), "_x", "_c"
    )
    upto = _upto(narrowed(inside, by, most_cells, few_groups), by, F.col("_x"))

    def at(rank: Column) -> Column:
        """Smallest cell that reaches the rank, unless what lies below the bracket has it already."""
        return F.when(F.min("_below") <= F.min(rank), F.min_by("_x", F.when(F.col("_upto") > rank, F.col("_upto"))))

    found = upto.groupBy(*by, "q").agg(
        F.first("_p").alias("_p"), at(F.floor("_p")).alias("_low"), at(F.ceil("_p")).alias("_high")
    )
    low, high = F.col("_low"), F.col("_high")
    exact = F.when(low == high, low).otherwise(low + (high - low) * (F.col("_p") - F.floor("_p")))
    checked = F.coalesce(exact, F.raise_error(F.lit("quantile outside its bracket: raise the accuracy")))
    return found.select(*keys, "q", checked.cast("double").alias("value"))


def _scaled(c: str, low, mid, high):
    iqr = high - low
    return ((F.col(c) - mid) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)).alias(c)


def robust_scale(df: DataFrame, keys: list[str], columns: list[str], train: Column | None = None) -> DataFrame:
    """(x - median) / (p75 - p25) per key; a zero range counts as 1.

    Groups are daily series of one district, so the calendar bounds them and a window over the key
    computes its quartiles where the rows are; the frame is not evaluated a second time for them. `train` is an
    optional boolean column that restricts the rows the statistics are taken from.
    """
    group = Window.partitionBy(*keys)

    def quartiles(c: str) -> Column:
        used = F.col(c) if train is None else F.when(train, F.col(c))
        return F.percentile(used, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(group).alias(f"_q_{c}")

    def scaled(c: str) -> Column:
        q = F.col(f"_q_{c}")
        return _scaled(c, q[0], q[1], q[2])

    measured = df.select("*", *[quartiles(c) for c in columns])
    return measured.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def robust_scale_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """Robust scaling over the whole frame, with quantiles found in a distributed way."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns
    ])).alias("s")).select("s.column", "s.v")
    quantiles = exact_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75], few_groups=True)
    # A scalar subquery: one struct with three numbers for each scaled column.
    stats = quantiles.agg(F.struct(*[
        F.max(F.when((F.col("column") == c) & (F.col("q") == q), F.col("value"))).alias(f"{n}_{c}")
        for c in columns for q, n in ((0.25, "lo"), (0.5, "mid"), (0.75, "hi"))
    ]).alias("s")).scalar()
    attached = df.withColumn("_s", stats)
    return attached.select(*[
        _scaled(c, F.col(f"_s.lo_{c}"), F.col(f"_s.mid_{c}"), F.col(f"_s.hi_{c}")) if c in columns else F.col(c)
        for c in df.columns
    ])
