"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month to season.
SEASON_MONTHS = {
    "summer": (6, 7, 8),
    "fall": (9, 10, 11),
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
}
SEASONS = ["fall", "spring", "summer", "winter"]

# Fixed value: what replaces a zero denominator in a skill score.
ZERO_DENOMINATOR = 0.0001


def season_of(day: Column) -> Column:
    month = F.month(day)
    names = iter(SEASON_MONTHS.items())
    name, months = next(names)
    expr = F.when(month.isin(*months), name)
    for name, months in names:
        expr = expr.when(month.isin(*months), name)
    return expr


def month_index(day: Column) -> Column:
    """Months since year zero: differences count calendar months."""
    return F.year(day) * 12 + F.month(day)


def year_season(day: Column) -> Column:
    return F.concat_ws(" ", F.year(day).cast("string"), season_of(day))


def fold_accents(name: Column) -> Column:
    """Lower-case key with the accented e folded."""
    return F.translate(F.lower(name), "éÉ", "ee")


def relative_change(new: Column, old: Column) -> Column:
    return (new - old) / old * 100


def exceeds(x: Column, threshold: Column) -> Column:
    """1 when the predictor reaches the threshold; 0 otherwise, also for NULL."""
    return F.coalesce((x >= threshold).cast("int"), F.lit(0))


def _denominator(x: Column) -> Column:
    return F.when(x == 0, F.lit(ZERO_DENOMINATOR)).otherwise(x.cast("double"))


def skill_scores(hits: Column, misses: Column, false_alarms: Column, corr_neg: Column) -> dict[str, Column]:
    """f1, pod, far, pofd, csi from the four cells; zero denominators are guarded."""
    f1_den = 2 * hits + false_alarms + misses
    return {
        "f1": F.when(f1_den == 0, F.lit(0.0)).otherwise(2.0 * hits / f1_den),
        "pod": hits / _denominator(hits + misses),
        "far": false_alarms / _denominator(hits + false_alarms),
        "pofd": false_alarms / _denominator(false_alarms + corr_neg),
        "csi": hits / _denominator(hits + false_alarms + misses),
    }


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def event_skill_scores(hits: Column, misses: Column, false_alarms: Column) -> dict[str, Column]:
    """Event-based variant: correct negatives are set to the event count; 0/0 is NULL."""
    corr_neg = hits + misses
    return {
        "pod": _ratio(hits, hits + misses),
        "far": _ratio(false_alarms, hits + false_alarms),
        "pofd": _ratio(false_alarms, false_alarms + corr_neg),
        "csi": _ratio(hits, hits + false_alarms + misses),
    }


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the pairs of a group: NaN when a side is constant, NULL without pairs.

    F.corr divides by the spreads, which is an error when one is zero.
    """
    paired = x.isNotNull() & y.isNotNull()
    a, b = (F.when(paired, side.cast("double")) for side in (x, y))
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) > 0, F.coalesce(F.when(varied, r), F.lit(float("nan"))))


def threshold_objective(pod: Column, far: Column, weight_far: float = 0.5) -> Column:
    """Lower is better: weighted sum of false-alarm ratio and missed-event ratio."""
    return weight_far * far + (1 - weight_far) * (1 - pod)


def step_up(x: Column, step: float) -> Column:
    return F.ceil(x / F.lit(step)) * F.lit(step)


def step_down(x: Column, step: float) -> Column:
    return F.floor(x / F.lit(step)) * F.lit(step)


def rounded(columns: list[str], digits: int = 6) -> list[Column]:
    return [F.round(F.col(c), digits).alias(c) for c in columns]
