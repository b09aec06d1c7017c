"""Blocks, folds, sweeps, scores and learners against brute force on small frames."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from check import normalise
from freshet.functions.expressions import correlation, skill_scores
from freshet.operators import blocks as B, compare as C, learn as L, scores as S, sweep as SW

START = dt.date(2000, 1, 1)
KEYS = ["district", "station"]


def frame(spark, floods, n=120, key="d", step=1):
    rows = [(key, START + dt.timedelta(days=i * step), float(i), int(i in floods)) for i in range(n)]
    return spark.createDataFrame(rows, "district string, time date, x double, flood int")


def test_single_block_is_clipped_at_the_ends(spark):
    out = B.event_blocks(frame(spark, {5}), None).toPandas()
    assert out.x.min() == 0 and out.x.max() == 26 and set(out.block) == {1}


def test_close_events_share_a_block(spark):
    islands = B.event_islands(frame(spark, {30, 51, 73, 110}), None).orderBy("block").collect()
    assert [(r.first_event, r.last_event, r.n_events) for r in islands] == [(31, 52, 2), (74, 74, 1), (111, 111, 1)]


@pytest.mark.parametrize("gap", [22, 23, 30, 41, 42, 43])
def test_overlapping_blocks_are_trimmed_to_disjoint(spark, gap):
    out = B.event_blocks(frame(spark, {40, 40 + gap}, n=150), None).toPandas()
    assert not out.duplicated("x").any()
    first, second = out[out.block == 1], out[out.block == 2]
    overlap = max(0, 42 - gap + 1)
    assert first.x.max() == 61 - (overlap - overlap // 3)
    assert second.x.min() == 40 + gap - 21 + overlap // 3


def test_chain_of_three_overlapping_blocks(spark):
    out = B.event_blocks(frame(spark, {40, 65, 90}, n=150), None).toPandas()
    assert not out.duplicated("x").any() and set(out.block) == {1, 2, 3}
    for block, event in ((1, 40), (2, 65), (3, 90)):
        assert event in set(out[out.block == block].x)


def test_folds_partition_rows_by_block(spark):
    df = frame(spark, set(range(20, 900, 60)), n=1000)
    folded = B.block_folds(B.event_blocks(df, None)).toPandas()
    assert (folded.groupby("block").fold.nunique() == 1).all()
    first = folded.drop_duplicates("block").sort_values("block")
    assert list(first.fold) == [(i % 5) + 1 for i in range(len(first))]


@pytest.mark.parametrize("n_floods", [5, 6, 7, 8, 9, 13])
def test_flood_count_folds_every_remainder(spark, n_floods):
    positions = [7 * (i + 1) for i in range(n_floods)]
    out = B.flood_count_folds(frame(spark, set(positions)), ["district"], "time").orderBy("time").toPandas()
    k, r = divmod(n_floods, 5)
    sizes = {0: [k] * 5, 1: [k] * 4 + [k + 1], 2: [k + 1] * 2 + [k] * 3, 3: [k + 1] * 3 + [k] * 2,
             4: [k + 1] * 4 + [k]}[r]
    assert list(out.groupby("fold").flood.sum()) == sizes
    assert out.fold.is_monotonic_increasing
    for f in range(1, 5):
        assert out[out.fold == f].flood.iloc[-1] == 1


def test_too_few_floods_give_no_folds(spark):
    assert B.flood_count_folds(frame(spark, {1, 2, 3}), ["district"], "time").count() == 0


@pytest.mark.parametrize("n_floods", [2, 5, 9, 10])
def test_chronological_split(spark, n_floods):
    positions = [5 * (i + 1) for i in range(n_floods)]
    out = B.chronological_split(frame(spark, set(positions)), ["district"], "time").toPandas()
    bound = int(n_floods - np.ceil(0.2 * n_floods))
    assert out[out.is_train].x.max() == positions[bound - 1]
    assert out[out.is_train].flood.sum() == bound


def test_sequences_keep_full_windows(spark):
    df = frame(spark, {50}).withColumn("block", F.lit(1))
    out = B.sequences(df, ["district", "block"], "time", ["x"], 7).orderBy("time").collect()
    assert len(out) == 114 and [v[0] for v in out[0].sequence] == [float(i) for i in range(7)]
    assert sum(r.flood for r in out) == 1


def random_days(spark, seed, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for district, station in (("d1", "a"), ("d1", "b"), ("d2", "c")):
        for i in range(n):
            value = None if rng.random() < 0.05 else float(np.round(rng.gamma(2.0, 3.0), 1))
            rows.append((district, station, START + dt.timedelta(days=i), value, int(rng.random() < 0.04)))
    return spark.createDataFrame(rows, "district string, station string, time date, max_dt_3days double, flood int")


def brute_events(pdf, threshold, per_day):
    pred = (pdf.max_dt_3days >= threshold).astype(int)
    run = pred.diff().ne(0).cumsum()
    hit = (pdf.flood == 1) & (pred == 1)
    hits = int(hit.sum()) if per_day else run[hit].nunique()
    warnings = int(pred[pred.shift() != pred].sum())
    misses = int(((pdf.flood == 1) & (pred == 0)).sum())
    return hits, misses, warnings - hits


@pytest.mark.parametrize("mode", ["per_run", "per_day"])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_event_sweep_equals_brute_force(spark, seed, mode):
    days = random_days(spark, seed)
    percents = [10, 50, 80, 99]
    pdf = days.toPandas().sort_values(["station", "time"])
    cuts = {s: [float(np.round(g.max_dt_3days.quantile(p / 100), 6)) for p in percents] for s, g in pdf.groupby("station")}
    thresholds = spark.createDataFrame(
        [("d1" if s != "c" else "d2", s, v) for s, v in cuts.items()],
        "district string, station string, thresholds array<double>",
    )
    got = {
        (r.station, r.percent): (r.hits, r.misses, r.false_alarms)
        for r in SW.event_sweep(days, thresholds, KEYS, "max_dt_3days", percents, hits=mode).collect()
    }
    for s, g in pdf.groupby("station"):
        for p, cut in zip(percents, cuts[s]):
            assert got[s, p] == brute_events(g.reset_index(drop=True), cut, mode == "per_day")
    plain = days.join(thresholds, KEYS).withColumn(
        "predicted", F.coalesce((F.col("max_dt_3days") >= F.col("thresholds")[1]).cast("int"), F.lit(0))
    )
    for r in S.event_scores(plain, KEYS, "time", hits=mode).collect():
        assert (r.hits, r.misses, r.false_alarms) == got[r.station, 50]


@pytest.mark.parametrize("seed", [3, 4])
def test_sweep_equals_brute_force(spark, seed):
    days = random_days(spark, seed)
    out = SW.threshold_scores(days, KEYS, "max_dt_3days").toPandas()
    pdf = days.toPandas()
    pdf["time"] = pd.to_datetime(pdf.time)
    for s, g in pdf.groupby("station"):
        block = g.set_index("time").max_dt_3days.groupby(pd.Grouper(freq="6ME")).max()
        rows = out[out.station == s].set_index("percent")
        assert list(rows.sort_index().index) == list(range(50, 100))
        for p in (50, 73, 99):
            pred = g.max_dt_3days >= round(block.quantile(p / 100), 6)
            obs = g.flood == 1
            cells = [(obs & pred).sum(), (obs & ~pred).sum(), (~obs & pred).sum(), (~obs & ~pred).sum()]
            assert list(rows.loc[p, S.CELLS]) == cells


def test_skill_score_guards(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (2, 1, 1, 4)], "h int, m int, f int, c int")
    exprs = skill_scores(F.col("h"), F.col("m"), F.col("f"), F.col("c"))
    zero, some = df.select(*[e.alias(n) for n, e in exprs.items()]).collect()
    assert zero.f1 == 0.0 and zero.pod == 0.0 and zero.far == 0.0
    assert some.f1 == pytest.approx(4 / 6) and some.pod == pytest.approx(2 / 3) and some.pofd == pytest.approx(0.2)


def test_best_by_breaks_ties_and_ignores_nulls(spark):
    rows = [("d", "b", 50, 0.5), ("d", "a", 70, 0.5), ("d", "a", 60, 0.5), ("d", "c", 10, None)]
    df = spark.createDataFrame(rows, "district string, station string, percent int, f1 double")
    best = SW.best_by(df, ["district"], "f1", ["station", "percent"]).first()
    assert (best.station, best.percent) == ("a", 60)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "flood int")
    weights = {r.flood: r.weight for r in S.class_weights(df).collect()}
    assert weights == {1: 2.0, 0: pytest.approx(2 / 3)}


def test_average_rank_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0), ("d", 0.5)], "var string, c double")
    ranks = {r["var"]: r["rank"] for r in C.average_rank(df.withColumn("k", F.lit(1)), ["k"], F.col("c")).collect()}
    assert ranks == {"a": 1.5, "c": 1.5, "b": 3.0, "d": 4.0}


def test_sign_test_counts_matched_districts(spark):
    rows = [("A", d, 0.6, 0.1) for d in "xyz"] + [("B", d, 0.4, 0.2) for d in "xy"]
    df = spark.createDataFrame(rows, "model string, district string, f1 double, csi double")
    out = {(r.model_a, r.model_b, r.score): r for r in C.sign_test(df, ["A", "B"], ["f1", "csi"]).collect()}
    assert out["A", "B", "f1"].wins == 2 and out["A", "B", "f1"].n == 2
    assert out["A", "B", "f1"].z == pytest.approx(1 / (0.5 * 2**0.5))
    assert out["B", "A", "csi"].wins == 2


def test_best_model_order_wins_ties_and_needs_a_score(spark):
    rows = [("A", "x", 0.5), ("B", "x", 0.5), ("A", "y", 0.1), ("B", "y", 0.3), ("A", "z", 0.0)]
    df = spark.createDataFrame(rows, "model string, district string, f1 double")
    best = {r.district: r.best_model for r in C.best_model(df, ["B", "A"]).collect()}
    assert best == {"x": "B", "y": "B"}


def test_logistic_fit_reaches_a_stationary_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 1).astype(float)
    c = 0.5
    beta = L.logistic_fit(x, y, c)
    a = np.column_stack([x, np.ones(200)])
    weight = c * np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (1 - y).sum()))
    gradient = np.append(beta[:-1], 0) + a.T @ (weight * (1 / (1 + np.exp(-a @ beta)) - y))
    assert np.abs(gradient).max() < 1e-6


def test_district_logistic_predicts_every_row_once(spark):
    rng = np.random.default_rng(7)
    rows = []
    for district in ("d1", "d2"):
        for i in range(600):
            flood = int(i % 60 == 30)
            rows.append((district, START + dt.timedelta(days=i), flood, flood * 3 + float(rng.normal()), float(rng.normal())))
    df = spark.createDataFrame(rows, "district string, time date, flood int, x double, z double")
    blocked = B.event_blocks(df, None)
    pred = L.district_logistic(blocked, ["x", "z"], grid=[0.1, 1])
    assert pred.count() == blocked.count()
    scores = {r.district: r for r in L.model_scores(pred).collect()}
    assert all(r.avg_pod > 0.7 for r in scores.values())
    coefs = L.coefficients(pred, ["x", "z"])
    ranks = C.ranks_over_folds(C.average_rank(coefs, ["district", "fold"], F.col("coef")), ["district"], [1, 2, 3, 4, 5])
    assert {r["var"] for r in ranks.where("rank_sum = 5").collect()} == {"x"}


def test_balanced_groups_equal_greedy():
    sizes = pd.Series({"a": 9, "b": 7, "c": 6, "d": 5, "e": 1})
    assert L.balanced_groups(sizes, 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    # d goes to the lighter fold: 9 < 13, then e to 13 < 14


def test_group_folds_keep_blocks_whole(spark):
    rows = [("d", b, i) for b, n in ((1, 5), (2, 3), (3, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "district string, block long, i int")
    out = {r.block: r.inner_fold for r in L.group_folds(df, n_folds=2).collect()}
    assert out == {1: 0, 2: 1, 3: 1}


def test_panel_learners_return_one_row_per_district(spark):
    rng = np.random.default_rng(11)
    rows = []
    for district in ("d1", "d2"):
        for i in range(400):
            flood = int(i % 40 == 20)
            rows.append((district, START + dt.timedelta(days=i), flood, flood * 3 + float(rng.normal())))
    df = spark.createDataFrame(rows, "district string, time date, flood int, x double")
    trees = L.boosted_trees(df, ["x"], max_iter=3)
    assert trees.count() == df.count()
    assert S.daily_scores(trees, ["district"]).where("pod > 0.5").count() == 2
    blocked = B.event_blocks(df, None)
    svc = L.district_svc(blocked, ["x"], grid=[1.0])
    assert svc.count() == blocked.count()
    seqs = B.sequences(B.block_folds(blocked), ["district", "block", "fold"], "time", ["x"], 3)
    overall, per_district = L.sequence_classifier(seqs, seeds=(1,), max_iter=40, n_folds=3)
    assert per_district.count() == 2
    # Rounds end where the held-back fold no longer gains, not at the limit, and are reported per fit.
    rounds = {r.test_fold: r.rounds for r in overall.collect()}
    assert set(rounds) == {1, 2, 3} and all(1 <= n <= 40 for n in rounds.values()) and min(rounds.values()) < 40
    with pytest.raises(ValueError, match="three folds"):
        L.sequence_classifier(seqs, n_folds=2)


def learner_rows(seed=21, n=500, gap=60):
    """Days of one district with an event every `gap` days that x announces weakly."""
    rng = np.random.default_rng(seed)
    flood = np.array([int(i % gap == 25) for i in range(n)])
    x = np.column_stack([flood * 2 + rng.normal(size=n), rng.normal(size=n)])
    return [("d", START + dt.timedelta(days=i), int(flood[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]


def descent(x, y, c, slope):
    """Minimiser of |w|^2 / 2 + c * sum of weighted losses, by plain descent with shrinking steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = c * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    keep = np.array([1.0] * x.shape[1] + [0.0])
    b, rate = np.zeros(a.shape[1]), 1.0 / (1 + 2 * (w[:, None] * a * a).sum())
    for _ in range(60_000):
        b = b - rate * (keep * b + a.T @ (w * slope(a @ b, y)))
    return b


def logistic_slope(z, y):
    return 1 / (1 + np.exp(-z)) - y


def hinge_slope(z, y):
    s = 2 * y - 1
    return -2 * s * np.maximum(1 - s * z, 0)


@pytest.mark.parametrize("fit, slope", [(L.logistic_fit, logistic_slope), (L.margin_fit, hinge_slope)])
def test_linear_fits_equal_plain_descent(fit, slope):
    rng = np.random.default_rng(3)
    y = (rng.random(60) < 0.3).astype(float)
    x = rng.normal(size=(60, 2)) + y[:, None]
    for c in (0.05, 1.0):
        assert np.allclose(fit(x, y, c), descent(x, y, c, slope), atol=1e-4)
    with pytest.raises(ValueError, match="converge"):
        fit(x, y, 1.0, n_steps=1)


@pytest.mark.parametrize("model, fit, grid", [
    (L.district_logistic, L.logistic_fit, L.LOGISTIC_C), (L.district_svc, L.margin_fit, L.SVC_C),
])
def test_district_models_equal_a_plain_restatement(spark, model, fit, grid):
    df = spark.createDataFrame(learner_rows(), "district string, time date, flood int, a double, b double")
    blocked = B.event_blocks(df, None).cache()
    got = model(blocked, ["a", "b"]).toPandas().sort_values(["test_fold", "time"])
    rows = B.block_folds(blocked).toPandas().sort_values(["time", "block"])
    for k in range(1, 6):
        train, test = rows[rows.fold != k], rows[rows.fold == k]
        load, inner = [0] * min(5, train.block.nunique()), {}
        for block, size in sorted(train.groupby("block").size().items(), key=lambda s: -s[1]):
            inner[block] = load.index(min(load))
            load[inner[block]] += size
        place, y = train.block.map(inner).to_numpy(), train.flood.to_numpy().astype(float)
        x = train[["a", "b"]].to_numpy()
        means = []
        for c in grid:
            scores = []
            for j in range(len(load)):
                beta = fit(x[place != j], y[place != j], c)
                p = x[place == j] @ beta[:-1] + beta[-1] > 0
                hits = (p & (y[place == j] == 1)).sum()
                scores.append(2 * hits / (2 * hits + (p != (y[place == j] == 1)).sum()) if hits else 0.0)
            means.append(np.mean(scores))
        best = grid[int(np.argmax(means))]
        beta = fit(x, y, best)
        mine = got[got.test_fold == k]
        assert set(mine.best_c) == {best}
        assert mine.predicted.tolist() == (test[["a", "b"]].to_numpy() @ beta[:-1] + beta[-1] > 0).astype(int).tolist()
        assert np.allclose(np.abs(mine.coefs.dropna().iloc[0]), np.abs(beta[:-1]))


def test_few_blocks_are_refused(spark):
    df = spark.createDataFrame(learner_rows(n=230), "district string, time date, flood int, a double, b double")
    blocked = B.event_blocks(df, None)
    assert B.block_support(blocked).first().reason == "fewer blocks than folds"
    assert L.district_logistic(blocked, ["a", "b"]).count() == 0


def test_boosted_trees_by_hand():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    y = np.array([0.0, 0.0, 1.0, 1.0])
    # Balanced classes start at odds 0; the split at 1.5 has leaves -2 and +2.
    assert np.allclose(L.boosted_scores(x, y, 1, 1, 0.1), [-0.2, -0.2, 0.2, 0.2])
    p = 1 / (1 + np.exp(-0.2))
    second = 0.2 + 0.1 * (1 - p) / (p * (1 - p))
    assert np.allclose(L.boosted_scores(x, y, 2, 1, 0.1), [-second, -second, second, second])
    rng = np.random.default_rng(5)
    z = rng.normal(size=(300, 3))
    target = ((z[:, 0] > 0.5) & (z[:, 1] < 0)).astype(float)
    assert ((L.boosted_scores(z, target) > 0) == target).mean() > 0.98


def test_district_boosted_predicts_every_day(spark):
    df = spark.createDataFrame(learner_rows(), "district string, time date, flood int, a double, b double")
    out = L.district_boosted(df, ["a", "b"], n_trees=20)
    assert out.count() == 500 and S.daily_scores(out, ["district"]).first()["pod"] > 0.5


def test_best_by_falls_back_to_hits(spark):
    rows = [("a", 50, None, 3), ("a", 60, None, 7), ("b", 50, 0.1, 9), ("b", 60, 0.4, 1)]
    df = spark.createDataFrame(rows, "district string, percent int, f1 double, hits int")
    assert {r.district: r.percent for r in SW.best_by(df, ["district"], "f1", ["percent"]).collect()} == {"a": 60, "b": 60}


@pytest.mark.parametrize("view", ["v_series", "v_nation_series", "v_impact", "v_rain"])
def test_lines_are_not_sent_through_the_driver(spark, sf_dir, view):
    """On tables that look small, lineitem stays where it is; the districts are hashed."""
    from freshet.plans import views

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2**31))
    try:
        plan = getattr(views, view)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin [l_suppkey#" in plan and "BroadcastHashJoin [l_suppkey#" not in plan


def test_correlation_of_a_constant_is_nan(spark):
    """Pairs decide: a constant side or a single pair gives NaN, no pair gives NULL, as in the SQL."""
    rng = np.random.default_rng(3)
    x, flood = rng.normal(size=40), (np.arange(40) % 7 == 0).astype(int)
    groups = {
        "varied": list(zip(x.tolist(), flood.tolist())),
        "constant": [(0.1, f) for f in flood.tolist()],
        "no flood": [(v, 0) for v in x.tolist()],
        "one": [(2.0, 1)],
        "one pair": [(2.0, 1), (None, 0), (3.0, None)],
        "constant pairs": [(50.0, 1), (50.0, 0), (7.0, None)],
        "tiny": [(1e-200, 1), (2e-200, 0)],
        "none": [(None, 1), (2.0, None)],
    }
    rows = [(g, *pair) for g, pairs in groups.items() for pair in pairs]
    df = spark.createDataFrame(rows, "g string, x double, flood int").repartition(3)
    found = {r.g: r.c for r in df.groupBy("g").agg(correlation(F.col("x"), F.col("flood")).alias("c")).collect()}
    assert found.pop("varied") == pytest.approx(np.corrcoef(x, flood)[0, 1], abs=1e-12)
    assert found.pop("none") is None
    assert all(np.isnan(c) for c in found.values()), found


def test_coef_rank_of_a_fold_with_constant_rain(spark, tmp_path):
    """With many lines a day every maximum is 50; the ranks of such folds equal the SQL's."""
    # A day in the first block of the western district stays below.
    low, events = 15, range(20, 500, 45)
    lines = [
        (s, 49.0 if (s, i) == (2, low) else 50.0, 100.0 + 37 * i % 91, (i * 7 + j) % 10 / 100, (i * 3 + j) % 8 / 100,
         "AN"[i % 2], pd.Timestamp(START) + pd.Timedelta(days=i))
        for s in (1, 2) for i in range(500) for j in range(10 if i in events else 1 + i % 3)
    ]
    tables = {
        "region": [(0, "EAST"), (1, "WEST")],
        "nation": [(0, "E", 0), (1, "W", 1)],
        "supplier": [(1, 0), (2, 1)],
        "lineitem": lines,
    }
    names = {
        "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "supplier": "s_suppkey s_nationkey",
        "lineitem": "l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_shipdate",
    }
    con = duckdb.connect()
    for t, rows in tables.items():
        frame = pd.DataFrame(rows, columns=names[t].split())
        if t == "lineitem":
            frame["l_shipdate"] = frame["l_shipdate"].astype("datetime64[us]")
        frame.to_parquet(tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    out = queries()["coef_rank"](spark, str(tmp_path)).toPandas()
    assert normalise(out).equals(normalise(con.execute(oracle_sql()["coef_rank"]).df()))
    ranks = out.set_index(["district", "var"])
    assert len(out) == 8 and (ranks.loc[("EAST", "rain_max"), [f"rank_{k}" for k in range(1, 6)]] == 1).all()
    assert ranks.loc[("WEST", "rain_max"), "rank_1"] > 1 and ranks.loc[("WEST", "rain_max"), "rank_2"] == 1
