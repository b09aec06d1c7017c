"""Classifiers on the event blocks.

Small models of single districts run side by side as grouped tasks; models over the
whole panel use Spark ML, which spreads the rows. Frames that an iterative fit reads
again and again are written to the checkpoint folder first.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from freshet.operators.blocks import N_FOLDS, block_folds, block_support
from freshet.operators.scores import CELLS, add_rates, add_skill, class_weights, contingency, fold_summary
from freshet.session import cut_lineage

# Regularisation grids.
LOGISTIC_C = [0.01, 0.05, 0.1, 0.5, 1, 1.25, 1.5]
SVC_C = [0.001, 0.005, 0.01, 0.05, 0.1, 0.2, 0.5, 1]
# Most boosting rounds of the panel model; rounds stop early on a held-back part.
MOST_ROUNDS = 500
# Fits of the panel model that run at once.
PARALLEL_FITS = 8


def balanced_groups(sizes: pd.Series, n_folds: int) -> dict:
    """Groups in descending size go to the lightest fold, the lowest fold first on ties."""
    load, fold_of = np.zeros(n_folds), {}
    for group, size in sizes.sort_values(ascending=False, kind="stable").items():
        fold = int(load.argmin())
        fold_of[group] = fold
        load[fold] += size
    return fold_of


def group_folds(blocked: DataFrame, key: str = "district", block: str = "block", n_folds: int = N_FOLDS) -> DataFrame:
    """Fold of every block so that blocks stay whole and folds hold similar row counts.

    Only the block sizes of one key, a short list, enter a task.
    """
    sizes = blocked.groupBy(key, block).agg(F.count(F.lit(1)).alias("n_rows"))
    schema = T.StructType([*sizes.schema.fields, T.StructField("inner_fold", T.IntegerType())])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(block)
        folds = balanced_groups(pdf.set_index(block)["n_rows"], min(n_folds, len(pdf)))
        return pdf.assign(inner_fold=pdf[block].map(folds).astype("int32"))

    return sizes.groupBy(key).applyInPandas(assign, schema)


def logistic_fit(
    x: np.ndarray, y: np.ndarray, c: float, start: np.ndarray | None = None, n_steps: int = 200
) -> np.ndarray:
    """Coefficients, intercept last, of L2-penalised logistic regression with balanced weights.

    Minimises |w|^2 / 2 + c * sum of weighted losses by Newton steps; the intercept is
    free. `start` may hold the solution for a neighbouring c.
    """
    a = np.column_stack([x, np.ones(len(x))])
    weight = c * np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    penalty = np.append(np.ones(x.shape[1]), 0.0)
    beta = np.zeros(a.shape[1]) if start is None else start.copy()

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float((penalty * b * b).sum() / 2 + (weight * (np.logaddexp(0, z) - y * z)).sum())

    for _ in range(n_steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
        gradient = penalty * beta + a.T @ (weight * (p - y))
        hessian = np.diag(penalty + 1e-10) + (a * (weight * p * (1 - p))[:, None]).T @ a
        step = np.linalg.solve(hessian, gradient)
        size, before = 1.0, loss(beta)
        while loss(beta - size * step) > before and size > 1e-8:
            size /= 2
        beta = beta - size * step
        # Newton steps end at the optimum or where rounding allows no further descent.
        if np.abs(size * step).max() < 1e-8 or size <= 1e-8:
            return beta
    raise ValueError(f"logistic fit did not converge in {n_steps} steps")


def margin_fit(
    x: np.ndarray, y: np.ndarray, c: float, start: np.ndarray | None = None, n_steps: int = 200
) -> np.ndarray:
    """Coefficients, intercept last, of a linear support vector classifier with balanced weights.

    Minimises |w|^2 / 2 + c * sum of weighted squared hinge losses. The loss is piecewise
    quadratic, so Newton steps on the rows inside the margin end exactly.
    """
    a = np.column_stack([x, np.ones(len(x))])
    side = np.where(y == 1, 1.0, -1.0)
    weight = c * np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    penalty = np.append(np.ones(x.shape[1]), 0.0)
    beta = np.zeros(a.shape[1]) if start is None else start.copy()

    def loss(b: np.ndarray) -> float:
        short = np.maximum(1 - side * (a @ b), 0)
        return float((penalty * b * b).sum() / 2 + (weight * short * short).sum())

    for _ in range(n_steps):
        short = np.maximum(1 - side * (a @ beta), 0)
        gradient = penalty * beta - 2 * a.T @ (weight * side * short)
        hessian = np.diag(penalty + 1e-10) + 2 * (a * (weight * (short > 0))[:, None]).T @ a
        step = np.linalg.solve(hessian, gradient)
        size, before = 1.0, loss(beta)
        while loss(beta - size * step) > before and size > 1e-8:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8 or size <= 1e-8:
            return beta
    raise ValueError(f"support vector fit did not converge in {n_steps} steps")


def _predict(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return (x @ beta[:-1] + beta[-1] > 0).astype("int32")


def _f1(y: np.ndarray, p: np.ndarray) -> float:
    hits = ((y == 1) & (p == 1)).sum()
    wrong = (y != p).sum()
    return 0.0 if hits == 0 else float(2 * hits / (2 * hits + wrong))


def district_linear(
    blocked: DataFrame, features: list[str], fit: Callable, grid: list[float], key: str = "district",
    label: str = "flood", time: str = "time"
) -> DataFrame:
    """Out-of-fold predictions of one linear model per (key, outer fold); `fit` as `logistic_fit`.

    C comes from grouped cross-validation on f1 inside the training blocks. A task holds
    the event blocks of one district, which the calendar bounds; districts and outer
    folds all run in parallel. Keys that `block_support` refuses yield no rows, its
    table names the reason. `coefs` stands on the first row of a fold only.
    """
    allowed = block_support(blocked, key).where(F.col("reason") == "ok").select(key)
    folded = block_folds(blocked.join(allowed, key, "left_semi"), key).select(key, time, "block", "fold", label, *features)
    jobs = folded.withColumn("test_fold", F.explode(F.sequence(F.lit(1), F.lit(N_FOLDS))))
    schema = (
        f"{key} string, test_fold int, {time} date, {label} int, predicted int, best_c double, coefs array<double>"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([time, "block"])
        outer = pdf["test_fold"].iloc[0]
        train, test = pdf[pdf["fold"] != outer], pdf[pdf["fold"] == outer]
        sizes = train.groupby("block").size()
        y = train[label].to_numpy().astype(float)
        if len(test) == 0 or y.min() == y.max():
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        x = train[features].to_numpy(dtype=float)
        n_inner = min(N_FOLDS, len(sizes))
        inner = train["block"].map(balanced_groups(sizes, n_inner)).to_numpy()
        scores = np.zeros((n_inner, len(grid)))
        for k in range(n_inner):
            used, held, beta = inner != k, inner == k, None
            for j, c in enumerate(grid):
                beta = fit(x[used], y[used], c, beta)
                scores[k, j] = _f1(y[held], _predict(x[held], beta))
        best = float(grid[int(scores.mean(axis=0).argmax())])
        beta = fit(x, y, best)
        return pd.DataFrame({
            key: test[key], "test_fold": outer, time: test[time], label: test[label].astype("int32"),
            "predicted": _predict(test[features].to_numpy(dtype=float), beta), "best_c": best,
            "coefs": [beta[:-1].tolist(), *[None] * (len(test) - 1)],
        })

    return jobs.groupBy(key, "test_fold").applyInPandas(run, schema)


def district_logistic(
    blocked: DataFrame, features: list[str], key: str = "district", label: str = "flood",
    time: str = "time", grid: list[float] = LOGISTIC_C
) -> DataFrame:
    return district_linear(blocked, features, logistic_fit, grid, key, label, time)


def district_svc(
    blocked: DataFrame, features: list[str], key: str = "district", label: str = "flood",
    time: str = "time", grid: list[float] = SVC_C
) -> DataFrame:
    """Linear support vector classifier per district; C chosen per (district, outer fold)."""
    return district_linear(blocked, features, margin_fit, grid, key, label, time)


def model_scores(predictions: DataFrame, key: str = "district") -> DataFrame:
    """avg_* and std_* scores over outer folds per key, cells as rates."""
    scored = add_skill(contingency(predictions, [key, "test_fold"]))
    total = F.col("hits") + F.col("misses") + F.col("false_alarms") + F.col("corr_neg")
    scored = scored.withColumn("floods", F.col("hits") + F.col("misses")).withColumn("_n", total)
    columns = ["floods", "f1", *CELLS, "pod", "far", "pofd", "csi"]
    return fold_summary(add_rates(scored, "_n").drop("_n"), [key], columns)


def coefficients(predictions: DataFrame, features: list[str], key: str = "district") -> DataFrame:
    """Absolute coefficient of each feature per (key, fold), one row per feature."""
    per_fold = predictions.groupBy(key, F.col("test_fold").alias("fold")).agg(F.first("coefs", ignorenulls=True).alias("_c"))
    entries = F.array(*[
        F.struct(F.lit(f).alias("var"), F.abs(F.col("_c")[i]).alias("coef")) for i, f in enumerate(features)
    ])
    return per_fold.select(key, "fold", F.explode(entries).alias("e")).select(key, "fold", "e.*")


def assemble(df: DataFrame, features: list[str], categories: list[str] = (), label: str = "flood") -> DataFrame:
    """One feature vector per row; categories become 0/1 vectors without the last level."""
    stages: list = []
    for c in categories:
        stages.append(StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_v_{c}"))
    stages.append(VectorAssembler(inputCols=[*features, *[f"_v_{c}" for c in categories]], outputCol="features"))
    made = Pipeline(stages=stages).fit(df).transform(df)
    return made.withColumn("label", F.col(label).cast("double")).drop(
        *[f"_{k}_{c}" for c in categories for k in "iv"]
    )


def _predicted(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted", F.col("prediction").cast("int")).drop(
        "prediction", "rawPrediction", "probability", "features", "label"
    )


def boosted_trees(
    wide: DataFrame, features: list[str], key: str = "district", label: str = "flood",
    max_iter: int = 100, max_depth: int = 3, seed: int = 1
) -> DataFrame:
    """Boosted trees over the whole panel, scored on the rows they were trained on.

    Classes weigh n / n_c; missing inputs count as 0.
    """
    filled = class_weights(wide.na.fill(0, subset=features), label, balanced=False)
    prepared = cut_lineage(assemble(filled, features, [key], label))
    model = GBTClassifier(weightCol="weight", maxIter=max_iter, maxDepth=max_depth, stepSize=0.1, seed=seed)
    return _predicted(model.fit(prepared).transform(prepared)).drop("weight")


def grow_tree(x: np.ndarray, order: np.ndarray, residual: np.ndarray, weight: np.ndarray, hessian: np.ndarray,
              rows: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values of a regression tree for all rows; `rows` marks those of this node.

    A split maximises the reduction of the weighted squared error of the residuals; a leaf
    takes one Newton step of the log loss.
    """
    best = (1e-12, None, None)
    w, wr = weight[rows].sum(), (weight * residual)[rows].sum()
    if depth and rows.sum() > 1:
        for f in range(x.shape[1]):
            at = order[:, f]
            at = at[rows[at]]
            v = x[at, f]
            left_w = np.cumsum(weight[at])[:-1]
            left_r = np.cumsum((weight * residual)[at])[:-1]
            gain = left_r**2 / left_w + (wr - left_r) ** 2 / np.maximum(w - left_w, 1e-12) - wr**2 / w
            gain[v[1:] == v[:-1]] = 0
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (gain[k], f, (v[k] + v[k + 1]) / 2)
    _, f, cut = best
    if f is None:
        bottom = (weight * hessian)[rows].sum()
        return np.where(rows, wr / bottom if bottom > 1e-12 else 0.0, 0.0)
    low = x[:, f] <= cut
    return (
        grow_tree(x, order, residual, weight, hessian, rows & low, depth - 1)
        + grow_tree(x, order, residual, weight, hessian, rows & ~low, depth - 1)
    )


def boosted_scores(x: np.ndarray, y: np.ndarray, n_trees: int = 100, depth: int = 3, rate: float = 0.1) -> np.ndarray:
    """Log odds of the training rows after boosting trees on the log loss; classes weigh n / n_c."""
    weight = np.where(y == 1, len(y) / max(y.sum(), 1), len(y) / max((1 - y).sum(), 1))
    share = np.average(y, weights=weight)
    odds = np.full(len(y), np.log(share / (1 - share)))
    order, rows = np.argsort(x, axis=0, kind="stable"), np.ones(len(y), bool)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-odds))
        odds = odds + rate * grow_tree(x, order, y - p, weight, p * (1 - p), rows, depth)
    return odds


def district_boosted(
    wide: DataFrame, features: list[str], key: str = "district", label: str = "flood", time: str = "time",
    n_trees: int = 100, depth: int = 3
) -> DataFrame:
    """Boosted trees per district, scored on the rows they were trained on.

    A task holds the daily rows of one district, which the calendar bounds. Missing inputs
    count as 0; a district with one class is predicted as that class.
    """
    schema = f"{key} string, {time} date, {label} int, predicted int"
    filled = wide.select(key, time, F.col(label).cast("int").alias(label), *features).na.fill(0, subset=features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        y = pdf[label].to_numpy().astype(float)
        if y.min() == y.max():
            return pdf[[key, time, label]].assign(predicted=pdf[label])
        odds = boosted_scores(pdf[features].to_numpy(dtype=float), y, n_trees, depth)
        return pdf[[key, time, label]].assign(predicted=(odds > 0).astype("int32"))

    return filled.groupBy(key).applyInPandas(run, schema)


def sequence_classifier(
    sequenced: DataFrame, key: str = "district", label: str = "flood", seeds: tuple[int, ...] = tuple(range(1, 11)),
    max_iter: int = MOST_ROUNDS, max_depth: int = 3, n_folds: int = N_FOLDS, tolerance: float = 0.01
) -> tuple[DataFrame, DataFrame]:
    """Panel classifier on flattened sequences with district dummies.

    Rounds are added until the loss on a held-back part falls by less than `tolerance` of itself in a
    round, `max_iter` at most. The held-back part is the fold after the test fold, so whole event blocks
    of every district; it is neither trained nor scored on. Returns the fold scores of each fold's
    best seed, with the rounds it used, and its scores per district.
    """
    if n_folds < 3:
        raise ValueError("a test fold, a held-back fold and training rows take three folds at least")
    flat = class_weights(
        sequenced.withColumn("_flat", array_to_vector(F.flatten("sequence"))).drop("sequence"), label
    )
    prepared = cut_lineage(assemble(flat, ["_flat"], [key], label).drop("_flat"))

    def fitted(k: int, seed: int) -> DataFrame:
        gbt = GBTClassifier(
            weightCol="weight", maxIter=max_iter, maxDepth=max_depth, stepSize=0.1, subsamplingRate=0.8, seed=seed,
            validationIndicatorCol="_held", validationTol=tolerance,
        )
        model = gbt.fit(prepared.where(F.col("fold") != k).withColumn("_held", F.col("fold") == k % n_folds + 1))
        part = model.transform(prepared.where(F.col("fold") == k))
        return _predicted(part).withColumns({"test_fold": F.lit(k), "seed": F.lit(seed), "rounds": F.lit(model.getNumTrees)})

    # Fits are jobs of many short stages: a few at a time keep the executors busy.
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        jobs = {(k, seed): pool.submit(fitted, k, seed) for k in range(1, n_folds + 1) for seed in seeds}
        parts = {at: job.result() for at, job in jobs.items()}
    best_parts = None
    for k in range(1, n_folds + 1):
        runs = cut_lineage(reduce(DataFrame.unionByName, [parts[k, seed] for seed in seeds]))
        scored = add_skill(contingency(runs, ["seed"]))
        # One row per seed: the driver sees a single number.
        best = scored.agg(F.min_by("seed", F.struct(-F.col("f1"), "seed"))).first()[0]
        part = runs.where(F.col("seed") == best)
        best_parts = part if best_parts is None else best_parts.unionByName(part)
    overall = add_skill(contingency(best_parts, ["test_fold", "seed", "rounds"]))
    per_district = add_skill(contingency(best_parts, ["test_fold", key]))
    return overall, fold_summary(per_district, [key], ["f1", "csi", *CELLS])
