"""Cross-validated evaluation: fits a split at a time, out-of-sample forecasts, metrics, gates and verdicts."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import sdiv
from ..plans.shipping import ship
from . import volatility as V

Estimator = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def logistic(l2: float = 1.0, steps: int = 25) -> Estimator:
    """Weighted ridge-penalised logistic regression by Newton steps; predicts -1 or 1."""

    def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, test: np.ndarray) -> np.ndarray:
        m, s = x.mean(axis=0), x.std(axis=0) + 1e-12
        a = np.hstack([np.ones((len(x), 1)), (x - m) / s])
        t = (y > 0).astype(float)
        b, pen = np.zeros(a.shape[1]), l2 * np.eye(a.shape[1])
        pen[0, 0] = 1e-9
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            g = a.T @ (w * (t - p)) - pen @ b
            h = (a * (w * p * (1 - p))[:, None]).T @ a + pen
            step = np.linalg.solve(h, g)
            b += step
            if np.abs(step).max() < 1e-9:
                break
        z = np.hstack([np.ones((len(test), 1)), (test - m) / s]) @ b
        return np.where(z > 0, 1, -1)

    return fit


def majority() -> Estimator:
    def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, test: np.ndarray) -> np.ndarray:
        return np.full(len(test), 1 if (w * np.sign(y)).sum() > 0 else -1)

    return fit


def momentum(column: int = 0) -> Estimator:
    """The sign of one feature."""

    def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, test: np.ndarray) -> np.ndarray:
        return np.where(test[:, column] > 0, 1, -1)

    return fit


ESTIMATORS: dict[str, Callable[[], Estimator]] = {"logistic": logistic, "majority": majority, "momentum": momentum}


def grid(**values: list) -> list[dict]:
    """All combinations of parameter values, in a fixed order."""
    names = sorted(values)
    return [dict(zip(names, v, strict=True)) for v in itertools.product(*(values[n] for n in names))]


def fit_splits(matrix: DataFrame, splits: DataFrame, features: list[str], estimators: dict[str, Estimator], target: str = "y", weight: str = "w") -> DataFrame:
    """``estimator, split, row, y, w, pred``: every estimator fitted on each split's training rows, one task a split.

    ``matrix(row, features, y, w)``; ``splits(split, row, role)``. A split's matrix must fit one task: labels are events, not bars.
    """
    ship(matrix.sparkSession)
    joined = splits.select("split", "row", "role").join(matrix.select("row", *features, target, weight), "row")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["role", "row"])
        train, test = pdf[pdf.role == "train"], pdf[pdf.role == "test"]
        out = []
        for name, fit in estimators.items():
            x = train[features].to_numpy(float)
            pred = fit(x, train[target].to_numpy(float), train[weight].to_numpy(float), test[features].to_numpy(float)) if len(train) else np.zeros(len(test))
            out.append(pd.DataFrame({"estimator": name, "split": test.split, "row": test.row, "y": test[target].astype(float), "w": test[weight].astype(float), "pred": pred.astype(float)}))
        return pd.concat(out)

    return joined.groupBy("split").applyInPandas(run, "estimator string, split int, row int, y double, w double, pred double")


def accuracy(preds: DataFrame, by: list[str]) -> DataFrame:
    """Weighted accuracy, share of up calls, rows and balanced accuracy."""
    hit = (F.signum("pred") == F.signum("y")).cast("double")
    up, dn = F.col("y") > 0, F.col("y") <= 0
    return preds.groupBy(*by).agg(F.count("*").alias("n"), sdiv(F.sum(hit * F.col("w")), F.sum("w")).alias("accuracy"), F.avg((F.col("pred") > 0).cast("double")).alias("up_share"), ((F.avg(F.when(up, hit)) + F.avg(F.when(dn, hit))) / 2).alias("balanced_accuracy"))


def summary(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean, deviation (population), least, median and most over paths."""
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.percentile(x, 0.5).alias("median"), F.max(x).alias("max"))


def signal_returns(preds: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """Moments of sign(pred) * return, gross, and in excess of always being long."""
    gross = F.signum("pred") * F.col(ret)
    g = V.moments(preds.withColumn("_g", gross), by, "_g").select(*by, "n", F.col("sharpe").alias("gross_sharpe"), F.col("skew").alias("gross_skew"), F.col("kurt").alias("gross_kurt"))
    e = V.moments(preds.withColumn("_e", gross - F.col(ret)), by, "_e").select(*by, F.col("sharpe").alias("excess_sharpe"))
    return g.join(e, by) if by else g.join(e)


def meta_skill(df: DataFrame, by: list[str], y: str = "y", p: str = "p", tau: float = 0.5) -> DataFrame:
    """Balanced accuracy of p > tau, share acted on, hit rate when acting and always."""
    act = F.col(p) > tau
    return df.groupBy(*by).agg(((F.avg(F.when(F.col(y) == 1, act.cast("double"))) + F.avg(F.when(F.col(y) == 0, (~act).cast("double")))) / 2).alias("balanced_accuracy"), F.avg(act.cast("double")).alias("action_rate"), F.avg(F.when(act, F.col(y).cast("double"))).alias("hit_acted"), F.avg(F.col(y).cast("double")).alias("hit_always"))


def anchored_ols(df: DataFrame, y: str, xs: list[str], keys: list[str], order: str, first: int, steps: int) -> DataFrame:
    """Out-of-sample forecasts by anchored steps: rows from place ``first`` on are cut into ``steps`` parts, each forecast by the fit on all rows before it.

    Training sums of a part are running sums over parts, so no row is joined to the parts after it.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ok = F.lit(True)
    for c in (y, *xs):
        ok = ok & F.col(c).isNotNull()
    d = df.where(ok).withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    size = F.greatest(F.ceil((F.col("_n") - first) / steps), F.lit(1))
    d = d.withColumn("step", F.when(F.col("_p") < first, -1).otherwise(F.least(F.floor((F.col("_p") - first) / size), F.lit(steps - 1))).cast("int"))
    terms = {"n": F.lit(1.0), "sy": F.col(y)} | {f"s{i}": F.col(a) for i, a in enumerate(xs)} | {f"p{i}": F.col(a) * F.col(y) for i, a in enumerate(xs)} | {f"q{i}_{j}": F.col(a) * F.col(b) for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j}
    sums = d.groupBy(*keys, "step").agg(*[F.sum(t).alias(k) for k, t in terms.items()])
    before = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    t = sums.select(*keys, "step", *[F.sum(k).over(before).alias(k) for k in terms]).where("step >= 0")

    def cov(i: int, j: int | None) -> Column:
        pair = F.col(f"p{i}") if j is None else F.col(f"q{min(i, j)}_{max(i, j)}")
        other = F.col("sy") if j is None else F.col(f"s{j}")
        return pair - F.col(f"s{i}") * other / F.col("n")

    if len(xs) == 1:
        slopes = [sdiv(cov(0, None), cov(0, 0))]
    elif len(xs) == 2:
        det = cov(0, 0) * cov(1, 1) - cov(0, 1) * cov(0, 1)
        slopes = [sdiv(cov(0, None) * cov(1, 1) - cov(1, None) * cov(0, 1), det), sdiv(cov(1, None) * cov(0, 0) - cov(0, None) * cov(0, 1), det)]
    else:
        raise ValueError("one or two regressors")
    fit = F.col("sy") / F.col("n")
    for i, b in enumerate(slopes):
        fit = fit - b * F.col(f"s{i}") / F.col("n")
    coef = t.select(*keys, "step", fit.alias("b_0"), *[b.alias(f"b_{i + 1}") for i, b in enumerate(slopes)])
    out = d.where("step >= 0").join(coef, [*keys, "step"])
    forecast = F.col("b_0")
    for i, a in enumerate(xs):
        forecast = forecast + F.col(f"b_{i + 1}") * F.col(a)
    return out.withColumn("forecast", forecast).drop("_p", "_n", "b_0", *[f"b_{i + 1}" for i in range(len(xs))])


def verdict(metrics: DataFrame, gates: dict[str, tuple[str, str, float]], keys: list[str]) -> DataFrame:
    """One boolean a gate (metric, comparison, bound) and ``passed`` if all hold; a missing metric fails its gate."""
    compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
    found = {f"gate_{k}": F.coalesce(compare[op](F.col(m), F.lit(b)), F.lit(False)) for k, (m, op, b) in gates.items()}
    df = metrics.withColumns(found)
    passed = F.lit(True)
    for k in found:
        passed = passed & F.col(k)
    return df.withColumn("passed", passed).select(*keys, *found, "passed")


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metric differences b - a by key."""
    j = a.select(*keys, *[F.col(m).alias(f"a_{m}") for m in metrics]).join(b.select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics]), keys)
    return j.select(*keys, *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"d_{m}") for m in metrics])


def same_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """``only_a, only_b``: rows of one side missing from the other; both zero for paired comparisons."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).agg(F.count("*").alias("only_a")).join(y.exceptAll(x).agg(F.count("*").alias("only_b")))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """A frame's content hash that row order cannot change: the sum of row hashes, and the number of rows."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("hash_sum"))
