"""Fits that stay on Spark for all (configuration, split) cells at once, selection under trial counting, and the fixed gate verdicts.

A Newton step of every cell is one job: tasks add up X'WX and X'(y - p) of their rows, a shuffle adds the tasks up, and only these sums (a
few numbers a cell) reach the driver. No split's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as S
from ..functions.exprs import sdiv
from ..plans.shipping import shared_folder, ship, written
from . import studies as ST
from . import volatility as V

PREDS = "estimator string, split int, row int, y double, w double, proba double, pred double"


@dataclass
class Cell:
    """A standardised logistic model of one split and penalty."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    l2: float
    done: bool = False

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def _features(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])


def _sums(cells, features: list[str]):
    """``cell, i, v``: the entries of X'WX and of the gradient of every unfinished cell, over this task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            split, x, y, w = np.asarray(batch.column("split")), _features(batch, features), np.asarray(batch.column("y")), np.asarray(batch.column("w"))
            for (name, k), c in cells.value.items():
                at = split == k
                if c.done or not at.any():
                    continue
                a, p = c.design(x[at]), c.proba(x[at])
                hessian, gradient = (a * (w[at] * p * (1 - p))[:, None]).T @ a, a.T @ (w[at] * ((y[at] > 0) - p))
                held[name, k] = held.get((name, k), 0) + np.append(hessian.ravel(), gradient)
        for (name, k), v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["estimator", "split", "i", "v"])

    return run


def fit_logistic(matrix: DataFrame, splits: DataFrame, features: list[str], penalties: dict[str, float], steps: int = 25) -> dict[tuple[str, int], Cell]:
    """A cell for each penalty's name and split: ridge-penalised logistic regression of y > 0 with weights w, the intercept free, by Newton steps.

    Rows with a missing feature, y or weight take no part; splits without training rows have no cell.
    """
    spark = matrix.sparkSession
    ship(spark)
    train = splits.where("role = 'train'").select(F.col("split").cast("int").alias("split"), "row").join(matrix.select("row", *[F.col(f).cast("double").alias(f) for f in features], F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")), "row").dropna()
    train = written(train.select("split", "y", "w", *features), shared_folder(spark, "logistic"), "train")
    scales = train.groupBy("split").agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()  # a row a split
    cells = {(name, r["split"]): Cell(np.array([r[f"m_{i}"] for i in range(len(features))]), np.array([r[f"s_{i}"] + 1e-12 for i in range(len(features))]), np.zeros(len(features) + 1), l2) for r in scales for name, l2 in penalties.items()}
    d = len(features) + 1
    for _ in range(steps):
        if all(c.done for c in cells.values()):
            break
        sent = spark.sparkContext.broadcast(cells)
        sums: dict[tuple[str, int], np.ndarray] = {}
        for r in train.mapInArrow(_sums(sent, features), "estimator string, split int, i int, v double").groupBy("estimator", "split", "i").agg(F.sum("v").alias("v")).collect():  # d * (d + 1) numbers a cell
            sums.setdefault((r["estimator"], r["split"]), np.zeros(d * d + d))[r["i"]] = r["v"]
        for key, v in sums.items():
            c = cells[key]
            penalty = c.l2 * np.eye(d)
            penalty[0, 0] = 1e-9
            step = np.linalg.solve(v[: d * d].reshape(d, d) + penalty, v[d * d :] - penalty @ c.weights)
            c.weights = c.weights + step
            c.done = bool(np.abs(step).max() < 1e-9)
    return cells


def predict_logistic(matrix: DataFrame, splits: DataFrame, features: list[str], cells: dict[tuple[str, int], Cell]) -> DataFrame:
    """``estimator, split, row, y, w, proba, pred`` of the test rows; ``pred`` is 1 where the probability of an up move is above a half, else -1."""
    sent = matrix.sparkSession.sparkContext.broadcast(cells)
    test = splits.where("role = 'test'").select(F.col("split").cast("int").alias("split"), F.col("row").cast("int").alias("row"))
    test = test.join(matrix.select(F.col("row").cast("int").alias("row"), *[F.col(f).cast("double").alias(f) for f in features], F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")), "row").dropna(subset=features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, x = np.asarray(batch.column("split")), _features(batch, features) if batch.num_rows else np.zeros((0, len(features)))
            for (name, k), c in sent.value.items():
                at = np.flatnonzero(split == k)
                if len(at):
                    p, take = c.proba(x[at]), batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), *(take.column(n) for n in ("split", "row", "y", "w")), pa.array(p), pa.array(np.where(p > 0.5, 1.0, -1.0))], ["estimator", "split", "row", "y", "w", "proba", "pred"])

    return test.mapInArrow(run, PREDS)


def rule(matrix: DataFrame, splits: DataFrame, name: str, sign: Column | None = None) -> DataFrame:
    """As ``predict_logistic``, without a fit: 1 where ``sign`` (a column of the matrix) is above 0, else -1; without one, the training rows' weighted majority."""
    test = splits.where("role = 'test'").select(F.col("split").cast("int").alias("split"), F.col("row").cast("int").alias("row"))
    rows = test.join(matrix.withColumn("row", F.col("row").cast("int")), "row")
    if sign is None:
        train = splits.where("role = 'train'").select(F.col("split").cast("int").alias("split"), "row").join(matrix.select("row", "y", "w"), "row")
        side = train.groupBy("split").agg((F.sum(F.col("w") * F.signum("y")) > 0).alias("_up"))  # a row a split
        rows, up = rows.join(F.broadcast(side), "split"), F.col("_up")
    else:
        up = sign > 0
    return rows.select(F.lit(name).alias("estimator"), "split", "row", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), F.lit(None).cast("double").alias("proba"), F.when(up, 1.0).otherwise(-1.0).alias("pred"))


# --- selection -------------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Verdict:
    max_pbo: float = 0.5
    min_dsr: float = 0.95
    min_action_rate: float = 0.05
    min_macro_f1: float = 0.34
    min_balanced_accuracy: float = 0.5


def trials(preds: DataFrame, matrix: DataFrame, ret: str = "ret") -> DataFrame:
    """``estimator, n, accuracy, mean_gross, sharpe, skew, kurt, dsr``: each trial's held-out signal returns, deflated by the number of trials and the spread of their Sharpe ratios."""
    spark = preds.sparkSession
    gross = preds.join(matrix.select("row", F.col(ret).alias("_r")), "row").withColumn("_g", F.signum("pred") * F.col("_r"))
    hit = (F.signum("pred") == F.signum("y")).cast("double")
    score = gross.groupBy("estimator").agg(sdiv(F.sum(hit * F.col("w")), F.sum("w")).alias("accuracy"), F.avg("_g").alias("mean_gross"))
    rows = V.moments(gross, ["estimator"], "_g").join(score, "estimator").collect()  # a row a trial
    ratios = [r["sharpe"] for r in rows if r["sharpe"] is not None]
    spread = float(np.var(ratios, ddof=1)) if len(ratios) > 1 else 0.0
    dsr = lambda r: None if r["sharpe"] is None or not spread else float(S.deflated_sharpe(r["sharpe"], spread, len(rows), r["n"], r["skew"], r["kurt"]))
    return spark.createDataFrame([(r["estimator"], r["n"], r["accuracy"], r["mean_gross"], r["sharpe"], r["skew"], r["kurt"], dsr(r)) for r in rows], "estimator string, n long, accuracy double, mean_gross double, sharpe double, skew double, kurt double, dsr double")


def macro_f1(df: DataFrame, truth: str, pred: str, classes: list[int], by: list[str] | None = None) -> DataFrame:
    """``by, macro_f1``: the mean F1 of all ``classes``; one without hits counts 0."""
    by = by or []
    each = df.select(*by, F.col(truth).alias("_t"), F.col(pred).alias("_p"), F.explode(F.array(*[F.lit(c) for c in classes])).alias("_c"))
    is_t, is_p = (F.col("_t") == F.col("_c")).cast("long"), (F.col("_p") == F.col("_c")).cast("long")
    f1 = each.groupBy(*by, "_c").agg(F.coalesce(sdiv(2 * F.sum(is_t * is_p), F.sum(is_t) + F.sum(is_p)), F.lit(0.0)).alias("f1"))
    return f1.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def _present(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def common_gates(v: Verdict = Verdict()) -> dict[str, Column]:
    """The gates both verdicts share, on ``pbo, dsr, mean_gross, action_rate, path_median_sharpe``; what is missing fails."""
    return {
        "gate_pbo": _present(F.col("pbo") < v.max_pbo), "gate_dsr": _present(F.col("dsr") > v.min_dsr), "gate_gross": _present(F.col("mean_gross") > 0),
        "gate_action": _present(F.col("action_rate") >= v.min_action_rate), "gate_paths": _present(F.col("path_median_sharpe") > 0),
    }


def micro_gates(v: Verdict = Verdict()) -> dict[str, Column]:
    """Six gates of a three-class model: the common ones and ``macro_f1``."""
    return common_gates(v) | {"gate_f1": _present(F.col("macro_f1") >= v.min_macro_f1)}


def meta_gates(v: Verdict = Verdict()) -> dict[str, Column]:
    """Six gates of an act-or-not model: the common ones, and skill: ``balanced_accuracy`` at least the floor and ``hit_acted`` above ``hit_always``."""
    skill = (F.col("balanced_accuracy") >= v.min_balanced_accuracy) & (F.col("hit_acted") > F.col("hit_always"))
    return common_gates(v) | {"gate_skill": _present(skill)}


def judged(stats: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """The statistics with a boolean a gate and ``passed`` if all hold."""
    passed = F.lit(True)
    for g in gates:
        passed = passed & F.col(g)
    return stats.withColumns(gates).withColumn("passed", passed)


def search(matrix: DataFrame, folds: DataFrame, paths: DataFrame, features: list[str], penalties: dict[str, float], ret: str = "ret", parts: int = 6, verdict: Verdict = Verdict()) -> tuple[DataFrame, DataFrame]:
    """``(trials, verdict row)``: all configurations under ``folds`` (``split, row, role``), the best by accuracy (ties: by name) put through ``paths`` (combinatorial splits), and judged.

    The selected one alone is fitted on the combinatorial splits; the deflation and the probability of overfitting count every configuration tried.
    """
    preds = written(predict_logistic(matrix, folds, features, fit_logistic(matrix, folds, features, penalties)), shared_folder(matrix.sparkSession, "search"), "preds")
    table = trials(preds, matrix, ret)
    best = max(sorted(table.collect(), key=lambda r: r["estimator"]), key=lambda r: r["accuracy"])  # a row a trial
    name = best["estimator"]
    signed = preds.join(matrix.select("row", F.col(ret).alias("_r")), "row").select("estimator", "row", (F.signum("pred") * F.col("_r")).alias("r"))
    pbo = ST.overfitting(signed, parts).select("pbo")
    chosen = predict_logistic(matrix, paths, features, fit_logistic(matrix, paths, features, {name: penalties[name]}))
    chosen = chosen.join(paths.where("role = 'test'").select(F.col("split").cast("int").alias("split"), "row", "path"), ["split", "row"]).join(matrix.select("row", F.col(ret).alias("_r")), "row")
    by_path = V.moments(chosen.withColumn("_g", F.signum("pred") * F.col("_r")), ["path"], "_g")
    median = by_path.agg(F.percentile("sharpe", 0.5).alias("path_median_sharpe"), F.count("*").alias("paths"))
    own = preds.where(F.col("estimator") == name)
    rates = own.agg(F.avg((F.col("pred") != 0).cast("double")).alias("action_rate"))
    f1 = macro_f1(own.select(F.signum("y").cast("int").alias("t"), F.col("pred").cast("int").alias("p")), "t", "p", [-1, 1])
    row = table.where(F.col("estimator") == name).withColumn("n_trials", F.lit(len(penalties)))
    for one in (pbo, median, rates, f1):  # a row each
        row = row.join(F.broadcast(one))
    return table, judged(row, micro_gates(verdict))
