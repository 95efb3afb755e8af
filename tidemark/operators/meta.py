"""Meta-labelling as a whole, and paired arms: which rows have a primary side, whether it pays, bets gated by a model of that, selection, verdict, attribution."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as S
from ..functions.exprs import sdiv
from ..plans.shipping import shared_folder, written
from . import modeling as M
from . import selection as SE
from . import studies as ST
from . import volatility as V


def primary_side(signal: str) -> Column:
    """The signal's sign as -1, 0 or 1; 0 (no side) where it is missing, not a number or infinite."""
    x = F.col(signal).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0).otherwise(F.coalesce(F.signum(x), F.lit(0.0))).cast("int")


def meta_set(df: DataFrame, signal: str, label: str = "label") -> DataFrame:
    """The rows with a side, with ``side``, ``abs_<signal>`` and ``meta``: 1 where the label's sign is the side, 0 for the other way and for timeouts (label 0)."""
    d = df.withColumn("side", primary_side(signal)).where("side <> 0").withColumn(f"abs_{signal}", F.abs(signal))
    return d.withColumn("meta", F.coalesce(F.signum(label).cast("int") == F.col("side"), F.lit(False)).cast("int"))


def gated(df: DataFrame, proba: str = "proba", tau: float = 0.5, ret: str = "ret") -> DataFrame:
    """Adds ``acted`` (the probability is above ``tau``; a missing one is not), ``position`` (the side, or flat) and ``gross``, its return before costs."""
    d = df.withColumn("acted", F.coalesce(F.col(proba) > tau, F.lit(False)))
    d = d.withColumn("position", F.when(F.col("acted"), F.col("side").cast("double")).otherwise(0.0))
    return d.withColumn("gross", F.col("position") * F.col(ret))


def bet_stats(bets: DataFrame, by: list[str], meta: str = "meta", weight: str = "w", ret: str = "ret") -> DataFrame:
    """Of ``gated`` rows, one row a group: ``n, sharpe, skew, kurt`` of the gross returns (flat rows count as 0), ``mean_gross`` (weighted), ``action_rate``,
    ``balanced_accuracy`` (mean recall of the meta classes that occur), ``hit_acted``, ``hit_always``, and ``always_gross``, the weighted return of every side taken."""
    act, y = F.col("acted").cast("double"), F.col(meta)
    up, down = F.avg(F.when(y == 1, act)), F.avg(F.when(y == 0, 1 - act))
    skill = bets.groupBy(*by).agg(
        sdiv(F.sum(F.col("gross") * F.col(weight)), F.sum(weight)).alias("mean_gross"), sdiv(F.sum(F.col("side") * F.col(ret) * F.col(weight)), F.sum(weight)).alias("always_gross"), F.avg(act).alias("action_rate"),
        F.coalesce((up + down) / 2, up, down).alias("balanced_accuracy"), F.avg(F.when(F.col("acted"), y.cast("double"))).alias("hit_acted"), F.avg(y.cast("double")).alias("hit_always"),
    )
    return V.moments(bets, by, "gross").join(skill, by)


def meta_search(meta: DataFrame, folds: DataFrame, paths: DataFrame, features: list[str], penalties: dict[str, float], tau: float = 0.5, parts: int = 6, verdict: SE.Verdict = SE.Verdict()) -> tuple[DataFrame, DataFrame]:
    """``(trials, verdict row)`` of a ``meta_set(row, features, side, meta, ret, w)``: every configuration predicts ``meta`` under ``folds`` (``split, row, role``) and
    gates the side; the one with the best Sharpe ratio of gated returns (ties: the first named; without spread 0) alone goes through ``paths`` (combinatorial splits).

    The deflated ratio and the probability of overfitting count every trial; one trial has no deflated ratio, so its gate fails.
    """
    folder = shared_folder(meta.sparkSession, "meta")
    m = written(meta.select("row", *features, "side", "ret", F.col("meta").cast("double").alias("y"), "w"), folder, "matrix")

    def bets(splits: DataFrame, tried: dict[str, float]) -> DataFrame:
        preds = SE.predict_logistic(m, splits, features, SE.fit_logistic(m, splits, features, tried))
        return gated(preds.join(m.select("row", "side", "ret"), "row").withColumn("meta", F.col("y").cast("int")), tau=tau)

    held_out = written(bets(folds, penalties), folder, "bets")
    stats = written(bet_stats(held_out, ["estimator"]), folder, "trials")  # a row a trial
    ratio = {r["estimator"]: r["sharpe"] or 0.0 for r in stats.collect()}
    name = max((k for k in penalties if k in ratio), key=ratio.get)
    own = stats.where(F.col("estimator") == name).first()
    spread = float(np.var(list(ratio.values()), ddof=1)) if len(ratio) > 1 else 0.0
    dsr = float(S.deflated_sharpe(own["sharpe"], spread, len(ratio), own["n"], own["skew"], own["kurt"])) if spread and own["sharpe"] is not None else None
    pbo = ST.overfitting(held_out.select("estimator", "row", F.col("gross").alias("r")), parts).select("pbo")
    tested = paths.where("role = 'test'").select(F.col("split").cast("int").alias("split"), F.col("row").cast("int").alias("row"), "path")
    by_path = V.moments(bets(paths, {name: penalties[name]}).join(tested, ["split", "row"]), ["path"], "gross")
    median = by_path.agg(F.percentile(F.coalesce("sharpe", F.lit(0.0)), 0.5).alias("path_median_sharpe"), F.count("*").alias("paths"))
    row = stats.where(F.col("estimator") == name).withColumns({"n_trials": F.lit(len(ratio)), "dsr": F.lit(dsr).cast("double")})
    for one in (pbo, median):  # a row each
        row = row.join(F.broadcast(one))
    return stats, SE.judged(row, SE.meta_gates(verdict))


# --- paired arms -----------------------------------------------------------------------------------------------------------------------------


def attribution(verdicts: DataFrame, by: list[str], baseline: str = "baseline", treatment: str = "treatment") -> DataFrame:
    """``by, baseline_passed, treatment_passed, attribution`` of ``verdicts(by, arm, passed)``, by a rule fixed beforehand.

    The treatment alone passes: ``attributable``; both do: ``not_cleanly_attributable``, as its rows alone moved the baseline; the treatment fails: ``null``
    whatever the baseline does. A missing arm or verdict fails; of several verdicts of an arm all must pass.
    """
    passed = lambda arm: F.coalesce(F.bool_and(F.when(F.col("arm") == arm, F.coalesce("passed", F.lit(False)))), F.lit(False))
    d = verdicts.groupBy(*by).agg(passed(baseline).alias("baseline_passed"), passed(treatment).alias("treatment_passed"))
    kind = F.when(~F.col("treatment_passed"), "null").when(F.col("baseline_passed"), "not_cleanly_attributable").otherwise("attributable")
    return d.withColumn("attribution", kind)


def decision(attributed: DataFrame, key: str = "symbol") -> DataFrame:
    """One row ``n, candidates, fragile, overall`` of ``attribution``: the keys whose treatment passes; ``fragile`` if some do and others don't. No keys: no edge."""
    d = attributed.agg(F.count("*").alias("n"), F.coalesce(F.count_if("treatment_passed"), F.lit(0)).alias("candidates"))
    some, every = F.col("candidates") > 0, F.col("candidates") == F.col("n")
    overall = F.when(~some, "no_significant_edge").when(every, "edge_candidate").otherwise("edge_candidate_fragile")
    return d.withColumns({"fragile": some & ~every, "overall": overall})


def paired_arms(baseline: DataFrame, treatment: DataFrame, same: list[str], study: Callable[[DataFrame, str], DataFrame], by: list[str]) -> DataFrame:
    """``attribution`` of ``study(matrix, arm)`` (``by, passed`` a row) run on both arms, which must agree row for row in the columns ``same`` (targets, spans, weights): else ``ValueError``."""
    apart = M.same_rows(baseline, treatment, same).first()
    if apart["only_a"] or apart["only_b"]:
        raise ValueError(f"the arms differ in {apart['only_a']} and {apart['only_b']} rows of {', '.join(same)}: their comparison means nothing")
    verdicts = [study(matrix, arm).select(*by, F.lit(arm).alias("arm"), "passed") for arm, matrix in (("baseline", baseline), ("treatment", treatment))]
    return attribution(verdicts[0].unionByName(verdicts[1]), by)
