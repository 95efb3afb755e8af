"""Studies: training matrices, volatility bases, forecast arms, gate batteries and economic value, each a table of one row a symbol or fold."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statistics as S
from ..functions.exprs import clean, corr, local, pos_ln, sdiv
from ..plans.shipping import ship
from . import labels as L
from . import modeling as M
from . import quality as Q
from . import resampling as RS
from . import volatility as V
from .asof import asof_attach, asof_join


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# --- matrices --------------------------------------------------------------------------------------------------------------------------------


def training_matrix(labels: DataFrame, features: DataFrame, columns: list[str], extra: DataFrame | None = None, extra_columns: tuple[str, ...] = (), by: tuple[str, ...] = ("symbol",), timeouts: str = "sign_return") -> DataFrame:
    """Labels with the features known at their start, rows gated to finite features, and the directional target.

    A label is one a (``by``, t0); labels are few, so the lookup moves times and fetches the rows found (``asof_attach``). ``extra`` columns (another
    feature family) are attached after the gate: infinities become null and no row goes.
    """
    keep = [*by, "t0", "t1", "label", "ret", "weight", "avg_uniqueness"]
    j = asof_attach(labels.select(*keep), features, [*by, "t0"], "t0", "ts", list(by), columns, bucket_us=7 * 86_400_000_000)
    m = Q.finite_rows(j, ["label", "ret", "t0", "t1"], columns)
    if extra is not None:
        m = asof_attach(m, extra, [*by, "t0"], "t0", "ts", list(by), list(extra_columns), bucket_us=7 * 86_400_000_000)
        m = m.withColumns({c: clean(c) for c in extra_columns})
    return L.direction(m, timeouts)


def micro_matrix(labels: DataFrame, bars: DataFrame, columns: list[str], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Micro labels with the last bar's features: rows with an infinite feature or no bar at all go, missing single features stay (``staged_rows`` counts them)."""
    j = asof_join(labels, bars.select(*by, "ts", *columns), on="t0", right_on="ts", by=list(by), take=columns, prefix="")
    value = [F.col(c).cast("double") for c in columns]
    infinite = reduce(lambda a, b: a | b, [F.coalesce(F.abs(v) == float("inf"), F.lit(False)) for v in value])
    return j.dropna(subset=["label", "ret", "t0", "t1"]).where(~infinite & ~both([F.col(c).isNull() for c in columns]))


def volatility_base(rv: DataFrame, features: DataFrame | None = None, columns: tuple[str, ...] = (), horizon: int = 1, lags: tuple[int, ...] = (1, 5, 22), blocks: tuple[DataFrame, ...] = (), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A row a session: HAR predictors, features as of its close (null if from another session), the forward target and the span [t0, t1].

    ``rv(keys, session_date, t_close, rv)``; ``features(keys, ts, columns)``; ``blocks`` are tables by (keys, session_date) joined to the left. Rows without predictors
    or target go; missing features stay. ``t1`` is the close ``horizon`` sessions on, the last close for the last rows.
    """
    k = list(keys)
    base = V.forward_log_variance(V.har_predictors(rv, k, "session_date", lags=lags), k, "session_date", horizon)
    if features is not None:
        base = asof_join(base, features.select(*k, "ts", *columns), on="t_close", right_on="ts", by=k, take=["ts", *columns], prefix="_f_", bucket_us=7 * 86_400_000_000)
        fresh = F.to_date(local("_f_ts")) == F.col("session_date")
        base = base.withColumns({c: F.when(fresh, F.col(f"_f_{c}")) for c in columns}).drop("_f_ts", *[f"_f_{c}" for c in columns])
    for b in blocks:
        base = base.join(b, [*k, "session_date"], "left")
    w = Window.partitionBy(*k).orderBy("session_date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = base.withColumns({"t0": F.col("t_close"), "t1": F.coalesce(F.lead("t_close", horizon).over(w), F.last("t_close").over(whole))})
    return base.where(both([F.col(c).isNotNull() for c in (*(f"har_{n}" for n in lags), f"fwd_{horizon}")]))


# --- estimators beyond modeling's ----------------------------------------------------------------------------------------------------------------


def qlike_linear(steps: int = 50, ridge: float = 1e-6) -> M.Estimator:
    """A linear model of the log variance that minimises QLIKE itself, by damped Newton steps (the loss is convex in the coefficients)."""

    def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, test: np.ndarray) -> np.ndarray:
        a = np.hstack([np.ones((len(x), 1)), x])
        b = np.linalg.lstsq(a, y, rcond=None)[0]

        def loss(b: np.ndarray) -> float:
            d = np.clip(y - a @ b, -30, 30)
            return float((w * (np.exp(d) - d - 1)).sum())

        for _ in range(steps):
            e = np.exp(np.clip(y - a @ b, -30, 30))
            gradient, hessian = a.T @ (w * (1 - e)), (a * (w * e)[:, None]).T @ a + ridge * np.eye(a.shape[1])
            step, size, now = np.linalg.solve(hessian, gradient), 1.0, loss(b)
            while size > 1e-6 and loss(b - size * step) > now:
                size /= 2
            b = b - size * step
            if np.abs(size * step).max() < 1e-10:
                break
        return np.hstack([np.ones((len(test), 1)), test]) @ b

    return fit


def permutation_importance(matrix: DataFrame, splits: DataFrame, features: list[str], estimator: M.Estimator, seed: int = 7) -> DataFrame:
    """``split, feature, drop``: how much held-out accuracy falls when a feature's test values are shuffled."""
    ship(matrix.sparkSession)
    joined = splits.select("split", "row", "role").join(matrix.select("row", *features, "y", "w"), "row")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["role", "row"])
        train, test = pdf[pdf.role == "train"], pdf[pdf.role == "test"]
        x, y, w = train[features].to_numpy(float), train.y.to_numpy(float), train.w.to_numpy(float)
        held, truth, mass = test[features].to_numpy(float), np.sign(test.y.to_numpy(float)), test.w.to_numpy(float)
        score = lambda z: float((mass * (np.sign(estimator(x, y, w, z)) == truth)).sum() / max(mass.sum(), 1e-12))
        base, rng, out = score(held), np.random.default_rng(seed), []
        for i in range(len(features)):
            other = held.copy()
            other[:, i] = rng.permutation(other[:, i])
            out.append(base - score(other))
        return pd.DataFrame({"split": int(pdf.split.iloc[0]), "feature": features, "drop": out})

    return joined.groupBy("split").applyInPandas(run, "split int, feature string, drop double")


def evaluate(matrix: DataFrame, splits: DataFrame, features: list[str], estimators: dict[str, M.Estimator], ret: str = "ret") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One harness over combinatorial splits (``split, row, role, path``): pooled scores, scores by path, and the signed returns by (row, estimator)
    from which ``overfitting`` is found. The estimators are fitted once.
    """
    fits = M.fit_splits(matrix, splits, features, estimators)
    paths = fits.join(splits.where("role = 'test'").select("split", "row", "path"), ["split", "row"])
    pooled = M.accuracy(paths, ["estimator"])
    by_path = M.accuracy(paths, ["estimator", "path"])
    signed = paths.join(matrix.select("row", F.col(ret).alias("_r")), "row").groupBy("estimator", "row").agg(F.avg(F.signum("pred") * F.col("_r")).alias("r"))
    return pooled, by_path, signed


def overfitting(returns: DataFrame, parts: int = 10, config: str = "estimator", order: str = "row") -> DataFrame:
    """``pbo, n_splits``: probability of backtest overfitting of (period x configuration) returns.

    Spark reduces the periods to count, sum and square of each of ``parts`` contiguous parts; the C(parts, parts / 2) splits run over that small table.
    """
    from .cv import folds
    from .windows import positions

    periods = returns.select(F.col(order).alias("_o")).distinct()
    numbered = folds(positions(periods, [], ["_o"], F.lit(0) if dict(returns.dtypes)[order] not in ("date", "timestamp") else F.to_date("_o")).withColumnRenamed("pos", "row"), parts)
    cells = returns.join(numbered.select(F.col("_o").alias(order), F.col("fold").alias("_part")), order).groupBy("_part", config).agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    rows = cells.collect()  # parts x configurations
    names = sorted({r[config] for r in rows})
    found = S.pbo_from_sums({(r["_part"], r[config]): (r["n"], r["s"], r["q"]) for r in rows}, names, parts) if len(names) > 1 else (None, 0)
    return returns.sparkSession.createDataFrame([(found[0], found[1])], "pbo double, n_splits int")


# --- forecast arms and gate batteries --------------------------------------------------------------------------------------------------------------


def losses(forecasts: DataFrame, arms: list[str], target: str, keys: list[str]) -> DataFrame:
    """``keys, arm, loss``: QLIKE of every arm's log forecast, only rows that all arms forecast."""
    rows = forecasts.where(both([F.col(c).isNotNull() for c in (target, *arms)]))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), V.qlike(target, a).alias("loss")) for a in arms])).alias("x")
    return rows.select(*keys, cells).select(*keys, "x.*")


def battery(loss: DataFrame, arm: str, against: list[str], keys: list[str], fold: str = "fold", regime: str = "regime", min_folds: int = 1) -> DataFrame:
    """Gates of one arm against others: lower mean loss than each, no worse in any regime than the first, better in enough folds; one row a key.

    A regime that does not occur fails its gate, as does a missing loss.
    """
    pick = lambda a: F.avg(F.when(F.col("arm") == a, F.col("loss")))
    means = loss.groupBy(*keys).agg(*[pick(a).alias(f"loss_{a}") for a in (arm, *against)], (F.count_if(F.col("arm") == arm)).alias("n"))
    regimes = loss.groupBy(*keys, regime).agg((pick(arm) <= pick(against[0])).alias("ok")).where(F.col(regime).isNotNull())
    regimes = regimes.groupBy(*keys).agg((F.min(F.col("ok").cast("int")) == 1).alias("every"), F.count("*").alias("found"))
    folds_ = loss.groupBy(*keys, fold).agg((pick(arm) < pick(against[0])).alias("ok")).groupBy(*keys).agg(F.sum(F.col("ok").cast("long")).alias("folds_won"), F.count("*").alias("folds"))
    j = means.join(regimes, keys, "left").join(folds_, keys, "left")
    found = {"gate_accuracy": both([F.coalesce(F.col(f"loss_{arm}") < F.col(f"loss_{a}"), F.lit(False)) for a in against]), "gate_regimes": F.coalesce(F.col("every") & (F.col("found") >= 2), F.lit(False)), "gate_folds": F.coalesce(F.col("folds_won") >= min_folds, F.lit(False))}
    return j.withColumns(found).withColumn("passed", both([F.col(g) for g in found])).drop("every", "found")


def incremental(base: DataFrame, augmented: DataFrame, coverage: DataFrame, keys: list[str], row: str, min_coverage: float = 0.5, min_folds: int = 1) -> DataFrame:
    """``keys, status, ..., passed``: does a block of features lower the loss of the same rows? Too little coverage defers the verdict.

    ``base`` and ``augmented(keys, row, fold, regime, loss)`` must hold the same rows; one unpaired row is an error.
    """
    a, b = (d.select(*keys, row, "fold", "regime", F.lit(n).alias("arm"), "loss") for d, n in ((augmented, "augmented"), (base, "base")))
    pairs = a.unionByName(b).groupBy(*keys, row).agg(F.count_distinct("arm").alias("arms"))
    unpaired = pairs.groupBy(*keys).agg(F.count_if(F.col("arms") < 2).alias("unpaired"))
    gates = battery(a.unionByName(b), "augmented", ["base"], keys, min_folds=min_folds).join(unpaired, keys).join(coverage, keys)
    gates = gates.withColumn("unpaired", F.when(F.col("unpaired") > 0, F.raise_error("rows of the two arms differ")).otherwise(F.col("unpaired"))).drop("unpaired")
    enough = F.col("coverage") >= min_coverage
    return gates.withColumns({"status": F.when(enough, "run").otherwise("deferred_coverage"), "passed": enough & F.col("passed")})


def across_symbols(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict a block over its symbols: all pass, some, none, or all deferred."""
    g = verdicts.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("long")).alias("passes"), F.count_if(F.col("status") == "deferred_coverage").alias("deferred"))
    verdict = F.when(F.col("deferred") == F.col("n"), "deferred_coverage").when(F.col("passes") == F.col("n"), "adds_incremental_value").when(F.col("passes") > 0, "fragile_single_symbol").otherwise("no_incremental_value")
    return g.select(*keys, "n", "passes", verdict.alias("verdict"))


# --- economic value ----------------------------------------------------------------------------------------------------------------------------


def exposures(panel: DataFrame, arms: list[str], keys: list[str], fold: str = "fold", gamma: float = 5.0, cap: float = 1.5, floor: float = 0.1, target: float = 0.10, days: int = 252) -> DataFrame:
    """Weights of every arm from its daily variance ``s2_<arm>``: ``mv_`` mean-variance (from the fold's causal mean ``mu``), matched to the mean exposure
    of the first arm over earlier folds (``mvm_``), and ``vt_`` volatility-target."""
    clip = lambda x, lo: F.greatest(F.lit(lo), F.least(F.lit(cap), x))
    d = panel.withColumns({f"mv_{a}": clip(sdiv("mu", gamma * F.col(f"s2_{a}")), 0.0) for a in arms} | {f"vt_{a}": clip(sdiv(F.lit(target / days**0.5), F.sqrt(f"s2_{a}")), floor) for a in arms})
    sums = d.groupBy(*keys, fold).agg(*[F.sum(f"mv_{a}").alias(f"_s_{a}") for a in arms])
    before = Window.partitionBy(*keys).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    past = lambda a: F.sum(f"_s_{a}").over(before)
    match = sums.select(*keys, fold, *[F.coalesce(F.when(past(a) > 0, past(arms[0]) / past(a)), F.lit(1.0)).alias(f"_c_{a}") for a in arms])
    d = d.join(match, [*keys, fold])
    return d.withColumns({f"mvm_{a}": clip(F.col(f"_c_{a}") * F.col(f"mv_{a}"), 0.0) for a in arms}).drop(*[f"_c_{a}" for a in arms])


def held_return(weight: str, ret: str, side_cost: float, stress: float) -> Column:
    """A day's return of a held weight less the whole round trip's cost at a stress multiple."""
    return F.col(weight) * F.col(ret) - 2 * side_cost * stress * F.col(weight)


def utility(net: Column, gamma: float) -> Column:
    return (1 + net) - F.lit(gamma / (2 * (1 + gamma))) * (1 + net) * (1 + net)


def fee_bps(treat: Column, other: Column, gamma: float, days: int = 252) -> Column:
    """An aggregate: the yearly fee in basis points a quadratic-utility investor pays to hold ``treat`` rather than ``other``, the root of least size; null without one."""
    a = gamma / (1 + gamma)
    n, first = F.count(treat).cast("double"), F.sum(1 + treat)
    qa, qb, qc = 0.5 * a * n, n - a * first, F.sum(utility(other, gamma)) - F.sum(utility(treat, gamma))
    disc = qb * qb - 4 * qa * qc
    roots = [(-qb + s * F.sqrt(disc)) / (2 * qa) for s in (1, -1)]
    return F.when((n > 0) & (disc >= 0), F.when(F.abs(roots[0]) <= F.abs(roots[1]), roots[0]).otherwise(roots[1]) * days * 1e4)


def target_error(weight: str, ret: str, target: float = 0.10, days: int = 252) -> Column:
    """An aggregate: |log of realised over target volatility| of the weighted return."""
    return F.abs(pos_ln(F.stddev_samp(F.col(weight) * F.col(ret)) / (target / days**0.5)))


def economic_gates(panel: DataFrame, arms: list[str], treat: str, keys: list[str], ret: str = "r_next", fold: str = "fold", regime: str = "regime", gamma: float = 5.0, side_cost: float = 1e-5, stress: float = 3.0, floor_bps: float = 0.0, min_folds: int = 1, max_deviation: float = 0.1, min_net_share: float = 0.5, max_corr: float = 0.3, significant: DataFrame | None = None) -> DataFrame:
    """Gates of a treatment against a static arm (the first of ``arms``) and benchmarks (the others), a row a key.

    Volatility-target error below each and in enough folds; a positive fee against each at plain and stressed cost (and ``significant(keys, ok)``, where
    tests are given), in both regimes, in enough folds; exposure near the static one, costs no more than a share of the gross fee; and no active
    weight that follows the next return. A missing figure fails its gate.
    """
    static, rest = arms[0], [a for a in arms if a != treat]
    net = lambda a, s: held_return(f"mvm_{a}", ret, side_cost, s)
    g = panel.groupBy(*keys).agg(
        *[target_error(f"vt_{a}", ret).alias(f"vte_{a}") for a in arms], *[fee_bps(net(treat, s), net(a, s), gamma).alias(f"fee_{a}_{n}") for a in rest for s, n in ((1.0, "plain"), (stress, "stressed"))],
        fee_bps(net(treat, 0.0), net(static, 0.0), gamma).alias("fee_gross"), F.avg(f"mvm_{treat}").alias("w_treat"), F.avg(f"mvm_{static}").alias("w_static"), *[F.coalesce(corr(F.col(f"mvm_{treat}") - F.col(f"mvm_{a}"), ret), F.lit(0.0)).alias(f"corr_{a}") for a in rest],
    )
    r = panel.where(F.col(regime).isNotNull()).groupBy(*keys, regime).agg(fee_bps(net(treat, 1.0), net(static, 1.0), gamma).alias("fee")).groupBy(*keys).agg(F.min(F.coalesce("fee", F.lit(float("-inf")))).alias("worst"), F.count("*").alias("regimes"))
    better = lambda a: F.avg(utility(net(treat, 1.0), gamma)) > F.avg(utility(net(a, 1.0), gamma))
    f = panel.groupBy(*keys, fold).agg(F.coalesce(target_error(f"vt_{treat}", ret) < target_error(f"vt_{static}", ret), F.lit(False)).alias("vte"), *[F.coalesce(better(a), F.lit(False)).alias(f"u_{a}") for a in rest])
    f = f.groupBy(*keys).agg(F.sum(F.col("vte").cast("long")).alias("vte_folds"), *[F.sum(F.col(f"u_{a}").cast("long")).alias(f"value_folds_{a}") for a in rest])
    j = g.join(r, keys, "left").join(f, keys)
    if significant is not None:
        j = j.join(significant.select(*keys, F.col("ok").alias("_sure")), keys, "left")
    sure = F.coalesce("_sure", F.lit(False)) if significant is not None else F.lit(True)
    ok = lambda c: F.coalesce(c, F.lit(False))
    gates = {
        "g1_target_error": both([ok(F.col(f"vte_{treat}") < F.col(f"vte_{a}")) for a in rest]), "g2_target_error_folds": F.col("vte_folds") >= min_folds, "g3_value_static": ok(F.col(f"fee_{static}_plain") > floor_bps) & sure,
        "g4_value_benchmarks": both([ok(F.col(f"fee_{a}_plain") > 0) for a in rest[1:]]) & sure, "g5_stressed": both([ok(F.col(f"fee_{a}_stressed") > 0) for a in rest]), "g6_regimes": ok((F.col("worst") >= 0) & (F.col("regimes") >= 2)),
        "g7_value_folds": both([F.col(f"value_folds_{a}") >= min_folds for a in rest]), "g8_neutral": ok((F.abs(F.col("w_treat") - F.col("w_static")) <= max_deviation * F.col("w_static")) & (sdiv(f"fee_{static}_stressed", F.when(F.col("fee_gross") > 0, F.col("fee_gross"))) >= min_net_share)),
        "e9_not_directional": both([F.abs(F.col(f"corr_{a}")) < max_corr for a in rest]),
    }
    j = j.withColumns(gates)
    return j.withColumn("passed", both([F.col(k) for k in gates])).drop("worst", "regimes", "_sure")


def bootstrap_significance(panel: DataFrame, treat: str, other: str, keys: list[str], order: str, ret: str = "r_next", gamma: float = 5.0, side_cost: float = 1e-5, alpha: float = 0.05, resamples: int = 2000, block: float = 10.0, seed: int = 7) -> DataFrame:
    """``keys, p, ok``: stationary-bootstrap test of the treatment's utility gain by key."""
    diff = utility(held_return(f"mvm_{treat}", ret, side_cost, 1.0), gamma) - utility(held_return(f"mvm_{other}", ret, side_cost, 1.0), gamma)
    found = RS.stationary_bootstrap(RS.placed(panel, keys, order, diff), keys, resamples, block, seed)
    return found.select(*keys, "p", (F.col("p") < alpha).alias("ok"))


def guard(df: DataFrame, columns: list[str], expected: str) -> DataFrame:
    """``df`` if its fingerprint (``n:hash_sum``) is the expected one; an error otherwise, so a frozen study is never scored on other rows."""
    f = M.fingerprint(df, columns).first()
    if f"{f['n']}:{f['hash_sum']}" != expected:
        raise ValueError(f"the frame has changed: {f['n']}:{f['hash_sum']} is not {expected}")
    return df
