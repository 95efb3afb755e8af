"""Recurrences that no finite frame expresses: exponential means and deviations, reset-on-threshold folds, filters.

An exponential mean is affine in the value it starts from, so it runs in blocks of time: each block reports how its end depends on its
start (one row a block), the starts are chained over these rows, and the blocks run again with their starts. No task holds a key's
whole history. The debiased deviation and GARCH have such summaries, too; CUSUM forgets its start at a reset, so a block runs from rest and again only
up to there. Dollar bars run a (key, session) at a time, since sessions cut them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .blocks import affine_scan, chained, month, settled


@dataclass(frozen=True)
class Ewm:
    """``out`` = exponential mean of ``source``, seeded by its first value, null before ``least`` values."""

    out: str
    source: str
    alpha: float
    least: int = 1


def span(n: int) -> float:
    return 2.0 / (n + 1)


def wilder(n: int) -> float:
    return 1.0 / n


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), extra])


def _run(x: pd.Series, alpha: float, start: float | None) -> np.ndarray:
    if start is not None and not np.isnan(start):
        x = pd.concat([pd.Series([start]), x])
        return x.ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]
    return x.ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()


def ewm(df: DataFrame, keys: list[str], ts: str, specs: list[Ewm], block: Column | None = None) -> DataFrame:
    """Adds exponential means. ``block`` (by default the calendar year and month of ``ts``) must rise with ``ts``. Nulls hold the last value."""
    ship(df.sparkSession)
    df = df.withColumn("_block", F.date_format(ts, "yyyyMM").cast("long") if block is None else block)

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        rows = []
        for s in specs:
            x = pdf[s.source].astype(float)
            n = int(x.notna().sum())
            flat = _run(x, s.alpha, 0.0)
            alone = _run(x, s.alpha, None)
            rows.append((s.out, (1 - s.alpha) ** n, float(flat[-1]), float(alone[-1]), n))
        out = pd.DataFrame(rows, columns=["spec", "slope", "shift", "alone", "n"])
        for k in (*keys, "_block"):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in (*keys, "_block"))
    ends = df.groupBy(*keys, "_block").applyInPandas(summary, f"{key_ddl}, spec string, slope double, shift double, alone double, n long")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        y, n, starts, seen = np.nan, 0, [], []
        for slope, shift, alone, m in zip(pdf.slope, pdf["shift"], pdf.alone, pdf.n, strict=True):
            starts.append(y)
            seen.append(n)
            if m:
                y = alone if np.isnan(y) else slope * y + shift
            n += m
        return pdf.assign(start=starts, seen=seen)[[*keys, "_block", "spec", "start", "seen"]]

    starts = ends.groupBy(*keys, "spec").applyInPandas(chain, f"{key_ddl}, spec string, start double, seen long")
    starts = starts.groupBy(*keys, "_block").agg(F.map_from_entries(F.collect_list(F.struct("spec", F.struct("start", "seen")))).alias("_starts"))
    names = [F.col(k).alias(f"_k_{i}") for i, k in enumerate((*keys, "_block"))]
    match = F.lit(True)
    for i, k in enumerate((*keys, "_block")):
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    flat = starts.select(*names, *[F.col("_starts")[s.out]["start"].alias(f"_y_{i}") for i, s in enumerate(specs)], *[F.col("_starts")[s.out]["seen"].alias(f"_n_{i}") for i, s in enumerate(specs)])
    joined = df.join(flat, match).drop(*[f"_k_{i}" for i in range(len(keys) + 1)])
    helpers = [f"_{c}_{i}" for i in range(len(specs)) for c in "yn"]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable").reset_index(drop=True)
        for i, s in enumerate(specs):
            x = pdf[s.source].astype(float)
            start = pdf[f"_y_{i}"].iloc[0]
            y = _run(x, s.alpha, None if start is None else float(start))
            enough = x.notna().cumsum() + int(pdf[f"_n_{i}"].iloc[0]) >= s.least
            pdf[s.out] = np.where(enough, y, np.nan)
            pdf[s.out] = pdf[s.out].astype(object).where(pd.notna(pdf[s.out]), None)
        return pdf.drop(columns=helpers)

    base = df
    done = joined.groupBy(*keys, "_block").applyInPandas(finish, _schema(base, ", ".join(f"`{s.out}` double" for s in specs)))
    return done.drop("_block")


def grouped(df: DataFrame, keys: list[str], order: list[str], extra: str, fold: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """Adds the columns that ``fold`` computes from each key's rows in order."""
    ship(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.assign(**fold(pdf))

    return df.groupBy(*keys).applyInPandas(run, _schema(df, extra))


def _nulls(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, None) if x.dtype.kind == "f" else x


def _ewm_scan(x: np.ndarray, alpha: float, gap: int, mean: float, var: float, square: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Mean, variance, sum of squared weights and share of the start after each row, and the rows since the last value; nan holds. ``gap`` rows lie before."""
    at = np.flatnonzero(np.isfinite(x))
    if not len(at):
        flat = np.ones(len(x))
        return mean * flat, var * flat, square * flat, flat, gap + len(x)
    old = (1 - alpha) ** np.diff(at, prepend=-1 - gap)  # a gap lets the old weight fade
    new = alpha / (old + alpha)
    share, m = affine_scan(1 - new, new * x[at])
    m = share * mean + m
    apart = x[at] - np.append(mean, m[:-1])
    _, v = affine_scan(1 - new, new * (1 - new) * apart**2)
    squares, q = affine_scan((1 - new) ** 2, new**2)
    v, q = share * var + v, squares * square + q
    last = np.searchsorted(at, np.arange(len(x)), "right") - 1
    spread = lambda y, first: np.where(last >= 0, y[np.maximum(last, 0)], first)
    return spread(m, mean), spread(v, var), spread(q, square), spread(share, 1.0), len(x) - 1 - int(at[-1])


def ewm_std(df: DataFrame, keys: list[str], order: list[str], source: str, out: str, n: int, least: int, block: Column | None = None) -> DataFrame:
    """Debiased exponential standard deviation of span n, null before ``least`` values; in blocks (by default calendar months of ``order``).

    A block's state is mean, variance, sum of squared weights and rows since the last value. Started at its first value x, it ends at (m, v, q) with a share
    A of its start; from a start (M, V, Q) it ends at m + A (M - x), v + A V + A (M - x) ((1 - A)(M - x) - 2 (m - x)), q + A^2 (Q - 1): four
    numbers sum it up.
    """
    alpha = span(n)

    def summary(pdf: pd.DataFrame) -> dict:
        x = pdf[source].astype(float).to_numpy()
        at = np.flatnonzero(np.isfinite(x))
        if not len(at):
            return {"rows": len(x), "count": 0, "lead": 0, "x": 0.0, "m": 0.0, "v": 0.0, "q": 0.0, "share": 0.0, "trail": 0}
        m, v, q, share, trail = _ewm_scan(x[at[0] + 1 :], alpha, 0, x[at[0]], 0.0, 1.0)
        end = lambda y, none: float(y[-1]) if len(y) else none
        return {"rows": len(x), "count": len(at), "lead": int(at[0]), "x": x[at[0]], "m": end(m, x[at[0]]), "v": end(v, 0.0), "q": end(q, 1.0), "share": end(share, 1.0), "trail": trail}

    def chain(blocks: list[dict]) -> list[dict]:
        mean, var, square, gap, seen, out_ = 0.0, 0.0, 1.0, 0, 0, []
        for b in blocks:
            out_.append({"_m": mean, "_v": var, "_q": square, "_gap": gap, "_seen": seen})
            if not b["count"]:
                gap += b["rows"] if seen else 0
                continue
            first, first_var, first_square = b["x"], 0.0, 1.0
            if seen:
                old = (1 - alpha) ** (gap + b["lead"] + 1)
                new = alpha / (old + alpha)
                first, first_var, first_square = mean + new * (b["x"] - mean), (1 - new) * (var + new * (b["x"] - mean) ** 2), (1 - new) ** 2 * square + new**2
            a, d = b["share"], first - b["x"]
            mean, square = b["m"] + a * d, b["q"] + a * a * (first_square - 1)
            var = max(0.0, b["v"] + a * first_var + a * d * ((1 - a) * d - 2 * (b["m"] - b["x"])))
            gap, seen = b["trail"], seen + b["count"]
        return out_

    def finish(pdf: pd.DataFrame, start: dict) -> dict[str, np.ndarray]:
        x = pdf[source].astype(float).to_numpy()
        seen = int(start["_seen"]) + np.cumsum(np.isfinite(x))
        lo = 0
        if not start["_seen"]:  # the very first value starts the state
            at = np.flatnonzero(np.isfinite(x))
            lo = int(at[0]) + 1 if len(at) else len(x)
            start = {"_m": x[lo - 1] if len(at) else 0.0, "_v": 0.0, "_q": 1.0, "_gap": 0}
        _, v, q, _, _ = _ewm_scan(x[lo:], alpha, int(start["_gap"]), start["_m"], start["_v"], start["_q"])
        v, q = np.append(np.zeros(lo), v), np.append(np.ones(lo), q)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.sqrt(np.where(1 - q > 0, v / (1 - q), np.nan))
        return {out: _nulls(np.where(seen >= max(least, 1), y, np.nan))}

    ddl = "rows long, count long, lead long, x double, m double, v double, q double, share double, trail long"
    return chained(df, keys, order, month(order[0]) if block is None else block, summary, ddl, chain, "_m double, _v double, _q double, _gap long, _seen long", finish, f"`{out}` double")


def _cusum_step(up: float, down: float, r: float, h: float) -> tuple[float, float, bool]:
    up, down = max(0.0, up + r), min(0.0, down + r)
    if up >= h:
        return 0.0, down, True
    if down <= -h:
        return up, 0.0, True
    return up, down, False


def cusum_run(ret: np.ndarray, threshold: np.ndarray, up: float = 0.0, down: float = 0.0) -> tuple[np.ndarray, float, float]:
    """Symmetric CUSUM filter from given sums: where a side passes the threshold, and the sums at the end. A non-finite return or a threshold that is
    not positive resets both; a side that fires resets itself alone, the positive one first."""
    fired, usable = np.zeros(len(ret), bool), np.isfinite(ret) & np.isfinite(threshold) & (threshold > 0)
    for i, (r, h, ok) in enumerate(zip(ret.tolist(), threshold.tolist(), usable.tolist(), strict=True)):
        up, down, fired[i] = _cusum_step(up, down, r, h) if ok else (0.0, 0.0, False)
    return fired, up, down


def cusum(ret: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    return cusum_run(ret, threshold)[0]


def cusum_end(ret: np.ndarray, threshold: np.ndarray, start: tuple[float, ...], calm: tuple[float, ...]) -> tuple[float, ...]:
    """The sums at the end from ``start``, given those from rest (``calm``): both runs go side by side until they coincide."""
    a, z = (float(start[0]), float(start[1])), (0.0, 0.0)
    usable = np.isfinite(ret) & np.isfinite(threshold) & (threshold > 0)
    for r, h, ok in zip(ret.tolist(), threshold.tolist(), usable.tolist(), strict=True):
        if a == z or not ok:
            return calm
        a, z = _cusum_step(*a, r, h)[:2], _cusum_step(*z, r, h)[:2]
    return calm if a == z else a


def cusum_events(df: DataFrame, keys: list[str], order: list[str], ret: str, threshold: str, block: Column | None = None) -> DataFrame:
    """Adds ``fired``; in blocks (by default calendar months of ``order``), each run once from rest and again only from where its predecessor ends, up to a reset."""
    arrays = lambda p: (p[ret].astype(float).to_numpy(), p[threshold].astype(float).to_numpy())
    return settled(
        df, keys, order, month(order[0]) if block is None else block, lambda p: cusum_run(*arrays(p))[1:], lambda p, start, calm: cusum_end(*arrays(p), start, calm),
        lambda p, start: {"fired": cusum_run(*arrays(p), *start)[0]}, "fired boolean", [ret, threshold], 2,
    )


def dollar_bar_ids(notional: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Bar number of each trade and whether its bar is complete: a bar closes with the trade that takes its notional to the threshold."""
    ids, total, k = np.zeros(len(notional), np.int64), 0.0, 0
    for i, x in enumerate(notional):
        ids[i] = k
        total += x
        if total >= threshold:
            total, k = 0.0, k + 1
    return ids, ids < k


def dollar_bars(trades: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Dollar bars of trades (ts, price, size) within ``keys`` (contract and session: seams close bars); the trailing partial is kept."""

    def fold(p: pd.DataFrame) -> dict[str, np.ndarray]:
        ids, whole = dollar_bar_ids((p.price * p["size"]).to_numpy(float), threshold)
        return {"bar_id": ids, "bar_complete": whole}

    numbered = grouped(trades.select(*keys, "event_id", "ts", "price", "size"), keys, ["ts", "event_id"], "bar_id long, bar_complete boolean", fold)
    return numbered.groupBy(*keys, "bar_id", "bar_complete").agg(
        F.min("ts").alias("ts_open"), F.max("ts").alias("ts_close"), F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.sum("size").cast("double").alias("volume"), (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"), F.count("*").alias("n"),
    )


def risk_metrics(df: DataFrame, keys: list[str], ts: str, variance: str, out: str, decay: float = 0.94) -> DataFrame:
    """RiskMetrics variance: exponential mean with decay 0.94, seeded by the first value."""
    return ewm(df, keys, ts, [Ewm(out, variance, 1 - decay)])


def garch_variance(e2: np.ndarray, omega: float, alpha: float, beta: float, start: float | None = None) -> np.ndarray:
    """One-step GARCH(1,1) variances from squared residuals, started at their mean: affine in what went before, so one scan."""
    a, b = affine_scan(np.full(len(e2), beta), omega + alpha * e2)
    return a * ((float(np.mean(e2)) if len(e2) else 0.0) if start is None else start) + b


def garch(df: DataFrame, keys: list[str], order: list[str], e2: str, omega: float, alpha: float, beta: float, block: Column | None = None) -> DataFrame:
    """Adds ``garch_var`` with fixed parameters, in blocks (by default calendar months of ``order``): a block is an affine map of two numbers."""
    mean = df.groupBy(*keys).agg(F.avg(F.col(e2).cast("double")).alias("_mean"))
    match = [F.col(f"_g_{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    df = df.join(mean.select(*[F.col(k).alias(f"_g_{i}") for i, k in enumerate(keys)], "_mean"), match).drop(*[f"_g_{i}" for i in range(len(keys))])

    def summary(pdf: pd.DataFrame) -> dict:
        a, b = affine_scan(np.full(len(pdf), beta), omega + alpha * pdf[e2].astype(float).to_numpy())
        return {"a": a[-1], "b": b[-1], "mean": float(pdf["_mean"].iloc[0])}

    def chain(blocks: list[dict]) -> list[dict]:
        y, out = blocks[0]["mean"], []
        for b in blocks:
            out.append({"_y": y})
            y = b["a"] * y + b["b"]
        return out

    finish = lambda p, start: {"garch_var": _nulls(garch_variance(p[e2].astype(float).to_numpy(), omega, alpha, beta, start["_y"]))}
    return chained(df, keys, order, month(order[0]) if block is None else block, summary, "a double, b double, mean double", chain, "_y double", finish, "garch_var double", once=("_mean",))


@dataclass(frozen=True)
class Garch:
    omega: float
    alpha: float
    beta: float
    mean: float  # of the returns
    var: float  # of the returns; seeds the recursion
    converged: bool


def _filtered(e2: np.ndarray, omega: float, alpha: float, beta: float, start: float) -> np.ndarray:
    """Variances of each day as known the day before, the first at ``start``."""
    return np.append(start, garch_variance(e2[:-1], omega, alpha, beta, start)) if len(e2) else np.zeros(0)


def fit_garch(returns: np.ndarray, steps: int = 200, least: int = 50, cap: float = 0.9999) -> Garch:
    """Gaussian quasi-maximum likelihood by Fisher scoring: the gradient of the variances obeys the recursion of the variances, so it is a scan, too.

    Bounds: omega > 0, alpha in [0, 0.5], beta in [0, 0.9995], alpha + beta < ``cap``. Fewer than ``least`` returns, or none that vary, take RiskMetrics' weights.
    """
    r = returns[np.isfinite(returns)]
    mean = float(r.mean()) if len(r) else 0.0
    var = float(np.mean((r - mean) ** 2)) if len(r) else 1.0
    if len(r) < least or var <= 0:
        return Garch(0.0, 0.06, 0.94, mean, max(var, 1e-12), False)
    e2 = (r - mean) ** 2 / var  # in units of the variance

    def loss(p: np.ndarray) -> float:
        s = _filtered(e2, *p, 1.0)
        return float(np.sum(np.log(s) + e2 / s)) / 2 if (s > 0).all() else np.inf

    def inside(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, (1e-9, 0.0, 0.0), (10.0, 0.5, 0.9995))
        over = p[1] + p[2] - (cap - 2e-6)
        return p if over <= 0 else p - np.array([0.0, 0.0, over])

    p, done = np.array([0.05, 0.05, 0.90]), False
    now = loss(p)
    for _ in range(steps):
        s = _filtered(e2, *p, 1.0)
        drive = np.stack([np.ones(len(s) - 1), e2[:-1], s[:-1]])
        slope = np.zeros((3, len(s)))
        for i in range(3):
            slope[i, 1:] = affine_scan(np.full(len(s) - 1, p[2]), drive[i])[1]
        gradient = ((1 - e2 / s) / s * slope).sum(axis=1) / 2
        held = ((p <= (1e-9, 0.0, 0.0)) & (gradient > 0)) | ((p >= (10.0, 0.5, 0.9995)) & (gradient < 0))
        free = ~held
        information = (slope[free] / s) @ (slope[free] / s).T / 2
        step = np.zeros(3)
        step[free] = np.linalg.solve(information + 1e-9 * np.trace(information) * np.eye(free.sum()), gradient[free]) if free.any() else 0
        size, moved = 1.0, False
        while size > 1e-8:
            new = inside(p - size * step)
            if (value := loss(new)) < now:
                moved = now - value > 1e-10 * abs(now)
                p, now = new, value
                break
            size /= 2
        if not moved:
            done = True
            break
    return Garch(float(p[0]) * var, float(p[1]), float(p[2]), mean, var, done and p[1] + p[2] < cap - 1e-6)


def garch_forecast(returns: np.ndarray, g: Garch) -> np.ndarray:
    """Log variance of the day after each, from parameters that stay as they are; a missing return adds nothing."""
    e2 = np.where(np.isfinite(returns), returns - g.mean, 0.0) ** 2
    return np.log(np.maximum(garch_variance(e2, g.omega, g.alpha, g.beta, g.var), 1e-300))


def garch_arm(df: DataFrame, keys: list[str], order: str, ret: str, fold: str = "fold") -> DataFrame:
    """``keys, order, fold, f_garch, converged``: log variances forecast by parameters fitted, for each fold, on the returns before it.

    ``fold`` counts up with ``order``; rows before the first fold have a negative one and are not forecast. A (key, fold) is a task of its own, holding
    the key's rows up to the fold's end. A fit that does not converge is replaced by RiskMetrics' weights of the same returns.
    """
    ship(df.sparkSession)
    last = df.groupBy(*keys).agg(F.max(fold).alias("_last"))
    each = F.explode(F.sequence(F.greatest(F.col(fold), F.lit(0)), F.col("_last"))).alias("_for")
    rows = df.join(last.where("_last >= 0"), keys).select(*keys, order, F.col(ret).cast("double").alias("_ret"), F.col(fold).cast("int").alias("_fold"), each)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        k, r, own = int(pdf["_for"].iloc[0]), pdf["_ret"].to_numpy(float), pdf["_fold"].to_numpy()
        g = fit_garch(r[own < k])
        used = g if g.converged else Garch(0.0, 0.06, 0.94, g.mean, g.var, False)
        at = np.flatnonzero(own == k)
        return pdf.loc[at, [*keys, order]].assign(**{fold: k, "f_garch": garch_forecast(r, used)[at], "converged": g.converged})

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keys, order))
    return rows.groupBy(*keys, "_for").applyInPandas(run, f"{fields}, `{fold}` int, f_garch double, converged boolean")
