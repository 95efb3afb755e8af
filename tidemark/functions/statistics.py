"""Closed-form statistics on small collected results: overfitting, forecast comparison, economic value."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np

_N = NormalDist()
EULER = float(np.euler_gamma)


def psr(sr: float, benchmark: float, n: int, skew: float = 0.0, kurt: float = 3.0) -> float:
    """Probability that the true Sharpe ratio beats the benchmark; NaN where the variance term is not positive."""
    v = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return _N.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(v)) if n > 1 and v > 0 else math.nan


def min_track_record(sr: float, benchmark: float = 0.0, skew: float = 0.0, kurt: float = 3.0, prob: float = 0.95) -> float:
    if sr <= benchmark:
        return math.inf
    return 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * (_N.inv_cdf(prob) / (sr - benchmark)) ** 2


def expected_max_sharpe(variance: float, trials: int) -> float:
    if trials <= 1:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * _N.inv_cdf(1 - 1 / trials) + EULER * _N.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: float, trial_variance: float, trials: int, n: int, skew: float = 0.0, kurt: float = 3.0) -> float:
    return psr(sr, expected_max_sharpe(trial_variance, trials), n, skew, kurt)


def average_ranks(x) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    x = np.asarray(x, float)
    below = (x[None, :] < x[:, None]).sum(axis=1)
    return below + ((x[None, :] == x[:, None]).sum(axis=1) + 1) / 2


def pbo(performance: np.ndarray, parts: int = 10) -> dict:
    """Probability of backtest overfitting by combinatorially symmetric CV of (periods x configurations) returns."""
    blocks = np.array_split(np.asarray(performance, float), parts)
    logits = []
    for chosen in itertools.combinations(range(parts), parts // 2):
        inside = np.concatenate([blocks[i] for i in chosen])
        outside = np.concatenate([blocks[i] for i in range(parts) if i not in chosen])

        def sharpe(m: np.ndarray) -> np.ndarray:
            s = m.std(axis=0, ddof=1)
            return np.where(s > 0, m.mean(axis=0) / np.where(s > 0, s, 1), 0.0)

        best = int(np.argmax(sharpe(inside)))
        w = average_ranks(sharpe(outside))[best] / (performance.shape[1] + 1)
        logits.append(math.log(w / (1 - w)))
    return {"pbo": float(np.mean(np.array(logits) <= 0)), "n_splits": len(logits), "logits": logits}


def pbo_from_sums(cells: dict, names: list, parts: int) -> tuple[float, int]:
    """``pbo`` from (part, configuration) -> (count, sum, sum of squares); also the number of splits."""

    def sharpe(chosen: tuple[int, ...]) -> np.ndarray:
        n, s, q = np.array([[cells.get((i, c), (0, 0.0, 0.0)) for c in names] for i in chosen], float).sum(axis=0).T
        mean = s / np.maximum(n, 1)
        var = (q - n * mean * mean) / np.maximum(n - 1, 1)
        return np.where(var > 1e-18, mean / np.sqrt(np.maximum(var, 1e-300)), 0.0)

    logits = []
    for chosen in itertools.combinations(range(parts), parts // 2):
        best = int(np.argmax(sharpe(chosen)))
        w = average_ranks(sharpe(tuple(i for i in range(parts) if i not in chosen)))[best] / (len(names) + 1)
        logits.append(math.log(w / (1 - w)))
    return float(np.mean(np.array(logits) <= 0)), len(logits)


def student_t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    tail = 0.5 * _beta(df / 2, 0.5, x)
    return tail if t >= 0 else 1 - tail


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    # modified Lentz evaluation of 1 / (1 + n1 / (1 + n2 / ...)), the fraction of the incomplete beta function
    f, c, d = 1.0, 1.0, 0.0
    for i in range(1, 500):
        m = i // 2
        n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d)
        c = 1 + n / c
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front / f


def newey_west(x: np.ndarray, lag: int) -> float:
    """Long-run variance with Bartlett weights."""
    x = np.asarray(x, float) - np.mean(x)
    n = len(x)
    out = float(x @ x) / n
    for k in range(1, min(lag, n - 1) + 1):
        out += 2 * (1 - k / (lag + 1)) * float(x[k:] @ x[:-k]) / n
    return out


def diebold_mariano(loss_a: np.ndarray, loss_b: np.ndarray, horizon: int = 1) -> dict:
    """One-sided test that A loses less than B, with the small-sample correction and Student's t."""
    d = np.asarray(loss_a, float) - np.asarray(loss_b, float)
    n = len(d)
    v = newey_west(d, horizon - 1)
    if n < 2 or v <= 0:
        return {"stat": math.nan, "p": math.nan, "n": n}
    stat = d.mean() / math.sqrt(v / n) * math.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
    return {"stat": float(stat), "p": student_t_sf(-stat, n - 1), "n": n}


def stationary_bootstrap(diff: np.ndarray, resamples: int = 10_000, block: float = 10.0, seed: int = 7) -> dict:
    """p-value of mean(diff) > 0 by resampling wrap-around blocks of geometric length; batched, so memory stays bounded."""
    d = np.asarray(diff, float)
    d = d[np.isfinite(d)]
    n, rng = len(d), np.random.default_rng(seed)
    if n < 2:
        return {"p": math.nan, "n": n}
    centred, beyond = d - d.mean(), 0
    for lo in range(0, resamples, 500):
        m = min(500, resamples - lo)
        fresh = rng.random((m, n)) < 1 / block
        fresh[:, 0] = True
        start = rng.integers(0, n, (m, n))
        at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
        idx = (np.take_along_axis(start, at, 1) + np.arange(n) - at) % n
        beyond += int((centred[idx].mean(axis=1) >= d.mean()).sum())
    return {"p": (beyond + 1) / (resamples + 1), "n": n, "mean": float(d.mean())}


def performance_fee(a: np.ndarray, b: np.ndarray, gamma: float) -> float:
    """The fee a quadratic-utility investor pays a period to hold A rather than B (bisection)."""
    a, b = np.asarray(a, float), np.asarray(b, float)

    def utility(r: np.ndarray) -> float:
        g = 1 + r
        return float(np.mean(g - gamma / (2 * (1 + gamma)) * g * g))

    target, lo, hi = utility(b), -1.0, 1.0
    for _ in range(200):
        fee = (lo + hi) / 2
        lo, hi = (fee, hi) if utility(a - fee) > target else (lo, fee)
    return (lo + hi) / 2


def embargo_rows(pct: float, n: int) -> int:
    return math.ceil(pct * n)
