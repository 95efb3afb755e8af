"""Recurrences in blocks against whole-series runs, at any cut."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import recurrences as R

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, **more):
    rows = [(k, T0 + dt.timedelta(hours=i), None if v is None or np.isnan(v) else float(v), *(float(m[i]) for m in more.values())) for k, xs in values.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double" + "".join(f", {c} double" for c in more)).repartition(3)


def cut(hours):
    return F.floor((F.unix_timestamp("ts") - F.lit(int(T0.replace(tzinfo=dt.timezone.utc).timestamp()))) / (3600 * hours))


def test_affine_scan():
    from tidemark.operators.blocks import affine_scan

    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 64, 1001):
        a, b = rng.uniform(-1, 1, n), rng.normal(size=n)
        y, out = 0.7, []
        for p, q in zip(a, b):
            y = p * y + q
            out.append(y)
        A, B = affine_scan(a, b)
        assert np.allclose(A * 0.7 + B, out)


@pytest.mark.parametrize("hours", [1, 3, 50, 10_000])
def test_debiased_deviation_at_any_cut(spark, hours):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, 200) + 1e6  # far from 0: squares of values would cancel
    a[:7] = np.nan
    a[rng.random(200) < 0.2] = np.nan
    a[60:110] = np.nan  # blocks without a value
    b = rng.normal(size=40)
    c = np.full(30, np.nan)
    got = R.ewm_std(series(spark, {"a": a, "b": b, "c": c, None: b}), ["symbol"], ["ts"], "x", "s", 10, 3, cut(hours)).toPandas().sort_values("ts")
    for k, x in (("a", a), ("b", b), ("c", c), (None, b)):
        own = got[got.symbol.isna()] if k is None else got[got.symbol == k]
        wanted = pd.Series(x).ewm(span=10, adjust=False, min_periods=3).std(bias=False).to_numpy()
        assert np.allclose(own["s"].astype(float), wanted, rtol=1e-6, equal_nan=True)


@pytest.mark.parametrize("hours", [1, 10, 10_000])
@pytest.mark.parametrize("kind", ["noise", "no reset"])
def test_cusum_at_any_cut(spark, hours, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 120) if kind == "noise" else np.full(120, 0.01)  # the sum of "no reset" passes every block on the way to one late event
    if kind == "noise":
        x[rng.random(120) < 0.05] = np.nan
    h = np.where(rng.random(120) < 0.03, 0.0, rng.uniform(1, 3, 120)) if kind == "noise" else np.full(120, 1.0)
    got = R.cusum_events(series(spark, {"a": x, "b": x[:50]}, h=h), ["symbol"], ["ts"], "x", "h", cut(hours)).toPandas().sort_values("ts")
    for k, n in (("a", 120), ("b", 50)):
        fired = got[got.symbol == k]["fired"].to_numpy(bool)
        assert fired.tolist() == R.cusum(x[:n], h[:n]).tolist()
        assert kind == "noise" or k == "b" or np.flatnonzero(fired).tolist() in ([99], [100])


@pytest.mark.parametrize("hours", [1, 7, 10_000])
def test_garch_filter_at_any_cut(spark, hours):
    x = np.random.default_rng(3).chisquare(1, 150)
    got = R.garch(series(spark, {"a": x, "b": x[:20]}), ["symbol"], ["ts"], "x", 0.1, 0.1, 0.8, cut(hours)).toPandas().sort_values("ts")
    for k, n in (("a", 150), ("b", 20)):
        s, out = x[:n].mean(), []
        for v in x[:n]:
            s = 0.1 + 0.1 * v + 0.8 * s
            out.append(s)
        assert np.allclose(got[got.symbol == k]["garch_var"], out)


def simulated(n, omega=0.05, alpha=0.1, beta=0.85, seed=4):
    rng = np.random.default_rng(seed)
    s, out = 1.0, []
    for _ in range(n):
        out.append(rng.normal() * np.sqrt(s))
        s = omega + alpha * out[-1] ** 2 + beta * s
    return np.array(out)


def test_garch_fit():
    r = simulated(4000)
    g = R.fit_garch(r)
    assert g.converged and abs(g.alpha - 0.1) < 0.04 and abs(g.beta - 0.85) < 0.06
    e2 = (r - r.mean()) ** 2

    def loss(omega, alpha, beta):
        s, total = g.var, 0.0
        for x in e2:
            total += (np.log(s) + x / s) / 2
            s = omega + alpha * x + beta * s
        return total

    best = loss(g.omega, g.alpha, g.beta)
    rng = np.random.default_rng(5)
    for _ in range(60):  # no neighbour is better
        d = 1 + rng.normal(0, 0.02, 3)
        assert loss(g.omega * d[0], g.alpha * d[1], min(g.beta * d[2], 0.9995)) >= best - 1e-6
    assert not R.fit_garch(r[:49]).converged and R.fit_garch(np.zeros(100)).beta == 0.94
    white = R.fit_garch(np.random.default_rng(6).normal(size=300))  # on a bound
    assert np.isfinite([white.omega, white.alpha, white.beta]).all()


def test_garch_arm_sees_only_the_past(spark):
    r = simulated(300)
    fold = np.where(np.arange(300) < 120, -1, (np.arange(300) - 120) // 60)
    run = lambda x: {t: (f, c) for t, f, c in R.garch_arm(series(spark, {"a": x, "b": x[:200]}, fold=fold).withColumn("fold", F.col("fold").cast("int")), ["symbol"], "ts", "x").where("symbol = 'a'").select("ts", "f_garch", "converged").toPandas().itertuples(index=False)}
    one = run(r)
    assert len(one) == 180
    times = sorted(one)
    for k in range(3):
        g = R.fit_garch(r[: 120 + 60 * k])
        g = g if g.converged else R.Garch(0.0, 0.06, 0.94, g.mean, g.var, False)
        wanted = R.garch_forecast(r, g)[120 + 60 * k : 180 + 60 * k]
        assert np.allclose([one[t][0] for t in times[60 * k : 60 * k + 60]], wanted)
    changed = r.copy()
    changed[250:] *= 9  # later days change nothing before
    two = run(changed)
    assert all(one[t][0] == pytest.approx(two[t][0], abs=1e-12) for t in times[:130])
    assert any(abs(one[t][0] - two[t][0]) > 1e-3 for t in times[130:])


@pytest.mark.parametrize("block_rows", [1, 5, 1 << 16])
def test_uniqueness_at_any_cut(spark, block_rows):
    from tidemark.operators.labels import uniqueness

    rng = np.random.default_rng(7)
    spans = {k: sorted((int(a), int(a + rng.integers(0, 30))) for a in rng.choice(200, n, replace=False)) for k, n in (("a", 60), ("b", 3))}
    rows = [(k, a, b) for k, v in spans.items() for a, b in v]
    got = {(r["symbol"], r["pos0"]): r for r in uniqueness(spark.createDataFrame(rows, "symbol string, pos0 long, pos1 long"), decay_oldest=0.5, block_rows=block_rows).collect()}
    assert len(got) == 63
    for k, v in spans.items():
        c = np.zeros(300)
        for a, b in v:
            c[a : b + 1] += 1
        u = np.array([np.mean(1 / c[a : b + 1]) for a, b in v])
        w = u * (0.5 + 0.5 * np.cumsum(u) / u.sum())
        for (a, _), x, y in zip(v, u, w / w.mean()):
            assert got[k, a]["avg_uniqueness"] == pytest.approx(x) and got[k, a]["weight"] == pytest.approx(y)


def test_purging_joins_no_rows(spark):
    from tidemark.operators import cv

    rng = np.random.default_rng(8)
    rows = [(i, i * 10, i * 10 + int(rng.integers(0, 80)) * (20 if i % 37 == 0 else 1)) for i in range(400)]
    tests = [(s, i) for s in range(3) for i in range(400) if i // 40 in (s, s + 4)]
    out = cv.purge(spark.createDataFrame(rows, "row int, t0 long, t1 long"), spark.createDataFrame(tests, "split int, row int"), 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Join" not in plan and "Cartesian" not in plan
    wanted = set()
    for s in range(3):
        own = [i for t, i in tests if t == s]
        for i, t0, t1 in rows:
            overlap = any(t0 <= rows[j][2] and t1 >= rows[j][1] for j in own)
            late = any(0 < i - j <= 7 and j + 1 not in own for j in own)
            if i not in own and not overlap and not late:
                wanted.add((s, i))
    assert {(r["split"], r["row"]) for r in out.collect()} == wanted
