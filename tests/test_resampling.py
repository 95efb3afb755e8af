"""Dependence statistics on Spark against numpy on the whole series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import statistics as S
from tidemark.operators import resampling as RS

T0 = dt.date(2023, 1, 1)


def series(spark, values):
    rows = [(k, T0 + dt.timedelta(days=i), float(v)) for k, xs in values.items() for i, v in enumerate(xs)]
    return RS.placed(spark.createDataFrame(rows, "k string, day date, d double").repartition(3), ["k"], "day", "d")


@pytest.mark.parametrize("lag", [0, 1, 4, 50])
def test_long_run_variance(spark, lag):
    rng = np.random.default_rng(0)
    values = {"a": np.cumsum(rng.normal(size=90)), "b": rng.normal(size=7), "c": np.array([1.0])}
    got = {r["k"]: r for r in RS.long_run_variance(series(spark, values), ["k"], lag).collect()}
    for k, x in values.items():
        assert got[k]["variance"] == pytest.approx(S.newey_west(x, lag), abs=1e-9) and got[k]["n"] == len(x)


@pytest.mark.parametrize("horizon", [1, 3])
def test_diebold_mariano(spark, horizon):
    rng = np.random.default_rng(1)
    a, b = rng.chisquare(2, 120), rng.chisquare(2, 120) + 0.2
    df = spark.createDataFrame([("x", T0 + dt.timedelta(days=i), float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))] + [("y", T0, 1.0, 2.0), ("y", T0, None, 2.0)], "k string, day date, a double, b double")
    got = {r["k"]: r for r in RS.diebold_mariano(df, ["k"], "day", "a", "b", horizon).collect()}
    wanted = S.diebold_mariano(a, b, horizon)
    assert got["x"]["stat"] == pytest.approx(wanted["stat"]) and got["x"]["p"] == pytest.approx(wanted["p"]) and got["x"]["n"] == 120
    assert np.isnan(got["y"]["p"]) and got["y"]["n"] == 1


def test_blocks_cover_a_resample():
    for n in (2, 5, 100, 1000):
        starts, lengths = RS.geometric_blocks(n, 10.0, (1, 2, 3))
        assert lengths.sum() == n and (lengths > 0).all() and ((starts >= 0) & (starts < n)).all()
    sizes = np.concatenate([RS.geometric_blocks(1000, 10.0, (7, i))[1][:-1] for i in range(60)])
    assert abs(sizes.mean() - 10) < 0.5


def test_bootstrap_equals_resamples_laid_out(spark):
    rng = np.random.default_rng(2)
    values = {"up": rng.normal(0.15, 1, 80), "down": rng.normal(-0.2, 1, 33), "two": np.array([1.0, 2.0]), "one": np.array([3.0])}
    s = series(spark, values)
    got = {r["k"]: r for r in RS.stationary_bootstrap(s, ["k"], resamples=250, seed=5).collect()}
    hashes = {r["k"]: r["h"] for r in s.select("k", F.abs(F.xxhash64(F.lit("key"), "k")).alias("h")).distinct().collect()}
    for k, x in values.items():
        if len(x) < 2:
            assert np.isnan(got[k]["p"])
            continue
        centred, beyond = x - x.mean(), 0
        for i in range(250):
            starts, lengths = RS.geometric_blocks(len(x), 10.0, (5, hashes[k], i))
            at = np.concatenate([np.arange(a, a + n) % len(x) for a, n in zip(starts, lengths)])
            assert len(at) == len(x)
            beyond += centred[at].mean() >= x.mean()
        assert got[k]["p"] == pytest.approx((beyond + 1) / 251)
    assert got["down"]["p"] > 0.5 > got["up"]["p"]
