"""Meta-labelling, gated bets and paired arms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cv
from tidemark.operators import meta as ME
from tidemark.operators import modeling as M
from tidemark.operators import selection as SE


def test_sides_and_meta_labels(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 2.0, 1), (1, -0.5, 1), (2, 3.0, 0), (3, -1.0, -1), (4, 0.0, 1), (5, None, 1), (6, nan, 1), (7, inf, 1), (8, -inf, -1), (9, 1.0, None)]
    got = {r["id"]: (r["side"], r["meta"], r["abs_s"]) for r in ME.meta_set(spark.createDataFrame(rows, "id int, s double, label int"), "s").collect()}
    assert got == {0: (1, 1, 2.0), 1: (-1, 0, 0.5), 2: (1, 0, 3.0), 3: (-1, 1, 1.0), 9: (1, 0, 1.0)}


def test_bets_equal_numpy(spark):
    rng = np.random.default_rng(4)
    side, meta, ret, w, p = rng.choice([-1, 1], 200), rng.integers(0, 2, 200), rng.normal(size=200), rng.uniform(0.1, 1, 200), rng.uniform(size=200)
    p[:3] = 0.5  # not above the threshold
    df = spark.createDataFrame(list(zip(side.tolist(), meta.tolist(), ret.tolist(), w.tolist(), p.tolist())), "side int, meta int, ret double, w double, proba double")
    (r,) = ME.bet_stats(ME.gated(df).withColumn("k", F.lit(1)), ["k"]).collect()
    act = p > 0.5
    gross = np.where(act, side, 0) * ret
    assert r["n"] == 200 and r["action_rate"] == pytest.approx(act.mean()) and r["sharpe"] == pytest.approx(gross.mean() / gross.std(ddof=1))
    assert r["mean_gross"] == pytest.approx((gross * w).sum() / w.sum()) and r["always_gross"] == pytest.approx((side * ret * w).sum() / w.sum())
    assert r["balanced_accuracy"] == pytest.approx((act[meta == 1].mean() + (~act[meta == 0]).mean()) / 2)
    assert r["hit_acted"] == pytest.approx(meta[act].mean()) and r["hit_always"] == pytest.approx(meta.mean())
    (one,) = ME.bet_stats(ME.gated(df.where("meta = 1").withColumn("proba", F.lit(None).cast("double"))).withColumn("k", F.lit(1)), ["k"]).collect()
    assert one["action_rate"] == 0 and one["balanced_accuracy"] == 0 and one["hit_acted"] is None and one["sharpe"] is None


def test_search_finds_when_the_side_pays(spark):
    rng = np.random.default_rng(11)
    n = 400
    x, signal = rng.normal(size=n), rng.choice([-1.0, 1.0], n)
    pays = rng.uniform(size=n) < 1 / (1 + np.exp(-4 * x))  # x says whether the signal is right
    way = np.where(pays, signal, -signal)
    ret = way * rng.uniform(0.5, 1.5, n)
    df = spark.createDataFrame([(f"{i:05d}", float(x[i]), float(signal[i]), int(way[i]), float(ret[i]), 1.0) for i in range(n)], "id string, x double, s double, label int, ret double, w double")
    df = df.withColumns({"t0": F.timestamp_seconds(F.col("id").cast("int") * 3600), "t1": F.timestamp_seconds(F.col("id").cast("int") * 3600 + 60)})
    m = cv.numbered(ME.meta_set(df, "s"), "id")
    trials, row = ME.meta_search(m, cv.purged_kfold(m.drop("row"), 4), cv.cpcv(m.drop("row"), 4, 2), ["x", "abs_s"], {"weak": 0.1, "tied": 0.1, "strong": 1e6})
    rows = {r["estimator"]: r for r in trials.collect()}
    (r,) = row.collect()
    assert set(rows) == {"weak", "tied", "strong"} and rows["weak"]["sharpe"] == pytest.approx(rows["tied"]["sharpe"])
    assert r["estimator"] == "weak" and r["n_trials"] == 3 and r["n"] == n and r["paths"] == 3
    assert r["balanced_accuracy"] > 0.8 and r["hit_acted"] > 0.8 > r["hit_always"] and r["mean_gross"] > r["always_gross"]
    assert r["gate_skill"] and r["gate_gross"] and r["gate_action"] and r["gate_paths"] and r["passed"] == all(r[g] for g in SE.meta_gates())


def test_attribution_and_decision(spark):
    verdicts = [(k, a, p) for k, b, t in (("a", True, True), ("b", False, True), ("c", True, False), ("d", False, False), ("e", True, None)) for a, p in (("baseline", b), ("treatment", t))] + [("f", "baseline", True)]
    found = ME.attribution(spark.createDataFrame(verdicts, "symbol string, arm string, passed boolean"), ["symbol"])
    assert {r["symbol"]: r["attribution"] for r in found.collect()} == {"a": "not_cleanly_attributable", "b": "attributable", "c": "null", "d": "null", "e": "null", "f": "null"}
    for keys, expected in (("abcdef", (6, 2, True, "edge_candidate_fragile")), ("ab", (2, 2, False, "edge_candidate")), ("cd", (2, 0, False, "no_significant_edge")), ("", (0, 0, False, "no_significant_edge"))):
        assert tuple(ME.decision(found.where(F.col("symbol").isin(list(keys)))).first()) == expected


def test_arms_must_share_their_rows(spark):
    a = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 2.0), ("y", 0, 3.0)], "symbol string, pos int, ret double")
    study = lambda m, arm: m.groupBy("symbol").agg((F.sum("ret") > (2.5 if arm == "baseline" else 0)).alias("passed"))
    got = {r["symbol"]: r["attribution"] for r in ME.paired_arms(a, a.orderBy("ret"), ["symbol", "pos", "ret"], study, ["symbol"]).collect()}
    assert got == {"x": "not_cleanly_attributable", "y": "not_cleanly_attributable"}
    for b in (a.where("pos = 0"), a.withColumn("ret", F.col("ret") * 2), a.unionByName(a.limit(1))):
        with pytest.raises(ValueError):
            ME.paired_arms(a, b, ["symbol", "pos", "ret"], study, ["symbol"])


def test_a_probability_at_the_threshold_is_not_acted_on(spark):
    df = spark.createDataFrame([("k", 1, 0.5), ("k", 1, 0.6), ("k", 0, 0.5), ("k", 0, 0.7)], "k string, y int, p double")
    (r,) = M.meta_skill(df, ["k"]).collect()
    assert (r["balanced_accuracy"], r["action_rate"], r["hit_acted"], r["hit_always"]) == (0.5, 0.5, 0.5, 0.5)
