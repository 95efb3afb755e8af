"""Distributed logistic cells, selection and gates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import modeling as M
from tidemark.operators import selection as SE


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 300
    x = rng.normal(size=(n, 2)) * (1, 40) + (3, -7)
    y = np.where(x[:, 0] - 3 + rng.normal(size=n) > 0, 1.0, -1.0)
    w = rng.uniform(0.2, 2, n)
    rows = [(i, float(x[i, 0]), float(x[i, 1]), float(y[i]), float(w[i]), float(y[i] * abs(rng.normal()))) for i in range(n)]
    matrix = spark.createDataFrame(rows, "row int, a double, b double, y double, w double, ret double").repartition(4)
    splits = spark.createDataFrame([(k, i, "test" if i % 3 == k else "train") for k in range(3) for i in range(n)], "split int, row int, role string")
    return matrix, splits, x, y, w


def test_cells_equal_fits_in_one_piece(data):
    matrix, splits, x, y, w = data
    penalties = {"weak": 0.1, "strong": 50.0}
    cells = SE.fit_logistic(matrix, splits, ["a", "b"], penalties)
    found = {(r["estimator"], r["split"], r["row"]): r for r in SE.predict_logistic(matrix, splits, ["a", "b"], cells).collect()}
    assert len(found) == 600
    for name, l2 in penalties.items():
        for k in range(3):
            train = np.arange(300) % 3 != k
            pred = M.logistic(l2)(x[train], y[train], w[train], x[~train])
            assert [found[name, k, i]["pred"] for i in np.flatnonzero(~train).tolist()] == pred.tolist()
            c = cells[name, k]
            a, p = c.design(x[train]), c.proba(x[train])
            gradient = a.T @ (w[train] * ((y[train] > 0) - p)) - np.array([1e-9, l2, l2]) * c.weights
            assert c.done and np.abs(gradient).max() < 1e-6
    plan = SE.predict_logistic(matrix, splits, ["a", "b"], cells)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_rules_equal_their_estimators(data):
    matrix, splits, x, y, w = data
    by_row = lambda df: {(r["split"], r["row"]): r["pred"] for r in df.collect()}
    majority, momentum = by_row(SE.rule(matrix, splits, "majority")), by_row(SE.rule(matrix, splits, "m", F.col("a") - 3))
    for k in range(3):
        train = np.arange(300) % 3 != k
        side = M.majority()(x[train], y[train], w[train], x[~train])
        for i, s in zip(np.flatnonzero(~train).tolist(), side):
            assert majority[k, i] == s and momentum[k, i] == (1 if x[i, 0] > 3 else -1)


def test_search_counts_trials_and_judges_the_selected_alone(spark, data):
    from tidemark.operators import cv

    matrix, splits, *_ = data
    spans = matrix.withColumns({"t0": F.timestamp_seconds(F.col("row") * 3600), "t1": F.timestamp_seconds(F.col("row") * 3600 + 60), "id": F.format_string("%05d", "row")})
    paths = cv.cpcv(spans.drop("row"), 4, 2)
    table, row = SE.search(matrix, splits, paths, ["a", "b"], {"x1": 0.1, "x2": 1.0, "x3": 1e6})
    rows = {r["estimator"]: r for r in table.collect()}
    assert set(rows) == {"x1", "x2", "x3"}
    (r,) = row.collect()
    assert r["estimator"] == max(sorted(rows), key=lambda k: rows[k]["accuracy"]) and r["n_trials"] == 3 and r["paths"] == 3
    assert r["gate_gross"] and r["gate_action"] and r["gate_f1"] and r["passed"] == all(r[g] for g in ("gate_pbo", "gate_dsr", "gate_gross", "gate_action", "gate_paths", "gate_f1"))


def test_gates_fail_on_what_is_missing(spark):
    good = dict(pbo=0.1, dsr=0.99, mean_gross=0.01, action_rate=0.5, path_median_sharpe=0.2, macro_f1=0.5, balanced_accuracy=0.6, hit_acted=0.6, hit_always=0.5)
    bad = dict(pbo=0.5, dsr=0.95, mean_gross=0.0, action_rate=0.049, path_median_sharpe=0.0, macro_f1=0.33, balanced_accuracy=0.49, hit_acted=0.5)
    fields = ", ".join(f"{k} double" for k in good)
    cases = [good] + [good | {k: v} for k, v in bad.items()] + [good | {k: None} for k in good]
    for gates, judges in ((SE.micro_gates(), {"macro_f1"}), (SE.meta_gates(), {"balanced_accuracy", "hit_acted", "hit_always"})):
        common = {"pbo", "dsr", "mean_gross", "action_rate", "path_median_sharpe"}
        for case in cases:
            changed = next((k for k in good if case[k] != good[k]), None)
            (r,) = SE.judged(spark.createDataFrame([tuple(case.values())], fields), gates).collect()
            assert r["passed"] == (changed not in common | judges)


def test_macro_f1(spark):
    df = spark.createDataFrame([("a", t, p) for t, p in ((1, 1), (1, 0), (0, 0), (-1, 1))] + [("b", 1, 1)], "k string, t int, p int")
    got = {r["k"]: r["macro_f1"] for r in SE.macro_f1(df, "t", "p", [-1, 0, 1], ["k"]).collect()}
    assert got["a"] == pytest.approx((0 + 2 / 3 + 1 / 2) / 3) and got["b"] == pytest.approx(1 / 3)


def test_a_frozen_frame_is_guarded(spark):
    from tidemark.operators.studies import guard

    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    f = M.fingerprint(df, ["x", "y"]).first()
    expected = f"{f['n']}:{f['hash_sum']}"
    assert guard(df.orderBy("y"), ["x", "y"], expected).count() == 2
    for other in (df.where("x = 1"), df.withColumn("y", F.lit("c"))):
        with pytest.raises(ValueError):
            guard(other, ["x", "y"], expected)
