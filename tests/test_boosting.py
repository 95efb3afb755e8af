"""Boosted trees and their attributions against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B


def planted(n=600, seed=0, missing=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] * x[:, 1] > 0, 1.0, -1.0) + 0.5 * np.abs(x[:, 2]) + 0.1 * rng.normal(size=n)
    w = rng.uniform(0.5, 2, n)
    x[rng.random(n) < missing, 2] = np.nan
    return x, y, w


def frames(spark, x, y, w, tests=(0, 1)):
    rows = [(i, *(None if i % 2 and np.isnan(v) else float(v) for v in x[i]), float(y[i]), float(w[i])) for i in range(len(y))]
    matrix = spark.createDataFrame(rows, "row int, a double, b double, c double, y double, w double").repartition(3)
    split = spark.createDataFrame([(k, i, "test" if i % 5 == k else "train") for k in tests for i in range(len(y))], "split int, row int, role string")
    return matrix, split


NAMES = ["a", "b", "c"]


def grown(bins, y, w, loss, start, s):
    """One round of trees by exhaustive search in numpy."""
    margins = np.broadcast_to(start, (len(y), len(start)))
    g, h = loss.gradient(y, margins)
    trees = []
    for c in range(loss.classes):
        out = {}

        def cut(node, rows, c=c, out=out):
            gg, hh = (g[rows, c] * w[rows]).sum(), (h[rows, c] * w[rows]).sum()
            out[node] = (len(rows), -s.rate * gg / (hh + s.l2), None)
            if node >= (1 << s.depth) - 1:
                return
            best = None
            score = lambda a, b: a * a / (b + s.l2)
            for f, b, m in itertools.product(range(bins.shape[1]), range(1, s.bins + 1), (False, True)):
                col = bins[rows, f]
                if not (col == b).any():
                    continue
                left = np.where(col == 0, m, col <= b)
                n = left.sum()
                if n < s.min_rows or len(rows) - n < s.min_rows:
                    continue
                lg, lh = (g[rows, c] * w[rows])[left].sum(), (h[rows, c] * w[rows])[left].sum()
                gain = score(lg, lh) + score(gg - lg, hh - lh) - score(gg, hh)
                if gain > s.min_gain and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, b, m, left)
            if best:
                out[node] = (*out[node][:2], best[1:4])
                cut(2 * node + 1, rows[best[4]])
                cut(2 * node + 2, rows[~best[4]])

        cut(0, np.arange(len(y)))
        trees.append(out)
    return trees


@pytest.mark.parametrize("kind", ["squared", "qlike", "softmax"])
def test_first_round_equals_exhaustive_search(spark, kind):
    x, y, w = planted(240)
    if kind == "softmax":
        y = np.digitize(y, [-0.3, 0.9]).astype(float)
    loss = {"squared": B.squared, "qlike": B.qlike, "softmax": lambda: B.softmax(3)}[kind]()
    s = B.Settings(rounds=1, depth=2, bins=8, min_rows=10)
    forests = B.fit(*frames(spark, x, y, w), NAMES, loss, s)
    for k in (0, 1):
        train = np.arange(len(y)) % 5 != k
        f = forests[k]
        share = [w[train][y[train] == c].sum() / w[train].sum() for c in range(3)]
        assert np.allclose(f.start, np.log(share) if kind == "softmax" else [(w * y)[train].sum() / w[train].sum()])
        for tree, wanted in zip(f.trees[0], grown(f.bins(x[train]), y[train], w[train], loss, f.start, s)):
            for node, (n, value, cut) in wanted.items():
                assert tree.rows[node] == n and tree.value[node] == pytest.approx(value, abs=1e-9)
                assert (tree.feature[node] >= 0) == (cut is not None)
                if cut:
                    same = f.bins(x[train])[:, cut[0]]
                    here = np.where(same == 0, cut[2], same <= cut[1])
                    own = f.bins(x[train])[:, tree.feature[node]]
                    mine = np.where(own == 0, tree.missing_left[node], own <= tree.cut[node])
                    assert node or (here == mine).all()  # cuts alike may have other names


def test_trees_beat_a_line_on_qlike_and_refresh_changes_nothing(spark):
    from tidemark.operators.studies import qlike_linear

    x, y, w = planted(missing=0)
    matrix, splits = frames(spark, x, y, w)
    s = B.Settings(rounds=12, depth=3, bins=16, rate=0.3, refresh=5)
    found = B.predict(matrix, splits, NAMES, forests := B.fit(matrix, splits, NAMES, B.qlike(), s), B.qlike()).collect()
    train = np.arange(len(y)) % 5 != 0
    line = qlike_linear()(x[train], y[train], w[train], x[~train])
    mean = lambda p, t: float(np.mean(np.exp(t - p) - (t - p) - 1))
    mine = sorted((r["row"], r["pred"]) for r in found if r["split"] == 0)
    assert mean(np.array([p for _, p in mine]), y[~train]) < 0.5 * mean(line, y[~train])
    again = B.fit(matrix, splits, NAMES, B.qlike(), B.Settings(rounds=12, depth=3, bins=16, rate=0.3, refresh=100))
    for k in (0, 1):
        a, b = (f[k].added(f[k].bins(x)) for f in (forests, again))
        assert np.allclose(a, b)


def test_early_stopping_is_purged(spark):
    rng = np.random.default_rng(1)
    n = 300
    x, y, w = rng.normal(size=(n, 3)), rng.normal(size=n), np.ones(n)  # nothing to learn
    matrix, splits = frames(spark, x, y, w, tests=(0,))
    spans = spark.createDataFrame([(i, i * 10, i * 10 + (500 if i % 40 == 3 else 15)) for i in range(n)], "row int, t0 int, t1 int")
    matrix = matrix.join(spans, "row")
    inner = B.inner_validation(matrix, splits, 0.2)
    role = {r["row"]: r["role"] for r in inner.collect()}
    train = [i for i in range(n) if i % 5 != 0]
    valid = train[-round(0.2 * len(train)):]
    end = lambda i: i * 10 + (500 if i % 40 == 3 else 15)
    assert {i for i, r in role.items() if r == "valid"} == set(valid)
    assert {i for i, r in role.items() if r == "train"} == {i for i in train[: -len(valid)] if end(i) < valid[0] * 10}
    assert {i for i, r in role.items() if r == "test"} == {i for i in range(n) if i % 5 == 0}
    forest = B.fit(matrix, inner, NAMES, B.squared(), B.Settings(rounds=15, depth=3, rate=0.5, patience=2, bins=16))[0]
    assert len(forest.losses) < 15 and len(forest.trees) == int(np.argmin(forest.losses))
    few = B.inner_validation(matrix, splits.where("row < 40"), 0.2)
    assert {r["role"] for r in few.collect()} == {"train", "test"}


def expected(tree, bins, known, node=0):
    """The tree's value where only ``known`` features are seen: others follow both sides by their training rows."""
    f = int(tree.feature[node])
    if f < 0:
        return float(tree.value[node])
    left, right = 2 * node + 1, 2 * node + 2
    if f in known:
        goes = tree.missing_left[node] if bins[f] == 0 else bins[f] <= tree.cut[node]
        return expected(tree, bins, known, left if goes else right)
    return (tree.rows[left] * expected(tree, bins, known, left) + tree.rows[right] * expected(tree, bins, known, right)) / tree.rows[node]


def test_contributions_are_shapley_values(spark):
    rng = np.random.default_rng(3)
    n, p = 400, 6
    x = rng.normal(size=(n, p))
    x[rng.random((n, p)) < 0.05] = np.nan
    y = np.nan_to_num(x[:, 0] * x[:, 1]) + np.nan_to_num(x[:, 2]) + (np.nan_to_num(x[:, 3]) > 0) * np.nan_to_num(x[:, 4])
    names = list("abcdef")
    matrix = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), 1.0) for i in range(n)], "row int, " + ", ".join(f"{c} double" for c in names) + ", y double, w double")
    splits = spark.createDataFrame([(0, i, "test" if i % 4 == 0 else "train") for i in range(n)], "split int, row int, role string")
    forests = B.fit(matrix, splits, names, B.squared(), B.Settings(rounds=3, depth=4, bins=16, rate=0.5, min_rows=5))
    found = {r["row"]: r for r in B.contributions(matrix, splits, names, forests).collect()}
    margins = {r["row"]: r["margins"][0] for r in B.predict(matrix, splits, names, forests, B.squared()).collect()}
    assert set(found) == set(margins) == set(range(0, n, 4))
    for i, r in found.items():
        assert r["base"] + sum(r["parts"]) == pytest.approx(margins[i], abs=1e-9)
    forest = forests[0]
    for i in (0, 4, 8, 40):
        bins = forest.bins(x[i : i + 1])[0]
        value = lambda known: sum(expected(t, bins, known) for (t,) in forest.trees)
        for f in range(p):
            others = [j for j in range(p) if j != f]
            phi = sum(math.factorial(k) * math.factorial(p - k - 1) / math.factorial(p) * (value({*s, f}) - value(set(s))) for k in range(p) for s in itertools.combinations(others, k))
            assert found[i]["parts"][f] == pytest.approx(phi, abs=1e-9)
    shares = B.attribution_shares(B.contributions(matrix, splits, names, forests), names, ["split"]).collect()
    assert sum(r["share"] for r in shares) == pytest.approx(1)


def test_nothing_to_train_on(spark):
    x, y, w = planted(30)
    matrix, splits = frames(spark, x, y, w)
    assert B.fit(matrix, splits.where("role = 'test'"), NAMES, B.squared()) == {}
    assert B.predict(matrix, splits, NAMES, {}, B.squared()).count() == 0
    flat = matrix.withColumns({c: F.lit(None).cast("double") for c in NAMES})
    forest = B.fit(flat, splits, NAMES, B.squared(), B.Settings(rounds=2))[0]
    assert all((t.feature == -1).all() for trees in forest.trees for t in trees)
