"""Gradient-boosted trees whose training rows stay on Spark, for any loss with a gradient and a curvature, and their exact attributions.

Features are cut into quantile bins, found on each split's own training rows. A level of a tree is one job: tasks add up gradients, curvatures and
rows by (split, class, node, feature, bin) over their rows, a shuffle adds the tasks up, and windows over the bins find each node's best cut. All
splits and classes grow together. Only cuts come to the driver (a row a node), and trees go back to the tasks; neither grows with the rows.
Margins are rewritten every ``refresh`` rounds; between, tasks add the trees since to the last ones.

A missing value has a bin of its own, and goes to the side where it gains more.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import sdiv
from ..plans.shipping import shared_folder, ship, written

# --- losses ----------------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Loss:
    """``gradient(y, margins)`` and curvature, ``value(y, margins)`` a row; margins are rows x classes; ``start`` are the first margins, as aggregates."""

    classes: int
    start: Callable[[str, str], list[Column]]
    gradient: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    value: Callable[[np.ndarray, np.ndarray], np.ndarray]
    predict: Callable[[np.ndarray], np.ndarray]


def _mean(y: str, w: str) -> list[Column]:
    return [sdiv(F.sum(F.col(y) * F.col(w)), F.sum(w))]


def squared() -> Loss:
    return Loss(1, _mean, lambda y, m: (m - y[:, None], np.ones_like(m)), lambda y, m: (m[:, 0] - y) ** 2 / 2, lambda m: m[:, 0])


def qlike() -> Loss:
    """Quasi-likelihood of a log variance: exp(d) - d - 1 of the error d, cut at 30 either way."""
    error = lambda y, m: np.clip(y[:, None] - m, -30, 30)
    return Loss(1, _mean, lambda y, m: (1 - np.exp(error(y, m)), np.exp(error(y, m))), lambda y, m: (np.exp(error(y, m)) - error(y, m) - 1)[:, 0], lambda m: m[:, 0])


def softmax(classes: int) -> Loss:
    """Cross-entropy of classes 0, 1, ...; the prediction is the likeliest class, the first of equals."""

    def shares(m: np.ndarray) -> np.ndarray:
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradient(y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = shares(m)
        return p - (y[:, None] == np.arange(classes)), np.maximum(p * (1 - p), 1e-6)

    start = lambda y, w: [F.ln(F.greatest(sdiv(F.sum(F.when(F.col(y) == k, F.col(w)).otherwise(0.0)), F.sum(w)), F.lit(1e-6))) for k in range(classes)]
    value = lambda y, m: -np.log(np.maximum(shares(m)[np.arange(len(y)), y.astype(np.int64)], 1e-300))
    return Loss(classes, start, gradient, value, lambda m: m.argmax(axis=1).astype(float))


# --- trees -----------------------------------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes numbered as a heap; ``feature`` -1 ends a path. A row goes left if its bin is at most ``cut``; bin 0 (missing) by ``missing_left``."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """Where each row (rows x features of bins) ends; rows of a node that is still to be cut stay in it."""
        at, each = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := self.feature[at] >= 0).any():
            b = bins[each, np.maximum(self.feature[at], 0)]
            left = np.where(b == 0, self.missing_left[at], b <= self.cut[at])
            at = np.where(inner, 2 * at + 2 - left, at)
        return at


@dataclass
class Forest:
    """One split's model: bin edges by feature, first margins, and a tree a class for each round."""

    edges: list[np.ndarray]
    start: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # of validation rows, before each round
    stopped: bool = False

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins (from 1, 0 missing) of rows x features."""
        out = np.zeros(x.shape, np.int64)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(edges, x[:, f], "left"))
        return out

    def added(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        """What the trees from round ``since`` on add to the margins of rows x features of bins."""
        out = np.zeros((len(bins), len(self.start)))
        for trees in self.trees[since:]:
            for c, t in enumerate(trees):
                out[:, c] += t.value[t.leaf(bins)]
        return out


# --- training --------------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    rounds: int = 50
    depth: int = 3
    rate: float = 0.1
    l2: float = 1.0
    min_rows: int = 20
    min_gain: float = 0.0
    bins: int = 64
    patience: int = 10  # rounds without a lower validation loss; only where a split has validation rows
    refresh: int = 16


def inner_validation(matrix: DataFrame, splits: DataFrame, share: float = 0.15, least: int = 10, least_train: int = 50) -> DataFrame:
    """``split, row, role``: the last ``share`` of each split's training rows become 'valid', and training rows whose span [t0, t1] reaches one of theirs go.

    ``matrix(row, t0, t1)``, rows numbered by t0. Splits left with fewer than ``least`` validation or ``least_train`` training rows stay as they were.
    """
    train = splits.where("role = 'train'").select("split", "row").join(matrix.select("row", "t0", "t1"), "row")
    cut = train.groupBy("split").agg(F.expr(f"percentile_disc({1 - share}) within group (order by row)").alias("last"))  # a row a split
    told = train.join(F.broadcast(cut), "split").withColumn("valid", F.col("row") > F.col("last"))
    span = told.where("valid").groupBy("split").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
    told = told.join(F.broadcast(span), "split").where(F.col("valid") | (F.col("t1") < F.col("lo")) | (F.col("t0") > F.col("hi")))
    enough = told.groupBy("split").agg(F.count_if("valid").alias("v"), F.count_if(~F.col("valid")).alias("t")).where((F.col("v") >= least) & (F.col("t") >= least_train)).select("split")
    inner = told.join(F.broadcast(enough), "split", "left_semi").select("split", "row", F.when(F.col("valid"), "valid").otherwise("train").alias("role"))
    rest = splits.where("role = 'train'").join(F.broadcast(enough), "split", "left_anti").unionByName(splits.where("role <> 'train'"), allowMissingColumns=True)
    return inner.unionByName(rest.select("split", "row", "role"))


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for f in features]) if batch.num_rows else np.zeros((0, len(features)))


def _binned(forests, features: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, x = np.asarray(batch.column("split")), _matrix(batch, features)
            for k in np.unique(split).tolist():
                at = np.flatnonzero(split == k)
                forest = forests.value[k]
                raw = forest.bins(x[at]).astype(np.uint8)
                margins = pa.array(np.broadcast_to(forest.start, (len(at), len(forest.start))).tolist(), pa.list_(pa.float64()))
                take = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(take.column(c) for c in ("split", "row", "role", "y", "w")), pa.array([r.tobytes() for r in raw], pa.binary()), margins], ["split", "row", "role", "y", "w", "bins", "margins"])

    return run


BINNED = "split int, row int, role string, y double, w double, bins binary, margins array<double>"


def _by_split(batch: pa.RecordBatch, n_features: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Split, its rows of the batch, their bins and written margins."""
    split = np.asarray(batch.column("split"))
    for k in np.unique(split).tolist():
        at = np.flatnonzero(split == k)
        take = batch.take(pa.array(at))
        bins = np.frombuffer(b"".join(take.column("bins").to_pylist()), np.uint8).reshape(len(at), n_features).astype(np.int64)
        margins = np.asarray(take.column("margins").flatten()).reshape(len(at), -1)
        yield k, at, bins, margins


SUMS = "split int, class int, node int, feature int, bin int, g double, h double, n double"


def _sums(state, loss: Loss, n_features: int, width: int, level: int, since: int):
    """One level's sums of this task; a row with feature -1 holds a split's validation loss and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests, growing = state.value
        first, nodes = (1 << level) - 1, 1 << level
        held: dict[int, np.ndarray] = {}
        lost: dict[int, np.ndarray] = {}
        for batch in batches:
            role, y_all, w_all = np.asarray(batch.column("role").to_pylist(), object), np.asarray(batch.column("y")), np.asarray(batch.column("w"))
            for k, at, bins, margins in _by_split(batch, n_features):
                margins = margins + forests[k].added(bins, since)
                y, w, train = y_all[at], w_all[at], role[at] == "train"
                if level == 0 and (valid := role[at] == "valid").any():
                    lost[k] = lost.get(k, np.zeros(2)) + (float((w[valid] * loss.value(y[valid], margins[valid])).sum()), float(w[valid].sum()))
                g, h = loss.gradient(y[train], margins[train])
                sums = held.setdefault(k, np.zeros((3, loss.classes, nodes * n_features * width)))
                for c in range(loss.classes):
                    node = growing[k][c].leaf(bins[train]) - first
                    open_ = node >= 0  # others ended above this level
                    cell = ((node[open_][:, None] * n_features + np.arange(n_features)) * width + bins[train][open_]).ravel()
                    for s, v in enumerate((g[:, c] * w[train], h[:, c] * w[train], np.ones(train.sum()))):
                        sums[s, c] += np.bincount(cell, np.repeat(v[open_], n_features), minlength=sums.shape[2])
        for k, sums in held.items():
            c, cell = np.nonzero(sums[2])
            node, f, b = cell // (n_features * width), cell // width % n_features, cell % width
            ints = [pa.array(x.astype(np.int32)) for x in (np.full(len(c), k), c, node + first, f, b)]
            yield pa.RecordBatch.from_arrays([*ints, *(pa.array(sums[s, c, cell]) for s in range(3))], ["split", "class", "node", "feature", "bin", "g", "h", "n"])
        for k, (value, weight) in lost.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (k, 0, 0, -1, 0)), *(pa.array([x]) for x in (value, weight, 0.0))], ["split", "class", "node", "feature", "bin", "g", "h", "n"])

    return run


def best_cuts(sums: DataFrame, s: Settings) -> DataFrame:
    """``split, class, node, g, h, n, best``: a node's totals and its best cut (null if none gains), from sums by (split, class, node, feature, bin).

    The first of equal gains by (feature, cut), missing rows to the right. Feature -1 passes through with its sums.
    """
    node = ["split", "class", "node"]
    by = Window.partitionBy(*node, "feature")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = {f"t_{x}": F.sum(x).over(by) for x in "ghn"}
    missing = {f"m_{x}": F.sum(F.when(F.col("bin") == 0, F.col(x)).otherwise(0.0)).over(by) for x in "ghn"}
    left = {f"l_{x}": F.sum(x).over(upto) for x in "ghn"}  # with the missing rows, bin 0
    d = sums.withColumns(total | missing | left)
    sides = F.explode(F.array(*[F.struct(F.lit(m).alias("missing_left"), *[(F.col(f"l_{x}") - (0.0 if m else F.col(f"m_{x}"))).alias(x) for x in "ghn"]) for m in (False, True)])).alias("x")
    d = d.select(*node, "feature", "bin", "t_g", "t_h", "t_n", sides)
    score = lambda g, h: g * g / (h + s.l2)
    gain = score(F.col("x.g"), F.col("x.h")) + score(F.col("t_g") - F.col("x.g"), F.col("t_h") - F.col("x.h")) - score(F.col("t_g"), F.col("t_h"))
    fits = (F.col("bin") > 0) & (F.col("feature") >= 0) & (F.col("x.n") >= s.min_rows) & (F.col("t_n") - F.col("x.n") >= s.min_rows) & (gain > s.min_gain)
    found = F.struct(gain.alias("gain"), "feature", F.col("bin").alias("cut"), "x.missing_left", F.col("x.g").alias("lg"), F.col("x.h").alias("lh"), F.col("x.n").alias("ln"))
    rank = F.struct(gain, -F.col("feature"), -F.col("bin"), ~F.col("x.missing_left"))
    own = F.col("feature") == F.least(F.col("feature"), F.lit(0))  # totals are those of any one feature
    return d.groupBy(*node, (F.col("feature") < 0).alias("is_loss")).agg(*[F.max(F.when(own, F.col(f"t_{x}"))).alias(x) for x in "ghn"], F.max_by(F.when(fits, found), F.when(fits, rank)).alias("best"))


def fit(matrix: DataFrame, splits: DataFrame, features: list[str], loss: Loss, settings: Settings = Settings()) -> dict[int, Forest]:
    """A forest for each split from its 'train' rows: ``matrix(row, features, y, w)``, ``splits(split, row, role)``.

    Rows without y or weight take no part, missing and NaN features have a bin of their own. With 'valid' rows (``inner_validation``) a split stops after
    ``patience`` rounds without a lower loss there, and keeps the rounds up to the lowest. A split without training rows has no forest. Sums of doubles
    are added in no fixed order, so runs agree up to rounding.
    """
    spark = matrix.sparkSession
    ship(spark)
    folder = shared_folder(spark, "boosting")
    x = [F.col(f).cast("double").alias(f) for f in features]
    rows = splits.where("role in ('train', 'valid')").select(F.col("split").cast("int").alias("split"), F.col("row").cast("int").alias("row"), "role")
    rows = rows.join(matrix.select(F.col("row").cast("int").alias("row"), *x, F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")), "row").where("y is not null and w is not null")
    rows = written(rows.select("split", "row", "role", "y", "w", *features), folder, "rows")
    at = "array(" + ", ".join(f"{i / settings.bins}d" for i in range(1, settings.bins)) + ")"
    usable = lambda f: F.expr(f"case when not isnan(`{f}`) then `{f}` end")
    first = rows.where("role = 'train'").groupBy("split").agg(*[F.percentile_approx(usable(f), F.expr(at), 10_000).alias(f"e_{i}") for i, f in enumerate(features)], F.array(*loss.start("y", "w")).alias("start")).collect()  # a row a split
    forests = {r["split"]: Forest([np.unique(np.array(r[f"e_{i}"] or [], float)) for i in range(len(features))], np.array(r["start"], float)) for r in first}
    width = settings.bins + 1
    sent = spark.sparkContext.broadcast(forests)
    data = written(rows.join(F.broadcast(spark.createDataFrame([(k,) for k in forests], "split int")), "split", "left_semi").mapInArrow(_binned(sent, features), BINNED), folder, "binned-0")
    since = 0
    for r in range(settings.rounds + 1):
        alive = [k for k, f in forests.items() if not f.stopped]
        if not alive:
            break
        growing = {k: [Tree.empty(settings.depth) for _ in range(loss.classes)] for k in alive}
        for level in range(settings.depth if r < settings.rounds else 1):
            state = spark.sparkContext.broadcast(({k: forests[k] for k in alive}, growing))
            sums = data.where(F.col("split").isin(alive)).mapInArrow(_sums(state, loss, len(features), width, level, since), SUMS).groupBy("split", "class", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
            for cut in best_cuts(sums, settings).collect():  # a row a node
                if cut["is_loss"]:
                    forests[cut["split"]].losses.append(cut["g"] / max(cut["h"], 1e-300))
                    continue
                tree, i, b = growing[cut["split"]][cut["class"]], cut["node"], cut["best"]
                value = lambda g, h: -settings.rate * g / (h + settings.l2)
                tree.value[i], tree.rows[i] = value(cut["g"], cut["h"]), cut["n"]
                if b is not None:
                    tree.feature[i], tree.cut[i], tree.missing_left[i] = b["feature"], b["cut"], b["missing_left"]
                    for child, g, h, n in ((2 * i + 1, b["lg"], b["lh"], b["ln"]), (2 * i + 2, cut["g"] - b["lg"], cut["h"] - b["lh"], cut["n"] - b["ln"])):
                        tree.value[child], tree.rows[child] = value(g, h), n
        for k in alive:
            f = forests[k]
            best = int(np.argmin(f.losses)) if f.losses else r
            if r == settings.rounds or (f.losses and r - best >= settings.patience):
                f.stopped, f.trees = True, f.trees[:best] if f.losses else f.trees
            else:
                f.trees.append(growing[k])
        if (r + 1) % settings.refresh == 0 and r + 1 < settings.rounds:
            sent = spark.sparkContext.broadcast({k: forests[k] for k in alive if not forests[k].stopped})
            if sent.value:
                data = written(data.where(F.col("split").isin(list(sent.value))).mapInArrow(_refreshed(sent, len(features), since), BINNED), folder, f"binned-{r + 1}")
                since = r + 1
    return forests


def _refreshed(forests, n_features: int, since: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, at, bins, margins in _by_split(batch, n_features):
                margins = margins + forests.value[k].added(bins, since)
                take = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(take.column(c) for c in ("split", "row", "role", "y", "w", "bins")), pa.array(margins.tolist(), pa.list_(pa.float64()))], ["split", "row", "role", "y", "w", "bins", "margins"])

    return run


# --- predictions and attributions ------------------------------------------------------------------------------------------------------------


def _asked(matrix: DataFrame, splits: DataFrame, features: list[str], forests: dict[int, Forest], role: str) -> DataFrame:
    rows = splits.where((F.col("role") == role) & F.col("split").isin(list(forests))).select(F.col("split").cast("int").alias("split"), F.col("row").cast("int").alias("row"))
    return rows.join(matrix.select(F.col("row").cast("int").alias("row"), *[F.col(f).cast("double").alias(f) for f in features], F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")), "row")


def predict(matrix: DataFrame, splits: DataFrame, features: list[str], forests: dict[int, Forest], loss: Loss, role: str = "test") -> DataFrame:
    """``split, row, y, w, margins, pred`` of the rows in ``role``."""
    sent = matrix.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, x = np.asarray(batch.column("split")), _matrix(batch, features)
            for k in np.unique(split).tolist():
                at = np.flatnonzero(split == k)
                margins = sent.value[k].start + sent.value[k].added(sent.value[k].bins(x[at]))
                take = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(take.column(c) for c in ("split", "row", "y", "w")), pa.array(margins.tolist(), pa.list_(pa.float64())), pa.array(loss.predict(margins))], ["split", "row", "y", "w", "margins", "pred"])

    return _asked(matrix, splits, features, forests, role).mapInArrow(run, "split int, row int, y double, w double, margins array<double>, pred double")


class PathWeights:
    """Exact path-dependent Shapley values of one tree by table: for each leaf and each pattern of met conditions, what every feature of its path adds.

    A leaf's path has m features at most ``depth``; a row meets a feature's conditions on it or not, so 2^m patterns occur. For pattern o with
    z_j the share of training rows that a path keeps where feature j is unknown, feature i adds v (o_i - z_i) times the sum over subsets S of the other
    features of |S|! (m - |S| - 1)! / m! times the product of o_j in S and z_j outside.
    """

    def __init__(self, tree: Tree):
        self.tree, self.base, self.leaves = tree, 0.0, []
        stack: list[tuple[int, dict[int, list[tuple[int, bool]]], dict[int, float]]] = [(0, {}, {})]
        while stack:
            node, turns, kept = stack.pop()
            f = int(tree.feature[node])
            if f >= 0:
                for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
                    share = tree.rows[child] / tree.rows[node] if tree.rows[node] else 0.0
                    stack.append((child, turns | {f: [*turns.get(f, []), (node, left)]}, kept | {f: kept.get(f, 1.0) * share}))
                continue
            v, names = float(tree.value[node]), sorted(turns)
            z, m = np.array([kept[j] for j in names]), len(names)
            self.base += v * float(np.prod(z))
            table = np.zeros((1 << m, m))
            for pattern in range(1 << m):
                o = np.array([pattern >> j & 1 for j in range(m)], float)
                for i in range(m):
                    others = [j for j in range(m) if j != i]
                    total = 0.0
                    for size in range(m):
                        weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                        total += weight * sum(np.prod([o[j] for j in s]) * np.prod([z[j] for j in others if j not in s]) for s in itertools.combinations(others, size))
                    table[pattern, i] = v * (o[i] - z[i]) * total
            self.leaves.append((names, [turns[j] for j in names], table))

    def add(self, bins: np.ndarray, out: np.ndarray) -> None:
        """Adds each row's contributions to ``out`` (rows x features)."""
        t = self.tree
        for names, turns, table in self.leaves:
            pattern = np.zeros(len(bins), np.int64)
            for j, f in enumerate(names):
                met = np.ones(len(bins), bool)
                for node, left in turns[j]:
                    met &= np.where(bins[:, f] == 0, t.missing_left[node], bins[:, f] <= t.cut[node]) == left
                pattern |= met.astype(np.int64) << j
            if names:
                out[:, names] += table[pattern]


def contributions(matrix: DataFrame, splits: DataFrame, features: list[str], forests: dict[int, Forest], role: str = "test") -> DataFrame:
    """``split, row, class, base, parts array<double>``: what each feature adds to a row's margin; base and parts add up to it."""
    sent = matrix.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: [[PathWeights(t) for t in trees] for trees in f.trees] for k, f in sent.value.items()}
        for batch in batches:
            split, x = np.asarray(batch.column("split")), _matrix(batch, features)
            for k in np.unique(split).tolist():
                at, forest = np.flatnonzero(split == k), sent.value[k]
                bins, row = forest.bins(x[at]), batch.column("row").take(pa.array(np.flatnonzero(split == k)))
                for c in range(len(forest.start)):
                    out = np.zeros((len(at), len(features)))
                    for trees in tables[k]:
                        trees[c].add(bins, out)
                    base = forest.start[c] + sum(trees[c].base for trees in tables[k])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), row, pa.array(np.full(len(at), c, np.int32)), pa.array(np.full(len(at), base)), pa.array(out.tolist(), pa.list_(pa.float64()))], ["split", "row", "class", "base", "parts"])

    return _asked(matrix, splits, features, forests, role).mapInArrow(run, "split int, row int, class int, base double, parts array<double>")


def attribution_shares(parts: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """``by, feature, mean_abs, share, dominant``: a feature's mean absolute contribution over all rows, and whether it holds over half of all."""
    each = F.posexplode("parts").alias("i", "v")
    found = parts.select(*by, each).groupBy(*by, "i").agg(F.avg(F.abs("v")).alias("mean_abs"))
    whole = Window.partitionBy(*by)
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("i") + 1)
    share = F.coalesce(sdiv(F.col("mean_abs"), F.sum("mean_abs").over(whole)), F.lit(0.0))
    return found.select(*by, name.alias("feature"), "mean_abs", share.alias("share")).withColumn("dominant", F.col("share") > 0.5)
