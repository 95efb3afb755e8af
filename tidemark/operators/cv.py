"""Leak-safe cross-validation as long tables (fold, row, role)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .windows import positions


def numbered(labels: DataFrame, key: str = "id") -> DataFrame:
    """``row``: place from 0 by (t0, key). Counted by day first, so no task orders more than a day."""
    return positions(labels, [], ["t0", key], F.to_date("t0")).withColumn("row", F.col("pos").cast("int")).drop("pos")


def folds(df: DataFrame, n: int) -> DataFrame:
    """``fold``: n contiguous near-equal parts of rows numbered from 0, the first (rows mod n) one longer, in closed form."""
    size, longer = divmod(df.count(), n)
    head = longer * (size + 1)
    fold = F.when(F.col("row") < head, F.floor(F.col("row") / (size + 1))).otherwise(longer + F.floor((F.col("row") - head) / max(size, 1)))
    return df.withColumn("fold", fold.cast("int"))


def purge(rows: DataFrame, tests: DataFrame, embargo: int) -> DataFrame:
    """``split, row`` of training rows: not tested, not overlapping any tested span (ends included), not in the ``embargo`` rows after a test run.

    ``rows(row, t0, t1)`` in order of t0; ``tests(split, row)``. Each split's test rows are cut into contiguous runs; a row overlaps some span of a run exactly
    if it overlaps the run's hull. Of the runs (few a split, none depends on the number of rows) each row meets those of all splits at once, as
    constants: a row from a run on is out while it starts within the hull or the embargo, one before it if it ends within. No row is joined.
    """
    t = tests.join(rows, "row").withColumn("_run", F.col("row") - F.row_number().over(Window.partitionBy("split").orderBy("row")))
    runs = t.groupBy("split", "_run").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("t0").alias("lo"), F.max("t1").alias("hi")).collect()
    if not runs:
        return rows.select(F.lit(None).cast("int").alias("split"), "row").where("false")
    kind = rows.schema["t0"].dataType
    by_split = {s: [r for r in runs if r["split"] == s] for s in sorted({r["split"] for r in runs})}

    def out(r: Row) -> Column:
        lo, hi = F.lit(r["lo"]).cast(kind), F.lit(r["hi"]).cast(kind)
        return F.when(F.col("row") < r["a"], F.col("t1") >= lo).otherwise((F.col("row") <= r["b"] + embargo) | (F.col("t0") <= hi))

    kept = [F.when(~F.greatest(*[F.coalesce(out(r), F.lit(False)) for r in v], F.lit(False)), F.lit(s).cast("int")) for s, v in by_split.items()]
    return rows.select("row", F.explode(F.filter(F.array(*kept), lambda s: s.isNotNull())).alias("split")).select("split", "row")


def purged_kfold(labels: DataFrame, n: int = 6, embargo_pct: float = 0.01, key: str = "id") -> DataFrame:
    """``split, row, role`` with role 'test' or 'train' (purged and embargoed rows are in neither)."""
    r = numbered(labels, key)
    total = r.count()
    tests = folds(r, n).select(F.col("fold").alias("split"), "row")
    train = purge(r.select("row", "t0", "t1"), tests, -int(-embargo_pct * total // 1))
    return tests.withColumn("role", F.lit("test")).unionByName(train.withColumn("role", F.lit("train")))


def cpcv(labels: DataFrame, n: int = 6, k: int = 2, embargo_pct: float = 0.01, key: str = "id") -> DataFrame:
    """Combinatorial purged CV: ``split, row, role, path`` for all C(n, k) choices of test groups; a group's j-th test use belongs to path j."""
    r = numbered(labels, key)
    total = r.count()
    combos = [(i, g) for i, c in enumerate(itertools.combinations(range(n), k)) for g in c]
    seen: dict[int, int] = {}
    rows = []
    for i, g in combos:
        rows.append((i, g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    table = F.broadcast(labels.sparkSession.createDataFrame(rows, "split int, fold int, path int"))
    tests = folds(r, n).join(table, "fold").select("split", "row", "path")
    train = purge(r.select("row", "t0", "t1"), tests.select("split", "row"), -int(-embargo_pct * total // 1))
    return tests.withColumn("role", F.lit("test")).unionByName(train.withColumn("role", F.lit("train")).withColumn("path", F.lit(None).cast("int")))


def walk_forward(labels: DataFrame, n: int = 5, anchored: bool = True, min_train: int = 1, key: str = "id") -> DataFrame:
    """``split, row, role``: part i + 1 of n + 1 is tested after training on all parts before it (anchored) or the one before (rolling), overlaps purged."""
    r = folds(numbered(labels, key), n + 1)
    splits = F.broadcast(labels.sparkSession.createDataFrame([(i, i + 1) for i in range(n)], "split int, test_fold int"))
    tests = r.join(splits, r.fold == F.col("test_fold")).select("split", "row", "t0")
    first = tests.groupBy("split").agg(F.min("t0").alias("start"))
    past = (F.col("fold") < F.col("test_fold")) if anchored else (F.col("fold") == F.col("test_fold") - 1)
    train = r.join(splits, past).join(F.broadcast(first), "split").where("t1 < start").select("split", "row")
    enough = train.groupBy("split").count().where(F.col("count") >= min_train).select("split")
    out = tests.select("split", "row").withColumn("role", F.lit("test")).unionByName(train.withColumn("role", F.lit("train")))
    return out.join(F.broadcast(enough), "split", "left_semi")
