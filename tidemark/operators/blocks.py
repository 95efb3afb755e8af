"""Recurrences over a key's rows in blocks: each block is summed up by one row, the rows are chained, and the blocks run again from their true starts.

No task holds more than a block, or a row a block. ``chained`` is for recurrences whose summaries compose; ``settled`` for those that only coincide
with a run from rest after a while.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shipping import shared_folder, ship, written


def month(ts: str) -> Column:
    """The calendar year and month, the default block."""
    return F.date_format(ts, "yyyyMM").cast("long")


def ddl(df: DataFrame, *extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *extra])


def affine_scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A, B such that y[t] = a[t] y[t - 1] + b[t] gives y[t] = A[t] y[-1] + B[t], by doubling: log2(n) passes over the arrays."""
    a, b, k = np.array(a, float), np.array(b, float), 1
    while k < len(a):
        b[k:] += a[k:] * b[:-k]
        a[k:] = a[k:] * a[:-k]
        k *= 2
    return a, b


def _keyed(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with columns of ``other``, one row of it a key; null keys are alike."""
    names = [F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)]
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return df.join(other.select(*names, *columns), match).drop(*[f"_k_{i}" for i in range(len(keys))])


def chained(
    df: DataFrame, keys: list[str], order: list[str], block: Column, summary: Callable[[pd.DataFrame], dict], summary_ddl: str, chain: Callable[[list[dict]], list[dict]], entry_ddl: str,
    finish: Callable[[pd.DataFrame, dict], dict[str, np.ndarray]], extra: str, once: tuple[str, ...] = (),
) -> DataFrame:
    """Adds the columns ``extra``. ``summary`` sees a block's rows in order; ``chain`` a key's summaries in order and tells each block's start; ``finish``
    the rows again with that start. ``block`` must rise with ``order``. Columns in ``once`` are helpers of ``df``, gone afterwards."""
    ship(df.sparkSession)
    df = df.withColumn("_block", block)
    by = [*keys, "_block"]
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    entries = [x.strip().split(" ")[0] for x in entry_ddl.split(",")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, **summary(pdf)}])

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", kind="stable")
        starts = pd.DataFrame(chain(pdf.to_dict("records")), columns=entries, index=pdf.index)
        return pd.concat([pdf[by], starts], axis=1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        start = {c: pdf[c].iloc[0] for c in entries}
        return pdf.drop(columns=[*entries, *once]).assign(**finish(pdf, start))

    ends = df.groupBy(*by).applyInPandas(one, f"{key_ddl}, {summary_ddl}")
    starts = ends.groupBy(*keys).applyInPandas(told, f"{key_ddl}, {entry_ddl}")
    return _keyed(df, starts, by, entries).groupBy(*by).applyInPandas(run, ddl(df.drop(*once), extra)).drop("_block")


def settled(
    df: DataFrame, keys: list[str], order: list[str], block: Column, rest: Callable[[pd.DataFrame], tuple[float, ...]], again: Callable[[pd.DataFrame, tuple[float, ...], tuple[float, ...]], tuple[float, ...]],
    finish: Callable[[pd.DataFrame, tuple[float, ...]], dict[str, np.ndarray]], extra: str, needs: list[str], state: int,
) -> DataFrame:
    """As ``chained``, for a state of ``state`` numbers that starts at zeros and has no summary.

    Every block first runs ``rest`` (from zeros). Then blocks whose predecessor ends elsewhere than they started run ``again(rows, start, end from rest)`` - which may
    stop where the run coincides with the one from rest - until all starts are their predecessors' ends. A round passes a state on by one block, and only where
    blocks do not forget it; ``needs`` are the columns that ``rest`` and ``again`` read.
    """
    spark = df.sparkSession
    ship(spark)
    folder = shared_folder(spark, "settled")
    df = written(df.withColumn("_block", block), folder, "rows")
    by = [*keys, "_block"]
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    names = lambda x: [f"_{x}_{i}" for i in range(state)]
    start, end, calm = names("start"), names("end"), names("calm")
    fields = ", ".join(f"`{c}` double" for c in (*start, *end, *calm))
    slim = df.select(*dict.fromkeys([*by, *order, *needs]))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        out = rest(pdf.sort_values(order, kind="stable"))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, **dict.fromkeys(start, 0.0), **dict(zip(end, out, strict=True)), **dict(zip(calm, out, strict=True))}])

    def once_more(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {k: pdf[k].iloc[0] for k in (*by, *start, *calm)}
        out = again(pdf.sort_values(order, kind="stable"), tuple(own[c] for c in start), tuple(own[c] for c in calm))
        return pd.DataFrame([{**own, **dict(zip(end, out, strict=True))}])

    known = written(slim.groupBy(*by).applyInPandas(first, f"{key_ddl}, {fields}"), folder, "state-0")
    before = Window.partitionBy(*keys).orderBy("_block")  # a row a block
    for k in range(1, 1 << 30):
        due = known.withColumns({f"_due_{i}": F.coalesce(F.lag(c).over(before), F.lit(0.0)) for i, c in enumerate(end)})
        stale = F.lit(False)
        for i, c in enumerate(start):
            stale = stale | (F.col(f"_due_{i}") != F.col(c))
        due = written(due.withColumn("_stale", stale), folder, f"due-{k}")
        if due.where("_stale").isEmpty():
            break
        asked = due.where("_stale").select(*by, *[F.col(f"_due_{i}").alias(c) for i, c in enumerate(start)], *calm)
        moved = _keyed(slim, asked, by, [*start, *calm]).groupBy(*by).applyInPandas(once_more, f"{key_ddl}, {fields}")
        known = written(due.where("not _stale").select(*by, *start, *end, *calm).unionByName(moved), folder, f"state-{k}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.drop(columns=start).assign(**finish(pdf, tuple(pdf[c].iloc[0] for c in start)))

    return _keyed(df, known, by, start).groupBy(*by).applyInPandas(run, ddl(df, extra)).drop("_block")
