"""Rolling windows with a least number of samples, and window plans that survive one hot key.

A frame over ``partitionBy(symbol)`` puts a symbol's whole history in one task. ``blocked`` cuts each key's rows into blocks of bounded
size, each with the last rows of the block before it, so any frame of up to ``halo`` rows back is complete inside a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import col, us


def rows(keys: list[str], order: str | list[str], n: int) -> WindowSpec:
    """The last n rows, this one included."""
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(1 - n, 0)


def guarded(agg: Callable[[Column], Column], x: Column | str, w: WindowSpec, least: int) -> Column:
    """An aggregate over a frame, null until it holds ``least`` non-null rows."""
    x = col(x)
    return F.when(F.count(x).over(w) >= least, agg(x).over(w))


def rmean(x: Column | str, w: WindowSpec, least: int) -> Column:
    return guarded(F.avg, x, w, least)


def rstd(x: Column | str, w: WindowSpec, least: int, ddof: int = 1) -> Column:
    return guarded(F.stddev_samp if ddof else F.stddev_pop, x, w, least)


def half_open_us(keys: list[str], ts: str, width_us: int) -> WindowSpec:
    """Rows in (t - width, t], by microseconds."""
    return Window.partitionBy(*keys).orderBy(us(ts)).rangeBetween(-(width_us - 1), 0)


def positions(df: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """``pos``: each row's place (from 0) among its key's rows, by counts of buckets first: no task orders more than a bucket.

    ``bucket`` must not fall where ``order`` rises (a calendar day of the ordering timestamp).
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return df.withColumn("_in", inner).join(base, [*keys, "_bucket"]).withColumn("pos", F.col("_base") + F.col("_in") - 1).drop("_bucket", "_in", "_base")


def blocked(df: DataFrame, keys: list[str], order: list[str], halo: int, compute: Callable[[DataFrame, list[str]], DataFrame], bucket: Column, block_rows: int = 1 << 17) -> DataFrame:
    """``compute(df, keys)`` with windows by key, run by (key, block) instead, each block led by ``halo`` earlier rows that are dropped after."""
    placed = positions(df, keys, order, bucket).withColumn("_block", F.floor(F.col("pos") / block_rows))
    again = F.when(F.col("pos") % block_rows >= block_rows - halo, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))
    spread = placed.withColumn("_own", F.col("_block")).withColumn("_block", F.explode(again))
    return compute(spread, [*keys, "_block"]).where("_own = _block").drop("_own", "_block", "pos")


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column | str, out: str, block: Column) -> DataFrame:
    """``out``: the sum of a key's values up to each row (rows of equal ``order`` together), by sums of blocks first: no task orders more than a block.

    ``block`` must not fall where ``order`` rises, and be one for rows of equal ``order``.
    """
    df = df.withColumns({"_b": block, "_v": col(value)})
    sums = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    base = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inner = F.sum("_v").over(Window.partitionBy(*keys, "_b").orderBy(order))
    return df.withColumn("_in", inner).join(base, [*keys, "_b"]).withColumn(out, F.col("_base") + F.coalesce("_in", F.lit(0))).drop("_b", "_v", "_in", "_base")
