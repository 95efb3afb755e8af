"""Statistics of dependent series that stay on Spark: long-run variances by lagged products, and the stationary bootstrap by prefix sums.

A series is rows (keys, place, value). Products of a lag meet by place, so a hot key is spread; a resampled block's sum is a difference of two prefix sums, so no
resample is ever laid out. Only statistics are collected, a row a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as S
from ..plans.shipping import shared_folder, ship, written
from .windows import positions, running_sum


def placed(df: DataFrame, keys: list[str], order: str, value: Column | str, bucket: Column | None = None, folder: str | None = None) -> DataFrame:
    """``keys, pos, x, n, mean``, written: finite values numbered from 0 by ``order`` within ``bucket`` (by default its calendar month), with their number and mean."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "series")
    value = F.col(value) if isinstance(value, str) else value
    d = df.select(*keys, F.col(order).alias("_o"), value.cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    d = written(d, folder, "values")
    stats = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    p = positions(d, keys, ["_o", "x"], F.date_format("_o", "yyyyMM").cast("long") if bucket is None else bucket).drop("_o")
    return written(p.join(stats, keys), folder, "placed")


def long_run_variance(series: DataFrame, keys: list[str], lag: int) -> DataFrame:
    """``keys, n, mean, variance``: Bartlett-weighted variance of ``placed`` series up to ``lag``: sums of products of places k apart."""
    c = series.select(*keys, "pos", "n", "mean", (F.col("x") - F.col("mean")).alias("c"))
    own = c.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("c") * F.col("c")).alias("own"))
    if lag < 1:
        return own.select(*keys, "n", "mean", (F.col("own") / F.col("n")).alias("variance"))
    ahead = c.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(lag))).alias("_lag"), "pos", F.col("c").alias("_before")).withColumn("pos", F.col("pos") + F.col("_lag"))
    weight = 2 * (1 - F.col("_lag") / (lag + 1))
    cross = ahead.join(c.select(*keys, "pos", "c"), [*keys, "pos"]).groupBy(*keys).agg(F.sum(weight * F.col("_before") * F.col("c")).alias("cross"))
    return own.join(cross, keys, "left").select(*keys, "n", "mean", ((F.col("own") + F.coalesce("cross", F.lit(0.0))) / F.col("n")).alias("variance"))


def diebold_mariano(losses: DataFrame, keys: list[str], order: str, a: str, b: str, horizon: int = 1, bucket: Column | None = None) -> DataFrame:
    """``keys, stat, p, n``: one-sided test that A loses less than B, small-sample corrected; NaN where the variance is not positive or n below 2."""
    rows = long_run_variance(placed(losses, keys, order, F.col(a) - F.col(b), bucket), keys, horizon - 1).collect()  # a row a key
    out = []
    for r in rows:
        n, stat, p = r["n"], math.nan, math.nan
        if n >= 2 and r["variance"] > 0:
            stat = r["mean"] / math.sqrt(r["variance"] / n) * math.sqrt(max(n + 1 - 2 * horizon + horizon * (horizon - 1) / n, 0) / n)
            p = S.student_t_sf(-stat, n - 1)
        out.append((*(r[k] for k in keys), float(stat), float(p), n))
    fields = ", ".join(f"`{k}` {losses.schema[k].dataType.simpleString()}" for k in keys)
    return losses.sparkSession.createDataFrame(out, f"{fields + ', ' if keys else ''}stat double, p double, n long")


def geometric_blocks(n: int, block: float, seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the wrap-around blocks of one resample of n values; lengths are geometric with mean ``block``, the last one cut."""
    rng, starts, lengths, total = np.random.default_rng(seed), [], [], 0
    while total < n:
        more = rng.geometric(1 / block, int(n / block) + 8)
        starts.append(rng.integers(0, n, len(more)))
        lengths.append(more)
        total += int(more.sum())
    starts, lengths = np.concatenate(starts), np.concatenate(lengths)
    last = int(np.searchsorted(np.cumsum(lengths), n))
    starts, lengths = starts[: last + 1], lengths[: last + 1].copy()
    lengths[last] -= lengths.sum() - n
    return starts, lengths


def edges(n: int, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of leading values and signs whose prefix sums add up to the blocks' sums, wrapping around at n (centred values add up to 0 over a whole turn)."""
    return np.concatenate([starts, (starts + lengths) % n]), np.repeat([-1, 1], len(starts))


def stationary_bootstrap(series: DataFrame, keys: list[str], resamples: int = 10_000, block: float = 10.0, seed: int = 7) -> DataFrame:
    """``keys, p, mean, n``: p-value of a mean above 0 of ``placed`` series, from resampled means of the centred series; NaN for fewer than 2 values.

    Resamples are spread over tasks; each draws its blocks from (seed, key, resample), and the blocks' ends meet the prefix sums by (key, place).
    """
    spark = series.sparkSession
    ship(spark)
    folder = shared_folder(spark, "bootstrap")
    c = series.withColumn("c", F.col("x") - F.col("mean"))
    prefix = running_sum(c, keys, "pos", "c", "upto", F.floor(F.col("pos") / (1 << 16))).select(*keys, (F.col("pos") + 1).alias("at"), "upto")
    prefix = written(prefix, folder, "prefix")
    stats = written(series.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean")), folder, "stats")
    # a row a hundred resamples
    parts = stats.where("n > 1").select(*keys, "n", F.abs(F.xxhash64(F.lit("key"), *keys)).alias("h"), F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // 100))).alias("part"))
    fields = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)

    def draw(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                for i in range(row["part"] * 100, min(row["part"] * 100 + 100, resamples)):
                    at, sign = edges(row["n"], *geometric_blocks(row["n"], block, (seed, row["h"], i)))
                    yield pd.DataFrame({**{k: row[k] for k in keys}, "i": i, "at": at, "sign": sign})

    drawn = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "part").mapInPandas(draw, f"{fields + ', ' if keys else ''}i int, at long, sign int")
    met = drawn.where("at > 0").groupBy(*keys, "i", "at").agg(F.sum("sign").alias("sign")).join(prefix, [*keys, "at"])
    sums = met.groupBy(*keys, "i").agg(F.sum(F.col("sign") * F.col("upto")).alias("total"))
    hits = (sums.join(stats, keys) if keys else sums.join(stats)).where(F.col("total") / F.col("n") >= F.col("mean")).groupBy(*keys).agg(F.count("*").alias("hits"))
    # resamples whose ends cancel have a sum of 0
    seen = sums.groupBy(*keys).agg(F.count("*").alias("seen"))
    out = stats
    for extra in (hits, seen):
        out = out.join(extra, keys, "left") if keys else out.join(extra, how="left")
    silent = F.when(F.col("mean") <= 0, resamples - F.coalesce("seen", F.lit(0))).otherwise(0)
    p = F.when(F.col("n") > 1, (F.coalesce("hits", F.lit(0)) + silent + 1) / (resamples + 1)).otherwise(float("nan"))
    return out.select(*keys, p.alias("p"), "mean", "n")
