"""Futures contracts: front month, rolls, back-adjusted continuous series. ``keys`` (a symbol) keep several products apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import sdiv
from .asof import asof_join


def daily_volume(bars: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Volume a day and contract."""
    return bars.groupBy(*keys, F.to_date("ts").alias("date"), "contract_id").agg(F.sum("volume").alias("volume"), F.first("con_id").alias("con_id"), F.max("expiry").alias("expiry"))


def front_month(daily: DataFrame, days_to_expiry: int = 5, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys, date, front``: the nearest unexpired contract, or the next one where that out-trades it or the nearest expires within N days.

    Derived from all contracts of the day anew, so a roll can flip back.
    """
    w = Window.partitionBy(*keys, "date").orderBy("expiry", "contract_id")
    live = daily.where("expiry >= date").withColumns({"_r": F.row_number().over(w), "_next": F.lead("contract_id").over(w), "_next_volume": F.lead("volume").over(w)})
    roll = F.col("_next").isNotNull() & ((F.col("_next_volume") > F.col("volume")) | (F.datediff("expiry", "date") <= days_to_expiry))
    return live.where("_r = 1").select(*keys, "date", F.when(roll, F.col("_next")).otherwise(F.col("contract_id")).alias("front"))


def rolls(front: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys, roll_date, from_contract, to_contract`` where the front month changes. A row a trading day and product: small windows."""
    w = Window.partitionBy(*keys).orderBy("date")
    return front.withColumn("prev", F.lag("front").over(w)).where("prev <> front").select(*keys, F.col("date").alias("roll_date"), F.col("prev").alias("from_contract"), F.col("front").alias("to_contract"))


def _around(rolls_: DataFrame, bars: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Rolls with the last close before their date of the contract named by ``before`` and the first one from it on of that by ``after``
    (columns of ``rolls_``; '' for any contract): two as-of joins, however far apart the bars lie."""
    r = rolls_.withColumn("_at", F.col("roll_date").cast("timestamp"))
    for name, contract, forward in (("old_close", before, False), ("new_close", after, True)):
        by = [*keys, *(["contract_id"] if contract else [])]
        left = r.withColumn("contract_id", F.col(contract)) if contract else r
        r = asof_join(left, bars.select(*by, "ts", F.col("close").alias(name)), on="_at", right_on="ts", by=by, take=[name], forward=forward, strict=not forward, prefix="", bucket_us=30 * 86_400_000_000)
        r = r.drop("contract_id") if contract else r
    return r.drop("_at")


def seams(bars: DataFrame, rolls_: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Last close of the old contract before each roll, first close of the new one from it on."""
    return _around(rolls_, bars, keys, "from_contract", "to_contract")


def continuous(bars: DataFrame, rolls_: DataFrame, adjustment: str = "ratio", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Front-month bars with prices adjusted backward over the seams; ``raw_close`` keeps the price, ``adj_factor`` the factor (ratio) or offset (panama).

    A seam with a missing side starts the chain anew there: segments before it are adjusted from it on only. Products without rolls pass whole.
    """
    if adjustment not in ("ratio", "panama"):
        raise ValueError(adjustment)
    none = 1.0 if adjustment == "ratio" else 0.0
    s = seams(bars, rolls_, keys)
    s = s.withColumn("step", sdiv("new_close", "old_close") if adjustment == "ratio" else F.col("new_close") - F.col("old_close"))
    later = Window.partitionBy(*keys).orderBy(F.desc("roll_date")).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("chain", F.sum(F.when(F.col("step").isNull(), 1).otherwise(0)).over(later))
    inside = Window.partitionBy(*keys, "chain").orderBy(F.desc("roll_date")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.exp(F.sum(F.ln("step")).over(inside)) if adjustment == "ratio" else F.sum("step").over(inside)
    s = s.withColumn("factor", F.when(F.col("step").isNull(), none).otherwise(total))
    # segments: [previous roll, this roll) trades from_contract with the factor of this roll; the last one is unadjusted
    order = Window.partitionBy(*keys).orderBy("roll_date")
    own = [F.col(k).alias(f"_k_{k}") for k in keys]
    segments = s.select(*own, F.col("from_contract").alias("_contract"), F.lag("roll_date").over(order).alias("_start"), F.col("roll_date").alias("_end"), "factor")
    last = s.groupBy(*own).agg(F.max_by("to_contract", "roll_date").alias("_contract"), F.max("roll_date").alias("_start"))
    last = last.select(*[f"_k_{k}" for k in keys], "_contract", "_start", F.lit(None).cast("date").alias("_end"), F.lit(none).alias("factor")).where("_start is not null")
    segments, day = segments.unionByName(last), F.to_date("ts")
    same = F.col("contract_id") == F.col("_contract")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    hit = bars.join(segments, same & (F.col("_start").isNull() | (day >= F.col("_start"))) & (F.col("_end").isNull() | (day < F.col("_end")))).select(*bars.columns, "factor")
    if keys:
        rest = bars.join(rolls_.select(*keys).distinct(), keys, "left_anti").select(*bars.columns)
    else:
        rest = bars.where(F.lit(rolls_.isEmpty()))
    out = hit.unionByName(rest.withColumn("factor", F.lit(none))).withColumn("raw_close", F.col("close"))
    adjust = (lambda c: F.col(c) * F.col("factor")) if adjustment == "ratio" else (lambda c: F.col(c) + F.col("factor"))
    return out.withColumns({c: adjust(c) for c in ("open", "high", "low", "close") if c in bars.columns}).withColumnRenamed("factor", "adj_factor")


def seam_gaps(cont: DataFrame, rolls_: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Relative jump of the adjusted close over each roll: from the last bar before it, however old, to the first from it on."""
    return _around(rolls_.select(*keys, "roll_date"), cont, keys, "", "").select(*keys, "roll_date", (sdiv("new_close", "old_close") - 1).alias("gap"))
