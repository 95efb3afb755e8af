"""Bars from ticks: time bars, dollar bars, order-flow bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import order_flow, pos_ln, sdiv, us


def time_bars(ticks: DataFrame, keys: list[str], width: str = "1 minute") -> DataFrame:
    """OHLC, volume, volume-weighted price (close where nothing traded) and count by key and time window; combined map-side."""
    unit = width.split(" ")[1].rstrip("s")
    start = F.date_trunc(unit, "ts") if width.startswith("1 ") else F.window("ts", width)["start"]
    agg = ticks.groupBy(*keys, start.alias("bar_ts")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"),
        F.sum("size").cast("double").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("_notional"), F.count("*").alias("n"),
    )
    return agg.withColumnRenamed("bar_ts", "ts").withColumn("wap", F.coalesce(sdiv("_notional", "volume"), F.col("close"))).drop("_notional")


def merge_bars(parts: DataFrame, keys: list[str], width: str) -> DataFrame:
    """Longer bars from shorter ones."""
    unit = width.split(" ")[1].rstrip("s")
    agg = parts.groupBy(*keys, F.date_trunc(unit, "ts").alias("bar_ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.col("wap") * F.col("volume")).alias("_notional"), F.sum("n").alias("n"),
    )
    return agg.withColumnRenamed("bar_ts", "ts").withColumn("wap", F.coalesce(sdiv("_notional", "volume"), F.col("close"))).drop("_notional")


def book_transitions(book: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Order flow, mid return and time since the book event before it, within a key (seams cut the chain)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = {c: F.lag(c).over(w) for c in ("bid", "bid_size", "ask", "ask_size")}
    m = (F.col("bid") + F.col("ask")) / 2
    df = book.withColumns({f"_p_{c}": x for c, x in prev.items()} | {"mid": m, "dt_us": us("ts") - us(F.lag("ts").over(w))})
    flow = order_flow(*[F.col(c) for c in ("bid", "bid_size", "ask", "ask_size", "_p_bid", "_p_bid_size", "_p_ask", "_p_ask_size")])
    p_mid = (F.col("_p_bid") + F.col("_p_ask")) / 2
    move = F.when((F.col("dt_us") > 0) & (p_mid > 0) & (m > 0), F.pow(pos_ln(m / p_mid), 2))
    imbalance = sdiv(F.col("_p_bid_size") - F.col("_p_ask_size"), F.col("_p_bid_size") + F.col("_p_ask_size"))
    return df.withColumns({"ofi": F.when(F.col("_p_bid").isNotNull(), flow).otherwise(0.0), "rv_part": move, "spread_dt": (F.col("_p_ask") - F.col("_p_bid")) * F.col("dt_us"), "imb_dt": imbalance * F.col("dt_us")}).drop("_p_bid", "_p_bid_size", "_p_ask", "_p_ask_size")


def flow_bars(transitions: DataFrame, keys: list[str], unit: str = "day") -> DataFrame:
    """Order-flow bars: summed imbalance, realised variance, time-weighted spread and queue imbalance, mid change."""
    g = transitions.groupBy(*keys, F.date_trunc(unit, "ts").alias("bar_ts")).agg(
        F.sum("ofi").alias("ofi"), F.sum("rv_part").alias("rv"), F.sum("spread_dt").alias("_s"), F.sum("imb_dt").alias("_i"), F.sum(F.when(F.col("imb_dt").isNotNull(), F.col("dt_us"))).alias("_t"),
        F.min_by("mid", "ts").alias("mid_open"), F.max_by("mid", "ts").alias("mid_close"), F.count("*").alias("n"),
    )
    return g.withColumnRenamed("bar_ts", "ts").withColumns({"twa_spread": sdiv("_s", "_t"), "twa_imbalance": sdiv("_i", "_t"), "dmid": F.col("mid_close") - F.col("mid_open")}).drop("_s", "_i", "_t")
