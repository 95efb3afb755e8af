"""Order-flow bars from book events, their causal histories, and labels inside a session block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite, sdiv, us
from . import labels as L
from .bars import book_transitions
from .recurrences import cusum, dollar_bar_ids, grouped


def book_bars(events: DataFrame, keys: list[str], threshold: float, multiplier: float = 1.0, tick: float = 0.25) -> DataFrame:
    """Dollar bars of book events (quotes and trades): prices, flow, book state and spreads, one row a bar.

    ``events(keys, ts, event_id, is_trade, price, size, sign, bid, bid_size, ask, ask_size)``; ``keys`` are the instrument and session, whose ends
    close a bar. A bar closes with the trade that takes its notional (price x size x multiplier) to the threshold; bars without trades are
    dropped; a session's last bar may be partial. Time-weighted means weigh the state before an event by the time since the event before it.
    """
    flow = book_transitions(events, keys, ["ts", "event_id"])

    def fold(p: pd.DataFrame) -> dict[str, np.ndarray]:
        ids, whole = dollar_bar_ids(np.where(p.is_trade, p.price * p["size"] * multiplier, 0.0), threshold)
        return {"bar_id": ids, "bar_complete": whole}

    numbered = grouped(flow, keys, ["ts", "event_id"], "bar_id long, bar_complete boolean", fold)
    inside = Window.partitionBy(*keys, "bar_id").orderBy("ts", "event_id")
    state = {c: F.lag(x).over(inside) for c, x in {"_spread": (F.col("ask") - F.col("bid")) / tick, "_imb": sdiv(F.col("bid_size") - F.col("ask_size"), F.col("bid_size") + F.col("ask_size")), "_depth": F.col("bid_size") + F.col("ask_size")}.items()}
    d = numbered.withColumns(state | {"_dt": us("ts") - us(F.lag("ts").over(inside)), "_at": F.struct("ts", "event_id")})
    d = d.withColumn("_move", F.when((F.col("_dt") > 0) & finite("rv_part"), F.col("rv_part")))
    trade = lambda x: F.when(F.col("is_trade"), x)
    means = {f"{name}_twa": sdiv(F.sum(F.col(c) * F.col("_dt")), F.sum("_dt")) for name, c in (("spread", "_spread"), ("imbalance", "_imb"), ("depth", "_depth"))}
    g = d.groupBy(*keys, "bar_id", "bar_complete").agg(
        F.min("ts").alias("ts_open"), F.max("ts").alias("ts"), F.min_by(trade(F.col("price")), trade(F.col("_at"))).alias("open"), F.max(trade(F.col("price"))).alias("high"), F.min(trade(F.col("price"))).alias("low"),
        F.max_by(trade(F.col("price")), trade(F.col("_at"))).alias("close"), F.sum(trade(F.col("size"))).cast("double").alias("volume"), F.sum(trade(F.col("price") * F.col("size"))).alias("_notional"),
        F.sum(trade(F.col("size") * F.col("sign"))).cast("double").alias("signed_vol"), F.count(trade(F.lit(1))).alias("n_trades"), F.count("*").alias("n_events"), F.sum("ofi").alias("ofi_top"),
        F.min_by("mid", "_at").alias("mid_open"), F.max_by("mid", "_at").alias("mid_close"), F.sum("_move").alias("_rv"), *[v.alias(k) for k, v in means.items()],
    ).where("n_trades > 0")
    return assemble(g.withColumn("dollar_volume", F.col("_notional") * multiplier))


def assemble(raw: DataFrame) -> DataFrame:
    """Ratios of raw bar sums: vwap, trade imbalance, mid change and return, realised deviation, duration; null where undefined."""
    ret = F.when((F.col("mid_open") > 0) & (F.col("mid_close") > 0), F.ln(F.col("mid_close") / F.col("mid_open")))
    return raw.withColumns({
        "vwap": sdiv("_notional", "volume"), "trade_imbalance": sdiv("signed_vol", "volume"), "dmid": F.col("mid_close") - F.col("mid_open"), "ret_bar": ret,
        "rv_intrabar": F.sqrt(F.coalesce("_rv", F.lit(0.0))), "duration_s": (us("ts") - us("ts_open")) / 1e6,
    }).drop("_notional", "_rv")


def flow_history(bars: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Last bar's flow and sums over the last n bars of a contract, however few there are."""
    w = Window.partitionBy(*keys).orderBy("ts")
    frame = w.rowsBetween(1 - n, 0)
    return bars.withColumns({"ofi_top_lag1": F.lag("ofi_top").over(w), f"ofi_top_roll{n}": F.sum("ofi_top").over(frame), f"signed_vol_roll{n}": F.sum("signed_vol").over(frame)})


def block_sigma(bars: DataFrame, keys: list[str], span: int = 50, least: int = 20, duration_span: int = 50, horizon_s: float = 1800.0, mid: str = "mid_close", duration: str = "duration_s") -> DataFrame:
    """``r`` and ``sigma`` inside a block: the debiased exponential deviation of mid returns, scaled by the root of bars in the horizon."""

    def fold(p: pd.DataFrame) -> dict[str, np.ndarray]:
        r = np.log(p[mid].astype(float)).diff()
        per_bar = p[duration].astype(float).ewm(span=duration_span, adjust=False, min_periods=1).mean()
        sigma = r.ewm(span=span, adjust=False, min_periods=least).std(bias=False) * np.sqrt(horizon_s / per_bar)
        clean = lambda x: np.where(np.isfinite(x), x, None)
        return {"r": clean(r.to_numpy()), "sigma": clean(sigma.to_numpy())}

    return grouped(bars, keys, ["ts"], "r double, sigma double", fold)


def micro_labels(bars: DataFrame, keys: list[str], minutes: int = 30, mult: float = 0.5, up: float = 1.5, down: float = 1.5, sign_timeouts: bool = False, close_at: str | None = None, **sigma: float) -> DataFrame:
    """Labels of a session's bars: CUSUM events on mid returns against ``mult`` sigmas, barriers inside the block, uniqueness weights."""
    b = block_sigma(bars, keys, horizon_s=minutes * 60.0, **sigma)
    fired = grouped(b, keys, ["ts"], "fired boolean", lambda p: {"fired": cusum(np.nan_to_num(p.r.astype(float).to_numpy()), p.sigma.astype(float).to_numpy() * mult)})
    price = [F.col("mid_close").alias("close")]
    events = fired.where("fired").select(*keys, "ts", *price, "sigma", *([close_at] if close_at else []))
    out = L.session_barrier(b.select(*keys, "ts", *price), events, minutes, up, down, sign_timeouts, tuple(keys), close_at)
    place = b.select(*keys, "ts", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")).alias("pos"))
    for name, at in (("pos0", "t0"), ("pos1", "t1")):
        out = out.join(place.select(*keys, F.col("ts").alias(at), F.col("pos").alias(name)), [*keys, at])
    return L.uniqueness(out, tuple(keys)).drop("pos0", "pos1")


