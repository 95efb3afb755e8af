"""Price, volume and technical features as window expressions over bars (symbol, ts, open, high, low, close, volume).

Functions take the columns to partition by, and ``cut`` runs any of them over (symbol, block of rows) instead of a symbol's whole history.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pos_ln, sdiv, trade_date
from .recurrences import Ewm, ewm, span, wilder
from .windows import blocked, guarded, rmean, rows, rstd

K = ["symbol"]


def cut(df: DataFrame, halo: int, compute: Callable[[DataFrame, list[str]], DataFrame], keys: list[str] = K) -> DataFrame:
    """``compute(df, keys)``, whose windows reach ``halo`` rows back, in blocks of bounded size (``windows.blocked``)."""
    return blocked(df, keys, ["ts"], halo, compute, F.to_date("ts"))


def base(df: DataFrame, keys: list[str] = K) -> DataFrame:
    """Log close, true range, one-bar return."""
    w = Window.partitionBy(*keys).orderBy("ts")
    prev = F.lag("close").over(w)
    df = df.withColumns({"logc": pos_ln("close"), "prev_close": prev})
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close")))
    return df.withColumns({"true_range": tr, "ret_1": F.col("logc") - F.lag("logc").over(w)})


def returns(df: DataFrame, horizons: tuple[int, ...] = (1, 5, 15, 30, 60), keys: list[str] = K) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts")
    return df.withColumns({f"ret_{h}": pos_ln("close") - F.lag(pos_ln("close"), h).over(w) for h in horizons})


def roc(df: DataFrame, horizons: tuple[int, ...] = (15, 60), keys: list[str] = K) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts")
    return df.withColumns({f"roc_{h}": sdiv("close", F.lag("close", h).over(w)) - 1 for h in horizons})


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0, keys: list[str] = K) -> DataFrame:
    w = rows(keys, "ts", n)
    m, s = rmean("close", w, n), rstd("close", w, n, ddof=0)
    return df.withColumn(f"bb_pctb_{n}", sdiv(F.col("close") - (m - s * width), s * 2 * width))


def zscore(df: DataFrame, x: str, n: int, out: str, keys: list[str] = K, least: int | None = None) -> DataFrame:
    w = rows(keys, "ts", n)
    return df.withColumn(out, sdiv(F.col(x) - rmean(x, w, least or n), rstd(x, w, least or n)))


def realised_vol(df: DataFrame, spans: tuple[int, ...] = (15, 60, 390), keys: list[str] = K) -> DataFrame:
    return df.withColumns({f"rv_{n}": rstd("ret_1", rows(keys, "ts", n), n) for n in spans})


def range_vols(df: DataFrame, n: int = 30, keys: list[str] = K) -> DataFrame:
    """Parkinson and Garman-Klass volatilities."""
    hl, co = F.pow(pos_ln(sdiv("high", "low")), 2), F.pow(pos_ln(sdiv("close", "open")), 2)
    df = df.withColumns({"_hl": hl, "_gk": 0.5 * hl - (2 * math.log(2) - 1) * co})
    w = rows(keys, "ts", n)
    out = {f"parkinson_{n}": F.sqrt(rmean("_hl", w, n) / (4 * math.log(2))), f"gk_{n}": F.sqrt(F.greatest(rmean("_gk", w, n), F.lit(0.0)))}
    return df.withColumns(out).drop("_hl", "_gk")


def vol_regime(df: DataFrame, vol: str, n: int, least: int, keys: list[str] = K) -> DataFrame:
    """Volatility over its rolling median."""
    return df.withColumn("vol_regime", sdiv(vol, guarded(lambda x: F.percentile(x, 0.5), vol, rows(keys, "ts", n), least)))


def relative_volume(df: DataFrame, spans: tuple[int, ...] = (30, 390), keys: list[str] = K) -> DataFrame:
    return df.withColumns({f"rvol_{n}": sdiv("volume", rmean("volume", rows(keys, "ts", n), n)) for n in spans})


def time_of_day_volume(df: DataFrame, slot: Column, days: int = 20, keys: list[str] = K) -> DataFrame:
    """Volume over the mean of the last ``days`` volumes of the same time of day, the current one left out."""
    df = df.withColumn("_slot", slot)
    w = Window.partitionBy(*keys, "_slot").orderBy("ts").rowsBetween(-days, -1)
    return df.withColumn("rvol_tod", sdiv("volume", F.avg("volume").over(w))).drop("_slot")


def signed_volume(df: DataFrame, n: int = 60, keys: list[str] = K) -> DataFrame:
    df = df.withColumn("_sv", F.coalesce(F.signum("ret_1"), F.lit(0.0)) * F.col("volume"))
    w = rows(keys, "ts", n)
    return df.withColumn(f"obv_norm_{n}", sdiv(guarded(F.sum, "_sv", w, n), guarded(F.sum, "volume", w, n))).drop("_sv")


def vwap_distance(df: DataFrame, keys: list[str] = K) -> DataFrame:
    """Close over the volume-weighted price since the trade date began."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumns({"_day": trade_date("ts"), "_pv": typical * F.col("volume")})
    w = Window.partitionBy(*keys, "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("vwap_dist", sdiv("close", sdiv(F.sum("_pv").over(w), F.sum("volume").over(w))) - 1).drop("_day", "_pv")


def correlation(df: DataFrame, x: str, y: str, n: int, out: str, keys: list[str] = K) -> DataFrame:
    """Rolling Pearson correlation over the last n rows, all n needed."""
    w = rows(keys, "ts", n)
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    mx, my = F.avg(F.when(both == 1, F.col(x))).over(w), F.avg(F.when(both == 1, F.col(y))).over(w)
    cov = F.avg(F.col(x) * F.col(y)).over(w) - mx * my
    vx = F.avg(F.when(both == 1, F.col(x) * F.col(x))).over(w) - mx * mx
    vy = F.avg(F.when(both == 1, F.col(y) * F.col(y))).over(w) - my * my
    return df.withColumn(out, F.when(F.count(both).over(w) >= n, sdiv(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))))


def stochastic(df: DataFrame, n: int = 14, d: int = 3, keys: list[str] = K) -> DataFrame:
    w = rows(keys, "ts", n)
    low, high = guarded(F.min, "low", w, n), guarded(F.max, "high", w, n)
    df = df.withColumn("stoch_k", 100 * sdiv(F.col("close") - low, high - low))
    return df.withColumn("stoch_d", rmean("stoch_k", rows(keys, "ts", d), d))


def cci(df: DataFrame, n: int = 20, keys: list[str] = K) -> DataFrame:
    """Commodity channel index; the deviation is the mean of each bar's own distance to its own mean."""
    w = rows(keys, "ts", n)
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_sma", rmean("_tp", w, n)).withColumn("_dev", F.abs(F.col("_tp") - F.col("_sma")))
    return df.withColumn("cci", sdiv(F.col("_tp") - F.col("_sma"), 0.015 * rmean("_dev", w, n))).drop("_tp", "_sma", "_dev")


def mfi(df: DataFrame, n: int = 14, keys: list[str] = K) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts")
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumn("_d", F.col("_tp") - F.lag("_tp").over(w))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumns({"_up": F.when(F.col("_d").isNotNull(), F.when(F.col("_d") > 0, flow).otherwise(0.0)), "_dn": F.when(F.col("_d").isNotNull(), F.when(F.col("_d") < 0, flow).otherwise(0.0))})
    frame = rows(keys, "ts", n)
    up, dn = guarded(F.sum, "_up", frame, n), guarded(F.sum, "_dn", frame, n)
    return df.withColumn("mfi", 100 * sdiv(up, up + dn)).drop("_tp", "_d", "_up", "_dn")


def vortex(df: DataFrame, n: int = 14, keys: list[str] = K) -> DataFrame:
    w, frame = Window.partitionBy(*keys).orderBy("ts"), rows(keys, "ts", n)
    df = df.withColumns({"_p": F.abs(F.col("high") - F.lag("low").over(w)), "_m": F.abs(F.col("low") - F.lag("high").over(w)), "_t": F.when(F.lag("close").over(w).isNotNull(), F.col("true_range"))})
    t = guarded(F.sum, "_t", frame, n)
    return df.withColumns({"vortex_pos": sdiv(guarded(F.sum, "_p", frame, n), t), "vortex_neg": sdiv(guarded(F.sum, "_m", frame, n), t)}).drop("_p", "_m", "_t")


FAMILIES = ("macd", "rsi", "atr", "adx", "trix")


def smoothed(df: DataFrame, families: tuple[str, ...] = FAMILIES, keys: list[str] = K) -> DataFrame:
    """Indicators made of exponential means, of bars with ``base`` columns: MACD 12/26/9 with slopes and z-scored distances of both means of the
    log close, Wilder's RSI, ATR and ADX of 14, TRIX of 15.

    All first-order means go in one pass, the means of their results in a second, the third mean of TRIX in a last: each pass reads its input
    twice, so passes are what to save. RSI is 100 where there is gain and no loss, null where neither.
    """
    has = lambda f: f in families
    n, m = 14, wilder(14)

    def moves(d: DataFrame, k: list[str]) -> DataFrame:
        w = Window.partitionBy(*k).orderBy("ts")
        c, up, dn = F.col("close") - F.lag("close").over(w), F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
        out = {"_g": F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))), "_l": F.when(c.isNotNull(), F.greatest(-c, F.lit(0.0)))} if has("rsi") else {}
        return d.withColumns(out | ({"_pdm": F.when((up > dn) & (up > 0), up).otherwise(0.0), "_mdm": F.when((dn > up) & (dn > 0), dn).otherwise(0.0)} if has("adx") else {}))

    if has("rsi") or has("adx"):
        df = cut(df, 1, moves, keys)
    first = [Ewm("_e12", "logc", span(12), 12), Ewm("_e26", "logc", span(26), 26)] * has("macd") + [Ewm("_ag", "_g", m, n), Ewm("_al", "_l", m, n)] * has("rsi") + [Ewm("_tr", "true_range", m, n)] * (has("atr") or has("adx"))
    first += [Ewm("_p", "_pdm", m, n), Ewm("_m", "_mdm", m, n)] * has("adx") + [Ewm("_t1", "logc", span(15), 15)] * has("trix")
    df = ewm(df, keys, "ts", first)
    out = {"macd": F.col("_e12") - F.col("_e26")} if has("macd") else {}
    out |= {"rsi_14": 100 * sdiv("_ag", F.col("_ag") + F.col("_al"))} if has("rsi") else {}
    out |= {"atr_pct_14": sdiv("_tr", "close")} if has("atr") else {}
    if has("adx"):
        plus, minus = 100 * sdiv("_p", "_tr"), 100 * sdiv("_m", "_tr")
        out |= {"plus_di": plus, "minus_di": minus, "_dx": 100 * sdiv(F.abs(plus - minus), plus + minus)}
    df = df.withColumns(out) if out else df
    second = [Ewm("macd_signal", "macd", span(9), 9)] * has("macd") + [Ewm("adx_14", "_dx", m, n)] * has("adx") + [Ewm("_t2", "_t1", span(15), 15)] * has("trix")
    df = ewm(df, keys, "ts", second) if second else df
    df = ewm(df, keys, "ts", [Ewm("_t3", "_t2", span(15), 15)]) if has("trix") else df

    def tail(d: DataFrame, k: list[str]) -> DataFrame:
        w = Window.partitionBy(*k).orderBy("ts")
        if has("trix"):
            d = d.withColumn("trix_15", F.col("_t3") - F.lag("_t3").over(w))
        if has("macd"):
            d = d.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
            for s in (12, 26):
                d = d.withColumns({f"ema_slope_{s}": F.col(f"_e{s}") - F.lag(f"_e{s}", 5).over(w), "_d": F.col("logc") - F.col(f"_e{s}")})
                d = d.withColumn(f"ema_dist_z_{s}", sdiv("_d", rstd("_d", rows(k, "ts", s), s)))
        return d

    df = cut(df, 26, tail, keys) if has("macd") or has("trix") else df
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def ema_macd(df: DataFrame, keys: list[str] = K) -> DataFrame:
    return smoothed(df, ("macd",), keys)


def rsi(df: DataFrame, keys: list[str] = K) -> DataFrame:
    return smoothed(df, ("rsi",), keys)


def atr(df: DataFrame, keys: list[str] = K) -> DataFrame:
    return smoothed(df, ("atr",), keys)


def adx(df: DataFrame, keys: list[str] = K) -> DataFrame:
    return smoothed(df, ("adx",), keys)


def trix(df: DataFrame, keys: list[str] = K) -> DataFrame:
    return smoothed(df, ("trix",), keys)
