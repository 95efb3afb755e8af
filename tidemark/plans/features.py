"""Feature sets: configuration, generated column names, and the composition of all families."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import sdiv, time_features
from ..operators import indicators as I
from ..operators.asof import DAY_US, asof_join
from ..operators.windows import positions


@dataclass(frozen=True)
class FeatureConfig:
    """The default spans of the price and technical families."""

    returns: tuple[int, ...] = (1, 5, 15, 30, 60)
    roc: tuple[int, ...] = (15, 60)
    zscores: tuple[int, ...] = (30, 120)
    vols: tuple[int, ...] = (15, 60, 390)
    ranges: int = 30
    rvols: tuple[int, ...] = (30, 390)
    volume_z: int = 390
    obv: int = 60
    regime: tuple[int, int] = (1380, 60)
    warmup: int = 4140
    version: str = "v1"
    pair: tuple[str, str] | None = None  # two symbols that see each other; ratios are the second's price over the first's
    pair_ratio: int = 390
    pair_corr: int = 60

    @classmethod
    def load(cls, values: dict) -> FeatureConfig:
        """From plain values; unknown names are an error."""
        known = {f.name for f in fields(cls)}
        if bad := sorted(set(values) - known):
            raise ValueError(f"unknown settings: {', '.join(bad)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def feature_names(c: FeatureConfig) -> list[str]:
    """The columns of a feature table, in their fixed order."""
    return [
        *(f"ret_{h}" for h in c.returns), *(f"roc_{h}" for h in c.roc), "macd", "macd_signal", "macd_hist", "ema_slope_12", "ema_dist_z_12", "ema_slope_26", "ema_dist_z_26", "adx_14", "rsi_14", "bb_pctb_20",
        *(f"zscore_{n}" for n in c.zscores), *(f"rv_{n}" for n in c.vols), "atr_pct_14", f"parkinson_{c.ranges}", f"gk_{c.ranges}", "vol_regime", *(f"rvol_{n}" for n in c.rvols), "rvol_tod", f"vol_z_{c.volume_z}", f"obv_norm_{c.obv}", "vwap_dist",
        "stoch_k", "stoch_d", "cci", "mfi", "vortex_pos", "vortex_neg", "trix_15", "mod_sin", "mod_cos", "dow_sin", "dow_cos", "mins_since_open", "mins_to_close",
    ]


def pair_names(c: FeatureConfig) -> list[str]:
    return ["xa_ret_spread", f"xa_ratio_z_{c.pair_ratio}", f"xa_corr_{c.pair_corr}"] if c.pair else []


def paired(df: DataFrame, c: FeatureConfig) -> DataFrame:
    """``symbol, ts`` and ``pair_names`` of the pair's rows: each with the other's return and raw price as of its time (close / adj_factor where there is one).

    The spread of returns is the second symbol's less the first's on either side, the ratio likewise; ``df`` has ``ret_1``, one row a (symbol, ts).
    """
    first, second = c.pair
    raw = sdiv("close", "adj_factor") if "adj_factor" in df.columns else F.col("close").cast("double")
    slim = df.where(F.col("symbol").isin(first, second)).select("symbol", "ts", "ret_1", raw.alias("_raw"))
    other = slim.select(F.when(F.col("symbol") == first, second).otherwise(first).alias("symbol"), "ts", F.col("ret_1").alias("ret"), F.col("_raw").alias("raw"))
    j = asof_join(slim, other, by=["symbol"], take=["ret", "raw"], prefix="_o_", bucket_us=7 * DAY_US)
    up = F.col("symbol") == second
    j = j.withColumns({"xa_ret_spread": F.when(up, F.col("ret_1") - F.col("_o_ret")).otherwise(F.col("_o_ret") - F.col("ret_1")), "_ratio": F.when(up, sdiv("_raw", "_o_raw")).otherwise(sdiv("_o_raw", "_raw"))})
    _, z, corr = pair_names(c)
    j = I.cut(j, max(c.pair_ratio, c.pair_corr), lambda d, k: I.correlation(I.zscore(d, "_ratio", c.pair_ratio, z, keys=k), "ret_1", "_o_ret", c.pair_corr, corr, keys=k))
    return j.select("symbol", "ts", *pair_names(c))


def compute_features(bars: DataFrame, c: FeatureConfig, degraded_dates: tuple[str, ...] = ()) -> DataFrame:
    """All price, volume, technical and time features of bars, with the degraded flag and the version.

    All windows of finite reach share one partitioning by (symbol, block), so the bars are shuffled once for them; the time-of-day mean is by
    (symbol, time of day), the session price by (symbol, day); exponential means add their block passes. With ``c.pair`` the columns of ``paired`` follow.
    Bars of spreads (a ``contract_id`` with '-') are an error.
    """
    missing = [x for x in ("symbol", "ts", "open", "high", "low", "close", "volume") if x not in bars.columns]
    if missing:
        raise ValueError(f"bars need {', '.join(missing)}")
    if "contract_id" in bars.columns and not bars.where(F.contains("contract_id", F.lit("-"))).isEmpty():
        raise ValueError("bars of spreads must not reach the features")
    df = I.smoothed(I.cut(bars, 1, I.base))

    def framed(df: DataFrame, k: list[str]) -> DataFrame:
        df = I.bollinger(I.roc(I.returns(df, c.returns, k), c.roc, k), keys=k)
        for n in c.zscores:
            df = I.zscore(df, "close", n, f"zscore_{n}", k)
        df = I.range_vols(I.realised_vol(df, c.vols, k), c.ranges, k)
        df = I.relative_volume(I.vol_regime(df, f"rv_{c.vols[min(1, len(c.vols) - 1)]}", *c.regime, k), c.rvols, k)
        df = I.signed_volume(I.zscore(df, "volume", c.volume_z, f"vol_z_{c.volume_z}", k), c.obv, k)
        return I.vortex(I.mfi(I.cci(I.stochastic(df, keys=k), keys=k), keys=k), keys=k)

    reach = max(*c.returns, *c.roc, *c.zscores, c.ranges, *c.rvols, c.volume_z, c.obv, max(c.vols) + c.regime[0], 40) + 1
    df = I.vwap_distance(I.time_of_day_volume(I.cut(df, reach, framed), F.date_format("ts", "HH:mm")))
    if c.pair:  # from the bars, so that the features above are computed once
        df = df.join(paired(I.cut(bars.where(F.col("symbol").isin(*c.pair)), 1, I.base), c), ["symbol", "ts"], "left")
    df = df.withColumns(time_features("ts"))
    df = positions(df, ["symbol"], ["ts"], F.to_date("ts"))
    first = F.col("pos") < c.warmup
    bad = F.date_format("ts", "yyyy-MM-dd").isin(*degraded_dates) if degraded_dates else F.lit(False)
    return df.select("symbol", "ts", *feature_names(c), *pair_names(c), (first | bad).alias("degraded"), F.lit(c.version).alias("feature_version"))
