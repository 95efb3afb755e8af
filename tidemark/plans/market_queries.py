"""Queries over bars: roll-ups, as-of joins, window features, recurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import asof as A
from ..operators import bars as B
from ..operators import indicators as I
from ..operators import recurrences as R
from ..operators.windows import half_open_us
from ..sources.lake import latest_ingest, new_rows
from .domain import BARS_SQL, TICKS_SQL, Catalogue, bars, table, ticks
from .features import FeatureConfig, pair_names, paired

catalogue = Catalogue()
add = catalogue.add

Q = f"with {BARS_SQL}"
BASE_SQL = (
    BARS_SQL
    + """, b as (
  select *, ln(close) as logc, lag(close) over s as prev_close, row_number() over s as rn,
    greatest(high - low, abs(high - lag(close) over s), abs(low - lag(close) over s)) as tr0, ln(close) - lag(ln(close)) over s as ret_1
  from bars window s as (partition by symbol order by ts)
), base as (select *, coalesce(tr0, high - low) as true_range from b)"""
)
QB = f"with {BASE_SQL}"


def frame(n: int) -> str:
    return f"partition by symbol order by ts rows between {n - 1} preceding and current row"


def g(agg: str, x: str, n: int, least: int | None = None) -> str:
    """An aggregate over n rows that needs ``least`` values."""
    return f"case when count({x}) over ({frame(n)}) >= {least or n} then {agg}({x}) over ({frame(n)}) end"


def recursion(name: str, source: str, columns: dict[str, tuple[str, float]], start: int = 1) -> str:
    """A recursive CTE of exponential means of columns of ``source`` (symbol, rn)."""
    seed = ", ".join(f"({x})::double as {k}" for k, (x, _) in columns.items())
    step = ", ".join(f"{1 - a!r} * p.{k} + {a!r} * (s.{x})" for k, (x, a) in columns.items())
    return f"{name} as (select symbol, rn, {seed} from {source} where rn = {start} union all select s.symbol, s.rn, {step} from {name} p join {source} s on s.symbol = p.symbol and s.rn = p.rn + 1)"


QR = QB.replace("with ", "with recursive ", 1)


@add(Q + " select symbol, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume, round(wap, 6) as wap, n from bars")
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir)


@add(f"""with {TICKS_SQL} select symbol, date_trunc('day', ts) as ts, round(arg_min(price, ts), 6) as open, round(max(price), 6) as high, round(min(price), 6) as low, round(arg_max(price, ts), 6) as close,
  round(sum(size)::double, 6) as volume, round(sum(price * size) / sum(size), 6) as wap, count(*)::bigint as n from t group by 1, 2""")
def bars_daily_from_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.merge_bars(bars(spark, sf_dir), ["symbol"], "1 day")


@add("""with e as (select event_id, event_type, round(value, 6) as value, 1 as ingest from events union all select event_id, event_type, round(value + 1, 6), 2 from events where event_id % 3 = 0)
select event_id, event_type, value, ingest from (select *, row_number() over (partition by event_id order by ingest desc) as r from e) where r = 1""")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    again = e.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1).withColumn("ingest", F.lit(2))
    return latest_ingest(e.withColumn("ingest", F.lit(1)).unionByName(again), ["event_id"], "ingest")


@add("select o_orderkey, o_custkey from orders n where not exists (select 1 from orders e where e.o_orderkey = n.o_orderkey and e.o_orderkey % 4 <> 0)")
def key_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return new_rows(o, o.where("o_orderkey % 4 <> 0"), ["o_orderkey"])


LOCAL = "(ts at time zone 'UTC') at time zone 'America/New_York'"


@add(f"with e as (select event_id, {LOCAL} as l from events) select event_id, case when isodow(l) < 6 and hour(l) * 60 + minute(l) >= 570 and hour(l) * 60 + minute(l) < 960 then 'RTH' else 'ETH' end as session from e")
def session_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.session_tag("ts").alias("session"))


@add(f"with e as (select event_id, {LOCAL} as l from events) select event_id, (l::date + case when hour(l) >= 18 then 1 else 0 end)::date as trade_date from e")
def trade_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.trade_date("ts").alias("trade_date"))


@add(f"""with e as (select event_id, {LOCAL} as l from events), m as (select event_id, (hour(l) * 60 + minute(l))::bigint as m, (isodow(l) - 1)::bigint as d from e)
select event_id, round(sin(m * (2 * 3.141592653589793 / 1440)), 6) as mod_sin, round(cos(m * (2 * 3.141592653589793 / 1440)), 6) as mod_cos, round(sin(d * (2 * 3.141592653589793 / 7)), 6) as dow_sin,
  round(cos(d * (2 * 3.141592653589793 / 7)), 6) as dow_cos, (m - 570)::int as mins_since_open, (960 - m)::int as mins_to_close from m""")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in X.time_features("ts").items()])


@add(Q + " select symbol, ts, (row_number() over (partition by symbol order by ts) - 1 < 60 or ts::date in (date '2024-01-05', date '2024-01-12')) as degraded from bars")
def degraded_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1 < 60
    dates = F.to_date("ts").isin(F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date"))
    return bars(spark, sf_dir).select("symbol", "ts", (first | dates).alias("degraded"))


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "ts", "user_id", "value")


SIDES = "l as (select event_id, ts, user_id from events where event_type = 'click'), r as (select ts as rts, event_id as rid, value, user_id as ruser from events where event_type = 'purchase')"


@add(f"with {SIDES} select l.event_id, r.rid as r_event_id, round(r.value, 6) as r_value from l asof left join r on l.ts >= r.rts")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.asof_join(_kind(spark, sf_dir, "click").drop("value"), _kind(spark, sf_dir, "purchase"), take=["event_id", "value"]).select("event_id", "r_event_id", "r_value")


@add(f"with {SIDES} select l.event_id, r.rid as r_event_id, round(r.value, 6) as r_value from l asof left join r on l.user_id = r.ruser and l.ts >= r.rts")
def asof_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.asof_join(_kind(spark, sf_dir, "click").drop("value"), _kind(spark, sf_dir, "purchase"), by=["user_id"], take=["event_id", "value"]).select("event_id", "r_event_id", "r_value")


@add(f"with {SIDES} select l.event_id, r.rid as r_event_id from l asof left join r on l.ts <= r.rts")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.asof_join(_kind(spark, sf_dir, "click").drop("value"), _kind(spark, sf_dir, "purchase"), take=["event_id"], forward=True).select("event_id", "r_event_id")


@add(f"with {SIDES} select l.event_id, case when l.ts::date = r.rts::date then round(r.value, 6) end as r_value from l asof left join r on l.ts >= r.rts")
def asof_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = A.asof_join(_kind(spark, sf_dir, "click").drop("value"), _kind(spark, sf_dir, "purchase"), take=["ts", "value"])
    return A.fresh_only(joined, "to_date(ts) = to_date(r_ts)", ["r_value"]).select("event_id", "r_value")


@add(QB + """, j as (select x.symbol, x.ts, x.ret_1, x.close, y.ret_1 as o_ret, y.close as o_close from (select * from base where symbol = 'click') x asof left join (select * from base where symbol = 'view') y on x.ts >= y.ts),
k as (select *, close / nullif(o_close, 0) as ratio from j)
select ts, round(ret_1 - o_ret, 6) as ret_spread, round((ratio - """ + g("avg", "ratio", 30) + ") / nullif(" + g("stddev_samp", "ratio", 30) + """, 0), 6) as ratio_z,
  round(case when count(ret_1 * o_ret) over w >= 24 then (avg(ret_1 * o_ret) over w - avg(case when o_ret is not null then ret_1 end) over w * avg(case when ret_1 is not null then o_ret end) over w)
    / nullif(sqrt(greatest(avg(case when o_ret is not null then ret_1 * ret_1 end) over w - power(avg(case when o_ret is not null then ret_1 end) over w, 2), 0)
      * greatest(avg(case when ret_1 is not null then o_ret * o_ret end) over w - power(avg(case when ret_1 is not null then o_ret end) over w, 2), 0)), 0) end, 6) as ret_corr
from k window w as (""" + frame(24) + ")")  # fmt: skip
def cross_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.base(bars(spark, sf_dir))
    j = A.asof_join(b.where("symbol = 'click'"), b.where("symbol = 'view'"), take=["ret_1", "close"], prefix="o_", bucket_us=7 * A.DAY_US)
    j = j.withColumn("ratio", X.sdiv("close", "o_close"))
    j = I.cut(j, 30, lambda d, k: I.correlation(I.zscore(d, "ratio", 30, "ratio_z", keys=k), "ret_1", "o_ret_1", 24, "ret_corr", keys=k))
    return j.select("ts", (F.col("ret_1") - F.col("o_ret_1")).alias("ret_spread"), "ratio_z", "ret_corr")


@add(QB + """, j as (select x.symbol, x.ts, x.ret_1, x.close, y.ret_1 as o_ret, y.close as o_close from (select *, case when symbol = 'click' then 'view' else 'click' end as peer from base where symbol in ('click', 'view')) x asof left join base y on x.peer = y.symbol and x.ts >= y.ts),
k as (select *, case when symbol = 'view' then close / nullif(o_close, 0) else o_close / nullif(close, 0) end as ratio from j)
select symbol, ts, round(case when symbol = 'view' then ret_1 - o_ret else o_ret - ret_1 end, 6) as xa_ret_spread, round((ratio - """ + g("avg", "ratio", 30) + ") / nullif(" + g("stddev_samp", "ratio", 30) + """, 0), 6) as xa_ratio_z_30,
  round(case when count(ret_1 * o_ret) over w >= 24 then (avg(ret_1 * o_ret) over w - avg(case when o_ret is not null then ret_1 end) over w * avg(case when ret_1 is not null then o_ret end) over w)
    / nullif(sqrt(greatest(avg(case when o_ret is not null then ret_1 * ret_1 end) over w - power(avg(case when o_ret is not null then ret_1 end) over w, 2), 0)
      * greatest(avg(case when ret_1 is not null then o_ret * o_ret end) over w - power(avg(case when ret_1 is not null then o_ret end) over w, 2), 0)), 0) end, 6) as xa_corr_24
from k window w as (""" + frame(24) + ")")  # fmt: skip
def paired_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross-asset block of the feature set, both symbols of a pair."""
    c = FeatureConfig(pair=("click", "view"), pair_ratio=30, pair_corr=24)
    return paired(I.base(bars(spark, sf_dir)).where("symbol in ('click', 'view')"), c).select("symbol", "ts", *pair_names(c))


@add(Q + " select symbol, ts, " + ", ".join(f"round(ln(close) - lag(ln(close), {h}) over s, 6) as ret_{h}" for h in (1, 5, 15)) + ", round(close / lag(close, 15) over s - 1, 6) as roc_15 from bars window s as (partition by symbol order by ts)")
def returns_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 15, lambda d, k: I.roc(I.returns(d, (1, 5, 15), k), (15,), k)).select("symbol", "ts", "ret_1", "ret_5", "ret_15", "roc_15")


@add(Q + f", m as (select *, {g('avg', 'close', 20)} as m, {g('stddev_pop', 'close', 20)} as s, {g('avg', 'close', 30)} as zm, {g('stddev_samp', 'close', 30)} as zs from bars) select symbol, ts, round((close - (m - 2 * s)) / nullif(4 * s, 0), 6) as bb_pctb_20, round((close - zm) / nullif(zs, 0), 6) as zscore_30 from m")
def bollinger_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 30, lambda d, k: I.zscore(I.bollinger(d, keys=k), "close", 30, "zscore_30", keys=k)).select("symbol", "ts", "bb_pctb_20", "zscore_30")


@add(QB + f" select symbol, ts, round({g('stddev_samp', 'ret_1', 15)}, 6) as rv_15, round({g('stddev_samp', 'ret_1', 60)}, 6) as rv_60 from base")
def realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 61, lambda d, k: I.realised_vol(I.base(d, k), (15, 60), k)).select("symbol", "ts", "rv_15", "rv_60")


@add(Q + f" select symbol, ts, round(volume / nullif({g('avg', 'volume', 30)}, 0), 6) as rvol_30, round((volume - {g('avg', 'volume', 60)}) / nullif({g('stddev_samp', 'volume', 60)}, 0), 6) as vol_z_60 from bars")
def rvol_vol_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 60, lambda d, k: I.zscore(I.relative_volume(d, (30,), k), "volume", 60, "vol_z_60", keys=k)).select("symbol", "ts", "rvol_30", "vol_z_60")


@add(QB + f", sv as (select *, coalesce(sign(ret_1), 0) * volume as sv from base) select symbol, ts, round({g('sum', 'sv', 60)} / nullif({g('sum', 'volume', 60)}, 0), 6) as obv_norm_60 from sv")
def obv_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 61, lambda d, k: I.signed_volume(I.base(d, k), keys=k)).select("symbol", "ts", "obv_norm_60")


@add(Q + f""", v as (select *, power(ln(high / low), 2) as hl, 0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2) as gk from bars)
select symbol, ts, round(sqrt({g('avg', 'hl', 30)} / (4 * ln(2))), 6) as parkinson_30, round(sqrt(greatest({g('avg', 'gk', 30)}, 0)), 6) as gk_30 from v""")
def parkinson_gk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 30, lambda d, k: I.range_vols(d, keys=k)).select("symbol", "ts", "parkinson_30", "gk_30")


@add(QB + f", v as (select *, {g('stddev_samp', 'ret_1', 15)} as rv_15 from base) select symbol, ts, round(rv_15 / nullif(case when count(rv_15) over ({frame(120)}) >= 30 then quantile_cont(rv_15, 0.5) over ({frame(120)}) end, 0), 6) as vol_regime from v")
def vol_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 136, lambda d, k: I.vol_regime(I.realised_vol(I.base(d, k), (15,), k), "rv_15", 120, 30, k)).select("symbol", "ts", "vol_regime")


@add(Q + " select symbol, ts, round(volume / nullif(avg(volume) over (partition by symbol, hour(ts) order by ts rows between 20 preceding and 1 preceding), 0), 6) as rvol_tod from bars")
def rvol_tod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.time_of_day_volume(bars(spark, sf_dir), F.hour("ts")).select("symbol", "ts", "rvol_tod")


@add(Q + f""", d as (select *, ((({LOCAL})::date) + case when hour({LOCAL}) >= 18 then 1 else 0 end)::date as day, (high + low + close) / 3 * volume as pv from bars)
select symbol, ts, round(close / nullif(sum(pv) over s / nullif(sum(volume) over s, 0), 0) - 1, 6) as vwap_dist from d window s as (partition by symbol, day order by ts rows between unbounded preceding and current row)""")
def vwap_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.vwap_distance(bars(spark, sf_dir)).select("symbol", "ts", "vwap_dist")


@add(Q + f""", k as (select symbol, ts, 100 * (close - {g('min', 'low', 14)}) / nullif({g('max', 'high', 14)} - {g('min', 'low', 14)}, 0) as k from bars)
select symbol, ts, round(k, 6) as stoch_k, round({g('avg', 'k', 3)}, 6) as stoch_d from k""")
def stoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 17, lambda d, k: I.stochastic(d, keys=k)).select("symbol", "ts", "stoch_k", "stoch_d")


@add(Q + f""", a as (select *, (high + low + close) / 3 as tp from bars), m as (select *, {g('avg', 'tp', 20)} as sma from a), d as (select *, abs(tp - sma) as dev from m)
select symbol, ts, round((tp - sma) / nullif(0.015 * {g('avg', 'dev', 20)}, 0), 6) as cci from d""")
def cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 40, lambda d, k: I.cci(d, keys=k)).select("symbol", "ts", "cci")


@add(Q + f""", a as (select *, (high + low + close) / 3 as tp from bars), d as (select *, tp - lag(tp) over (partition by symbol order by ts) as d from a),
f as (select *, case when d is not null then case when d > 0 then tp * volume else 0 end end as up, case when d is not null then case when d < 0 then tp * volume else 0 end end as dn from d)
select symbol, ts, round(100 * {g('sum', 'up', 14)} / nullif({g('sum', 'up', 14)} + {g('sum', 'dn', 14)}, 0), 6) as mfi from f""")
def mfi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 15, lambda d, k: I.mfi(d, keys=k)).select("symbol", "ts", "mfi")


@add(QB + f""", v as (select *, abs(high - lag(low) over s) as p, abs(low - lag(high) over s) as m, case when prev_close is not null then true_range end as t from base window s as (partition by symbol order by ts))
select symbol, ts, round({g('sum', 'p', 14)} / nullif({g('sum', 't', 14)}, 0), 6) as vortex_pos, round({g('sum', 'm', 14)} / nullif({g('sum', 't', 14)}, 0), 6) as vortex_neg from v""")
def vortex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut(bars(spark, sf_dir), 16, lambda d, k: I.vortex(I.base(d, k), keys=k)).select("symbol", "ts", "vortex_pos", "vortex_neg")


@add(QR + ", " + recursion("e", "base", {"f": ("logc", 2 / 13), "s": ("logc", 2 / 27)}) + """, m as (select b.symbol, b.ts, b.rn, b.logc, case when b.rn >= 12 then e.f end as f, case when b.rn >= 26 then e.s end as s from base b join e on b.symbol = e.symbol and b.rn = e.rn),
m2 as (select *, f - s as macd from m), """ + recursion("sig", "m2", {"sg": ("macd", 2 / 10)}, 26) + """, a as (select m2.*, case when m2.rn >= 34 then sig.sg end as macd_signal from m2 left join sig on m2.symbol = sig.symbol and m2.rn = sig.rn)
select symbol, ts, round(macd, 6) as macd, round(macd_signal, 6) as macd_signal, round(macd - macd_signal, 6) as macd_hist, round(f - lag(f, 5) over w, 6) as ema_slope_12, round(s - lag(s, 5) over w, 6) as ema_slope_26,
  round((logc - f) / nullif(""" + g("stddev_samp", "(logc - f)", 12) + """, 0), 6) as ema_dist_z_12, round((logc - s) / nullif(""" + g("stddev_samp", "(logc - s)", 26) + """, 0), 6) as ema_dist_z_26 from a window w as (partition by symbol order by ts)""")  # fmt: skip
def ema_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ema_macd(I.base(bars(spark, sf_dir))).select("symbol", "ts", "macd", "macd_signal", "macd_hist", "ema_slope_12", "ema_dist_z_12", "ema_slope_26", "ema_dist_z_26")


@add(QR + ", d as (select *, greatest(close - prev_close, 0) as gain, greatest(prev_close - close, 0) as loss from base), " + recursion("e", "d", {"ag": ("gain", 1 / 14), "al": ("loss", 1 / 14)}, 2) + " select d.symbol, d.ts, round(case when d.rn >= 15 then 100 * ag / nullif(ag + al, 0) end, 6) as rsi_14 from d left join e on d.symbol = e.symbol and d.rn = e.rn")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rsi(bars(spark, sf_dir)).select("symbol", "ts", "rsi_14")


@add(QR + ", " + recursion("e", "base", {"a": ("true_range", 1 / 14)}) + " select b.symbol, b.ts, round(case when b.rn >= 14 then e.a / b.close end, 6) as atr_pct_14 from base b join e on b.symbol = e.symbol and b.rn = e.rn")
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.atr(I.base(bars(spark, sf_dir))).select("symbol", "ts", "atr_pct_14")


@add(QR + """, d as (select *, high - lag(high) over s as up, lag(low) over s - low as dn from base window s as (partition by symbol order by ts)),
dm as (select *, case when up > dn and up > 0 then up else 0 end as pdm, case when dn > up and dn > 0 then dn else 0 end as mdm from d), """ + recursion("e", "dm", {"tr": ("true_range", 1 / 14), "p": ("pdm", 1 / 14), "m": ("mdm", 1 / 14)}) + """,
di as (select dm.symbol, dm.ts, dm.rn, case when dm.rn >= 14 then 100 * p / nullif(tr, 0) end as plus_di, case when dm.rn >= 14 then 100 * m / nullif(tr, 0) end as minus_di from dm join e on dm.symbol = e.symbol and dm.rn = e.rn),
x as (select *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) as dx from di), """ + recursion("a", "x", {"adx": ("dx", 1 / 14)}, 14) + """
select x.symbol, x.ts, round(plus_di, 6) as plus_di, round(minus_di, 6) as minus_di, round(case when x.rn >= 27 then adx end, 6) as adx_14 from x left join a on x.symbol = a.symbol and x.rn = a.rn""")  # fmt: skip
def adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.adx(I.base(bars(spark, sf_dir))).select("symbol", "ts", "plus_di", "minus_di", "adx_14")


@add(QR + ", " + recursion("e1", "base", {"t1": ("logc", 2 / 16)}) + ", s2 as (select symbol, rn, t1 from e1 where rn >= 15), " + recursion("e2", "s2", {"t2": ("t1", 2 / 16)}, 15) + ", s3 as (select symbol, rn, t2 from e2 where rn >= 29), " + recursion("e3", "s3", {"t3": ("t2", 2 / 16)}, 29)
     + " select b.symbol, b.ts, round(case when b.rn >= 44 then e3.t3 - lag(e3.t3) over (partition by b.symbol order by b.ts) end, 6) as trix_15 from base b left join e3 on b.symbol = e3.symbol and b.rn = e3.rn")
def trix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.trix(I.base(bars(spark, sf_dir))).select("symbol", "ts", "trix_15")


A_ = 2 / 31


@add(QR + f""", w as (select symbol, rn, ret_1 as mean, 0.0::double as cov, 1.0::double as sw, 1.0::double as sw2, 1.0::double as old, 1 as n from base where rn = 2
  union all select s.symbol, s.rn, (p.old * {1 - A_!r} * p.mean + {A_!r} * s.ret_1) / (p.old * {1 - A_!r} + {A_!r}),
    (p.old * {1 - A_!r} * (p.cov + power(p.mean - (p.old * {1 - A_!r} * p.mean + {A_!r} * s.ret_1) / (p.old * {1 - A_!r} + {A_!r}), 2)) + {A_!r} * power(s.ret_1 - (p.old * {1 - A_!r} * p.mean + {A_!r} * s.ret_1) / (p.old * {1 - A_!r} + {A_!r}), 2)) / (p.old * {1 - A_!r} + {A_!r}),
    (p.sw * {1 - A_!r} + {A_!r}) / (p.old * {1 - A_!r} + {A_!r}), (p.sw2 * {(1 - A_) ** 2!r} + {A_ * A_!r}) / power(p.old * {1 - A_!r} + {A_!r}, 2), 1.0, p.n + 1
  from w p join base s on s.symbol = p.symbol and s.rn = p.rn + 1)
select b.symbol, b.ts, round(case when w.n >= 30 then sqrt(greatest(w.cov * w.sw * w.sw / nullif(w.sw * w.sw - w.sw2, 0), 0)) end, 6) as sigma from base b left join w on b.symbol = w.symbol and b.rn = w.rn""")
def ewm_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ewm_std(I.base(bars(spark, sf_dir)).select("symbol", "ts", "ret_1"), ["symbol"], ["ts"], "ret_1", "sigma", 30, 30).select("symbol", "ts", "sigma")


@add(QR + """, c as (select symbol, rn, 0.0::double as up, 0.0::double as dn, false as fired from base where rn = 1
  union all select s.symbol, s.rn, case when greatest(0, p.up + s.ret_1) >= 0.01 then 0 else greatest(0, p.up + s.ret_1) end,
    case when greatest(0, p.up + s.ret_1) < 0.01 and least(0, p.dn + s.ret_1) <= -0.01 then 0 else least(0, p.dn + s.ret_1) end,
    greatest(0, p.up + s.ret_1) >= 0.01 or least(0, p.dn + s.ret_1) <= -0.01 from c p join base s on s.symbol = p.symbol and s.rn = p.rn + 1)
select b.symbol, b.ts, c.fired from base b join c on b.symbol = c.symbol and b.rn = c.rn""")
def cusum_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.base(bars(spark, sf_dir)).select("symbol", "ts", "ret_1", F.lit(0.01).alias("threshold"))
    return R.cusum_events(b, ["symbol"], ["ts"], "ret_1", "threshold").select("symbol", "ts", "fired")


@add(f"""with recursive {TICKS_SQL}, s as (select *, price * size as notional, row_number() over (partition by symbol, instrument, ts::date order by ts, event_id) as rn, ts::date as day from t),
f as (select symbol, instrument, day, rn, 0::bigint as bar_id, case when notional >= 100000 then 1 else 0 end as closes, notional as total from s where rn = 1
  union all select s.symbol, s.instrument, s.day, s.rn, p.bar_id + p.closes, case when (case when p.closes = 1 then 0 else p.total end) + s.notional >= 100000 then 1 else 0 end, (case when p.closes = 1 then 0 else p.total end) + s.notional
  from f p join s on s.symbol = p.symbol and s.instrument = p.instrument and s.day = p.day and s.rn = p.rn + 1)
select s.symbol, s.instrument, s.day, f.bar_id, max(f.closes) = 1 as bar_complete, min(s.ts) as ts_open, max(s.ts) as ts_close, round(arg_min(s.price, s.rn), 6) as open, round(max(s.price), 6) as high, round(min(s.price), 6) as low,
  round(arg_max(s.price, s.rn), 6) as close, round(sum(s.size)::double, 6) as volume, round(sum(s.price * s.size) / sum(s.size), 6) as vwap, count(*)::bigint as n
from s join f on s.symbol = f.symbol and s.instrument = f.instrument and s.day = f.day and s.rn = f.rn group by 1, 2, 3, 4""")
def dollar_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return R.dollar_bars(t, ["symbol", "instrument", "day"], 100_000.0)


@add(f"""with {TICKS_SQL}, k as (select *, price - 0.05 as bid, price + 0.05 as ask, (size % 7 + 1)::double as bid_size, (size % 5 + 1)::double as ask_size, ts::date as day from t),
p as (select *, lag(bid) over w as pb, lag(bid_size) over w as pbs, lag(ask) over w as pa, lag(ask_size) over w as pas, epoch_us(ts) - lag(epoch_us(ts)) over w as dt from k window w as (partition by symbol, instrument, day order by ts, event_id)),
x as (select symbol, instrument, day, ts, (bid + ask) / 2 as mid, dt,
  case when pb is null then 0 else (case when bid >= pb then bid_size else 0 end) - (case when bid <= pb then pbs else 0 end) - ((case when ask <= pa then ask_size else 0 end) - (case when ask >= pa then pas else 0 end)) end as ofi,
  case when dt > 0 then power(ln(((bid + ask) / 2) / ((pb + pa) / 2)), 2) end as rv, (pa - pb) * dt as s, (pbs - pas) / (pbs + pas) * dt as i from p)
select symbol, instrument, date_trunc('day', ts) as ts, round(sum(ofi), 6) as ofi, round(sum(rv), 6) as rv, round(arg_min(mid, ts), 6) as mid_open, round(arg_max(mid, ts), 6) as mid_close, count(*)::bigint as n,
  round(sum(s) / nullif(sum(case when i is not null then dt end), 0), 6) as twa_spread, round(sum(i) / nullif(sum(case when i is not null then dt end), 0), 6) as twa_imbalance, round(arg_max(mid, ts) - arg_min(mid, ts), 6) as dmid
from x group by 1, 2, 3""")
def ofi_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    book = t.select("symbol", "instrument", "ts", "event_id", (F.col("price") - 0.05).alias("bid"), (F.col("price") + 0.05).alias("ask"), (F.col("size") % 7 + 1).cast("double").alias("bid_size"), (F.col("size") % 5 + 1).cast("double").alias("ask_size"), F.to_date("ts").alias("day"))
    return B.flow_bars(B.book_transitions(book, ["symbol", "instrument", "day"], ["ts", "event_id"]), ["symbol", "instrument"], "day")


@add("""select e.event_id, (select count(*) from events x where x.event_type = e.event_type and epoch_us(x.ts) <= epoch_us(e.ts) and epoch_us(x.ts) > epoch_us(e.ts) - 3600000000)::bigint as n_1h,
  round((select sum(x.value) from events x where x.event_type = e.event_type and epoch_us(x.ts) <= epoch_us(e.ts) and epoch_us(x.ts) > epoch_us(e.ts) - 3600000000), 6) as value_1h from events e""")
def half_open_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = half_open_us(["event_type"], "ts", 3_600_000_000)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("n_1h"), F.sum("value").over(w).alias("value_1h"))
