"""Queries over order-flow bars: assembly from book events, histories, block deviations, session labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import micro as MI
from ..operators import quality as QA
from ..operators import studies as ST
from ..sources.store import Store
from .domain import BARS_SQL, TICKS_SQL, Catalogue, bars, ticks
from .research_queries import POS_SQL, _positions
from .shipping import shared_folder

catalogue = Catalogue()
add = catalogue.add

BOOK_SQL = f"""{TICKS_SQL}, bk as (select symbol, instrument, ts::date as day, ts, event_id, size % 3 <> 0 as is_trade, price, size::double as size, case when event_id % 2 = 0 then 1 else -1 end as sign,
  price - 0.25 * (1 + event_id % 3) as bid, price + 0.25 as ask, (size % 7 + 1)::double as bid_size, (size % 5 + 1)::double as ask_size from t)"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.select(
        "symbol", "instrument", F.to_date("ts").alias("day"), "ts", "event_id", (F.col("size") % 3 != 0).alias("is_trade"), "price", F.col("size").cast("double").alias("size"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("sign"),
        (F.col("price") - 0.25 * (1 + F.col("event_id") % 3)).alias("bid"), (F.col("price") + 0.25).alias("ask"), (F.col("size") % 7 + 1).cast("double").alias("bid_size"), (F.col("size") % 5 + 1).cast("double").alias("ask_size"),
    )


BOOK_BARS_SQL = f"""with recursive {BOOK_SQL}, s as (select *, case when is_trade then price * size * 2 else 0 end as notional, row_number() over w as rn,
  case when lag(bid) over w is null then 0.0 else (case when bid >= lag(bid) over w then bid_size else 0 end) - (case when bid <= lag(bid) over w then lag(bid_size) over w else 0 end) - ((case when ask <= lag(ask) over w then ask_size else 0 end) - (case when ask >= lag(ask) over w then lag(ask_size) over w else 0 end)) end as ofi,
  case when epoch_us(ts) > lag(epoch_us(ts)) over w then power(ln(((bid + ask) / 2) / ((lag(bid) over w + lag(ask) over w) / 2)), 2) end as rv, (bid + ask) / 2 as mid from bk window w as (partition by symbol, instrument, day order by ts, event_id)),
f as (select symbol, instrument, day, rn, 0::bigint as bar_id, case when notional >= 200000 then 1 else 0 end as closes, notional as total from s where rn = 1
  union all select s.symbol, s.instrument, s.day, s.rn, p.bar_id + p.closes, case when (case when p.closes = 1 then 0 else p.total end) + s.notional >= 200000 then 1 else 0 end, (case when p.closes = 1 then 0 else p.total end) + s.notional
  from f p join s on s.symbol = p.symbol and s.instrument = p.instrument and s.day = p.day and s.rn = p.rn + 1),
x as (select s.*, f.bar_id, f.closes, epoch_us(s.ts) - lag(epoch_us(s.ts)) over w as dt, lag((ask - bid) / 0.25) over w as spread, lag((bid_size - ask_size) / (bid_size + ask_size)) over w as imb, lag(bid_size + ask_size) over w as depth
  from s join f on s.symbol = f.symbol and s.instrument = f.instrument and s.day = f.day and s.rn = f.rn window w as (partition by s.symbol, s.instrument, s.day, f.bar_id order by s.rn)),
bb as (select symbol, instrument, day, bar_id, max(closes) = 1 as bar_complete, min(ts) as ts_open, max(ts) as ts, arg_min(price, rn) filter (is_trade) as open, max(price) filter (is_trade) as high, min(price) filter (is_trade) as low, arg_max(price, rn) filter (is_trade) as close,
  sum(size) filter (is_trade) as volume, sum(price * size) filter (is_trade) as pv, sum(size * sign) filter (is_trade) as signed_vol, count(*) filter (is_trade) as n_trades, count(*) as n_events, sum(ofi) as ofi_top, arg_min(mid, rn) as mid_open, arg_max(mid, rn) as mid_close,
  sum(case when dt > 0 then rv end) as rv, sum(spread * dt) / nullif(sum(dt), 0) as spread_twa, sum(imb * dt) / nullif(sum(dt), 0) as imbalance_twa, sum(depth * dt) / nullif(sum(dt), 0) as depth_twa from x group by 1, 2, 3, 4 having count(*) filter (is_trade) > 0)"""


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MI.book_bars(_book(spark, sf_dir), ["symbol", "instrument", "day"], 200_000.0, multiplier=2.0)


@add(f"""{BOOK_BARS_SQL} select symbol, instrument, day, bar_id, bar_complete, ts_open, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume, round(pv * 2, 6) as dollar_volume, round(signed_vol, 6) as signed_vol,
  n_trades::bigint as n_trades, n_events::bigint as n_events, round(ofi_top, 6) as ofi_top, round(mid_open, 6) as mid_open, round(mid_close, 6) as mid_close, round(spread_twa, 6) as spread_twa, round(imbalance_twa, 6) as imbalance_twa, round(depth_twa, 6) as depth_twa,
  round(pv / nullif(volume, 0), 6) as vwap, round(signed_vol / nullif(volume, 0), 6) as trade_imbalance, round(mid_close - mid_open, 6) as dmid, round(ln(mid_close / mid_open), 6) as ret_bar, round(sqrt(coalesce(rv, 0)), 6) as rv_intrabar, round((epoch_us(ts) - epoch_us(ts_open)) / 1000000.0, 6) as duration_s from bb""")
def book_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollar bars with a multiplier, signed volume, book means and partial tails; bars without trades are gone."""
    return _bars(spark, sf_dir)


@add(f"""{BOOK_BARS_SQL} select symbol, instrument, day, bar_id, round(lag(ofi_top) over w, 6) as ofi_top_lag1, round(sum(ofi_top) over (partition by symbol, instrument order by ts, bar_id rows between 2 preceding and current row), 6) as ofi_top_roll3,
  round(sum(signed_vol) over (partition by symbol, instrument order by ts, bar_id rows between 2 preceding and current row), 6) as signed_vol_roll3 from bb window w as (partition by symbol, instrument order by ts, bar_id)""")
def flow_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MI.flow_history(_bars(spark, sf_dir), ["symbol", "instrument"]).select("symbol", "instrument", "day", "bar_id", "ofi_top_lag1", "ofi_top_roll3", "signed_vol_roll3")


@add(f"{BOOK_BARS_SQL} select symbol, day, count(*)::bigint as n, round(sum(close), 6) as closes, round(sum(ofi_top), 6) as ofi from bb where instrument = 1 and day between date '2024-01-05' and date '2024-01-20' group by 1, 2")
def micro_bars_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-flow bars of one instrument through their lake, written twice, and a window of each symbol read back."""
    store = Store(spark, shared_folder(spark, "micro-bars"))
    b = _bars(spark, sf_dir).where("instrument = 1")
    b = b.withColumns({"ts_event": F.col("ts") + F.expr("interval 0 second"), "ts_ingest": F.col("ts"), "contract_id": F.concat(F.lit("id"), "instrument"), "con_id": F.col("instrument")})
    store.write("micro_bars", b)
    store.write("micro_bars", b)
    rows = None
    for s in ("click", "error", "purchase", "signup", "view"):
        part = store.read_window("micro_bars", s, "2024-01-05 00:00:00", "2024-01-20 23:59:59.999999")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("symbol", F.to_date("ts_event").alias("day")).agg(F.count("*").alias("n"), F.sum("close").alias("closes"), F.sum("ofi_top").alias("ofi"))


@add(f"""{BOOK_BARS_SQL}, s2 as (select symbol, day, count(*) as n from bb group by 1, 2), g as (select symbol, count(*) as sessions, min(n) as least, quantile_cont(n, 0.5) as median, max(n) as most from s2 group by 1)
select g.symbol, sessions::bigint as sessions, least::bigint as least, round(median, 6) as median, most::bigint as most, (select count(*) from s2 where s2.symbol = g.symbol and s2.n < g.median / 3)::bigint as thin, (select count(distinct instrument) - 1 from bb where bb.symbol = g.symbol)::bigint as rolls,
  round((select 100 * avg((not bar_complete)::int) from bb where bb.symbol = g.symbol), 6) as pct_incomplete, round((select quantile_cont((epoch_us(ts) - epoch_us(ts_open)) / 1000000.0, 0.5) from bb where bb.symbol = g.symbol), 6) as median_duration_s,
  round((select corr(ofi_top, mid_close - mid_open) from bb where bb.symbol = g.symbol), 6) as ofi_dmid_corr, (select sum((spread_twa is null)::int + (depth_twa is null)::int) from bb where bb.symbol = g.symbol)::bigint as bad_values from g""")
def micro_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.micro_health(_bars(spark, sf_dir).withColumn("con_id", F.col("instrument")), "symbol", "day", ["spread_twa", "depth_twa"])


A10 = 2 / 11
BLOCK_SQL = f"""{BARS_SQL}, hb as (select symbol, ts::date as day, ts, close as mid_close, 3600.0 + n as duration_s, row_number() over (partition by symbol, ts::date order by ts) as rn, ln(close) - lag(ln(close)) over (partition by symbol, ts::date order by ts) as r from bars),
w as (select symbol, day, rn, r as mean, 0.0::double as cov, 1.0::double as sw, 1.0::double as sw2, 1 as n from hb where rn = 2
  union all select s.symbol, s.day, s.rn, {1 - A10!r} * p.mean + {A10!r} * s.r, {1 - A10!r} * (p.cov + power(p.mean - ({1 - A10!r} * p.mean + {A10!r} * s.r), 2)) + {A10!r} * power(s.r - ({1 - A10!r} * p.mean + {A10!r} * s.r), 2),
    p.sw * {1 - A10!r} + {A10!r}, p.sw2 * {(1 - A10) ** 2!r} + {A10 * A10!r}, p.n + 1 from w p join hb s on s.symbol = p.symbol and s.day = p.day and s.rn = p.rn + 1),
du as (select symbol, day, rn, duration_s::double as y from hb where rn = 1 union all select s.symbol, s.day, s.rn, {1 - A10!r} * p.y + {A10!r} * s.duration_s from du p join hb s on s.symbol = p.symbol and s.day = p.day and s.rn = p.rn + 1),
sg as (select hb.symbol, hb.day, hb.ts, hb.rn, hb.mid_close, hb.r, case when w.n >= 5 then sqrt(greatest(w.cov * w.sw * w.sw / nullif(w.sw * w.sw - w.sw2, 0), 0)) * sqrt(14400.0 / du.y) end as sigma
  from hb join du on hb.symbol = du.symbol and hb.day = du.day and hb.rn = du.rn left join w on hb.symbol = w.symbol and hb.day = w.day and hb.rn = w.rn)"""


def _session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", F.to_date("ts").alias("day"), "ts", F.col("close").alias("mid_close"), (3600.0 + F.col("n")).alias("duration_s"))


@add(f"with recursive {BLOCK_SQL} select symbol, day, ts, round(r, 6) as r, round(sigma, 6) as sigma from sg")
def block_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = MI.block_sigma(_session_bars(spark, sf_dir), ["symbol", "day"], span=10, least=5, duration_span=10, horizon_s=14_400.0)
    return b.select("symbol", "day", "ts", "r", "sigma")


def barrier_sql(bars_: str, events: str, minutes: int, up: float, down: float) -> str:
    """CTEs of session barriers: ``bars_(symbol, day, ts, close, pos)``, ``events`` the same with sigma; the result is ``sb``."""
    return f"""lst as (select symbol, day, max(ts) as lts, max(pos) as lpos from {bars_} group by 1, 2), e1 as (select e.*, l.lpos from {events} e join lst l on e.symbol = l.symbol and e.day = l.day where e.sigma > 0 and epoch_us(e.ts) + {minutes * 60_000_000} <= epoch_us(l.lts)),
e2 as (select e1.*, e1.ts + interval {minutes} minute as due from e1), e3 as (select e2.*, coalesce(v.pos, e2.lpos) as epos from e2 asof left join {bars_} v on e2.symbol = v.symbol and e2.day = v.day and e2.due <= v.ts),
pth as (select e.symbol, e.day, e.ts as t0, e.sigma, e.pos as e, b.pos as p, b.ts as p_ts, ln(b.close / e.close) as r, case when ln(b.close / e.close) >= {up} * e.sigma then 1 when ln(b.close / e.close) <= -{down} * e.sigma then -1 end as side from e3 e join {bars_} b on b.symbol = e.symbol and b.day = e.day and b.pos > e.pos and b.pos <= e.epos),
hit as (select symbol, day, e, min(case when side is not null then p end) as tp, max(p) as lp from pth group by 1, 2, 3),
sb as (select p.symbol, p.day, p.t0, p.p_ts as t1, p.r as ret, coalesce(case when h.tp is not null then p.side end, 0) as label, case when h.tp is null then 'vertical' when p.side = 1 then 'upper' else 'lower' end as barrier, p.sigma, p.p - p.e as n_bars, p.e as pos0, p.p as pos1 from hit h join pth p on p.symbol = h.symbol and p.day = h.day and p.e = h.e and p.p = coalesce(h.tp, h.lp))"""


@add(f"with {POS_SQL}, sbars as (select symbol, day, ts, close, sigma, row_number() over (partition by symbol, day order by ts) as pos from pb), {barrier_sql('sbars', 'sbars', 240, 0.5, 0.4)} select symbol, day as session_date, t0, t1, round(ret, 6) as ret, label::int as label, barrier, round(sigma, 6) as sigma, n_bars::int as n_bars, false as resolved_at_close from sb")
def session_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _positions(spark, sf_dir).withColumnRenamed("day", "session_date")
    return L.session_barrier(b, b, minutes=240, up=0.5, down=0.4)


MICRO_SQL = f"""with recursive {BLOCK_SQL}, cu as (select symbol, day, rn, 0.0::double as up, 0.0::double as dn, false as fired from sg where rn = 1
  union all select s.symbol, s.day, s.rn, case when s.sigma is null or greatest(0, p.up + s.r) >= 0.3 * s.sigma then 0 else greatest(0, p.up + s.r) end,
    case when s.sigma is null or (greatest(0, p.up + s.r) < 0.3 * s.sigma and least(0, p.dn + s.r) <= -0.3 * s.sigma) then 0 else least(0, p.dn + s.r) end,
    coalesce(greatest(0, p.up + s.r) >= 0.3 * s.sigma or least(0, p.dn + s.r) <= -0.3 * s.sigma, false) from cu p join sg s on s.symbol = p.symbol and s.day = p.day and s.rn = p.rn + 1),
mb as (select symbol, day, ts, mid_close as close, rn as pos, sigma from sg), me as (select mb.* from mb join cu on mb.symbol = cu.symbol and mb.day = cu.day and mb.pos = cu.rn where cu.fired), {barrier_sql('mb', 'me', 240, 0.5, 0.4)},
cc as (select a.symbol, a.day, a.pos0, b.pos as at, (select count(*) from sb c where c.symbol = a.symbol and c.day = a.day and c.pos0 <= b.pos and c.pos1 >= b.pos) as c from sb a join mb b on a.symbol = b.symbol and a.day = b.day and b.pos between a.pos0 and a.pos1),
uq as (select symbol, day, pos0, avg(1.0 / c) as u from cc group by 1, 2, 3), ml as (select sb.*, uq.u, uq.u / avg(uq.u) over (partition by sb.symbol, sb.day) as weight from sb join uq on sb.symbol = uq.symbol and sb.day = uq.day and sb.pos0 = uq.pos0)"""


def _micro_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MI.micro_labels(_session_bars(spark, sf_dir), ["symbol", "day"], minutes=240, mult=0.3, up=0.5, down=0.4, span=10, least=5, duration_span=10)


@add(f"{MICRO_SQL} select symbol, day, t0, t1, round(ret, 6) as ret, label::int as label, barrier, n_bars::int as n_bars, round(u, 6) as avg_uniqueness, round(weight, 6) as weight from ml")
def micro_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CUSUM events of a session's bars, barriers inside it, uniqueness weights."""
    return _micro_labels(spark, sf_dir).select("symbol", "day", "t0", "t1", "ret", "label", "barrier", "n_bars", "avg_uniqueness", "weight")


@add(f"{MICRO_SQL}, fe as (select symbol, ts, r, sigma from sg) select ml.symbol, ml.t0, round(fe.r, 6) as r, round(fe.sigma, 6) as bar_sigma from ml asof left join fe on ml.symbol = fe.symbol and ml.t0 >= fe.ts")
def micro_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro labels with their last bar's features."""
    b = MI.block_sigma(_session_bars(spark, sf_dir), ["symbol", "day"], span=10, least=5, duration_span=10, horizon_s=14_400.0).withColumnRenamed("sigma", "bar_sigma")
    return ST.micro_matrix(_micro_labels(spark, sf_dir).drop("r"), b.select("symbol", "ts", "r", "bar_sigma"), ["r", "bar_sigma"]).select("symbol", "t0", "r", "bar_sigma")
