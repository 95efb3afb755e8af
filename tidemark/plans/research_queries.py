"""Queries for rolls, labels, cross-validation, volatility, statistics and quality."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import statistics as S
from ..operators import continuous as C
from ..operators import cv as CV
from ..operators import indicators as I
from ..operators import labels as L
from ..operators import quality as QA
from ..operators import recurrences as R
from ..operators import resampling as RS
from ..operators import volatility as V
from .domain import BARS_SQL, TICKS_SQL, Catalogue, bars, table, ticks
from .market_queries import BASE_SQL, frame, recursion

catalogue = Catalogue()
add = catalogue.add

# --- contracts: shipped quantity a day; a contract is a quarter of ship dates, sold from 60 days before to its end ------------------------

CONTRACTS_SQL = """li as (select l_shipdate::date as date, l_quantity, l_extendedprice / l_quantity as unit from lineitem),
q as (select date, l_quantity, unit, k, (date_trunc('quarter', date) + to_months((3 + 3 * k)::int) - interval 1 day)::date as expiry from li, (values (0), (1)) x(k)),
cb as (select date, 'C' || strftime(expiry, '%Y%m') as contract_id, expiry, sum(l_quantity * (case when k = 0 then 1.0 else 1.0 + (dayofyear(date) % 91) / 30.0 - 1.5 end)) as volume,
  avg(unit) * (1 + 0.01 * k) as close from q group by date, expiry, k)"""


def contract_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of two overlapping quarterly contracts."""
    li = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    q = li.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    expiry = F.last_day(F.add_months(F.date_trunc("quarter", "date"), 2 + 3 * F.col("k")))
    q = q.withColumn("expiry", F.to_date(expiry))
    w = F.when(F.col("k") == 0, 1.0).otherwise(1.0 + (F.dayofyear("date") % 91) / 30.0 - 1.5)
    g = q.groupBy("date", "expiry", "k").agg(F.sum(F.col("l_quantity") * w).alias("volume"), (F.avg("unit") * (1 + 0.01 * F.col("k"))).alias("close"))
    return g.select("date", F.concat(F.lit("C"), F.date_format("expiry", "yyyyMM")).alias("contract_id"), "expiry", "volume", "close", F.col("date").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("con_id"))


FRONT_SQL = f"""{CONTRACTS_SQL}, ranked as (select *, row_number() over w as r, lead(contract_id) over w as nxt, lead(volume) over w as nv from cb where expiry >= date window w as (partition by date order by expiry, contract_id)),
front as (select date, case when nxt is not null and (nv > volume or date_diff('day', date, expiry) <= 5) then nxt else contract_id end as front from ranked where r = 1),
rolls as (select date as roll_date, prev as from_contract, front as to_contract from (select *, lag(front) over (order by date) as prev from front) where prev <> front)"""


def _rolls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = contract_bars(spark, sf_dir)
    return b, C.rolls(C.front_month(C.daily_volume(b)))


@add(f"with {FRONT_SQL} select * from front")
def front_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.front_month(C.daily_volume(contract_bars(spark, sf_dir)))


@add(f"with {FRONT_SQL} select * from rolls")
def rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolls(spark, sf_dir)[1]


SEAM_SQL = FRONT_SQL + """, seam as (select r.*, (select arg_max(close, date) from cb where contract_id = from_contract and date < roll_date) as old_close, (select arg_min(close, date) from cb where contract_id = to_contract and date >= roll_date) as new_close from rolls r)"""


def _continuous_sql(step: str, agg: str, none: str, apply: str) -> str:
    return f"""with {SEAM_SQL}, st as (select *, {step} as step from seam), ch as (select *, sum(case when step is null then 1 else 0 end) over (order by roll_date desc) as chain from st),
f as (select *, case when step is null then {none} else {agg} over (partition by chain order by roll_date desc) end as factor from ch),
seg as (select from_contract as contract, lag(roll_date) over (order by roll_date) as s, roll_date as e, factor from f union all select arg_max(to_contract, roll_date), max(roll_date), null, {none} from f)
select b.date, b.contract_id, round({apply}, 6) as close, round(b.close, 6) as raw_close, round(g.factor, 6) as adj_factor from cb b join seg g on b.contract_id = g.contract and (g.s is null or b.date >= g.s) and (g.e is null or b.date < g.e)"""


@add(_continuous_sql("new_close / nullif(old_close, 0)", "exp(sum(ln(step))", "1.0", "b.close * g.factor").replace("exp(sum(ln(step)) over (partition by chain order by roll_date desc)", "exp(sum(ln(step)) over (partition by chain order by roll_date desc))"))
def continuous_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, r = _rolls(spark, sf_dir)
    return C.continuous(b, r, "ratio").select("date", "contract_id", "close", "raw_close", "adj_factor")


@add(_continuous_sql("new_close - old_close", "sum(step)", "0.0", "b.close + g.factor"))
def continuous_panama(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, r = _rolls(spark, sf_dir)
    return C.continuous(b, r, "panama").select("date", "contract_id", "close", "raw_close", "adj_factor")


CONT_SQL = _continuous_sql("new_close / nullif(old_close, 0)", "exp(sum(ln(step))", "1.0", "b.close * g.factor").replace("exp(sum(ln(step)) over (partition by chain order by roll_date desc)", "exp(sum(ln(step)) over (partition by chain order by roll_date desc))")


@add(f"with c as ({CONT_SQL}), {FRONT_SQL} select r.roll_date, round((select arg_min(close, date) from c where date >= r.roll_date) / (select arg_max(close, date) from c where date < r.roll_date) - 1, 6) as gap from rolls r")
def seam_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, r = _rolls(spark, sf_dir)
    return C.seam_gaps(C.continuous(b, r, "ratio"), r)


# --- labels ------------------------------------------------------------------------------------------------------------------------------

POS_SQL = BASE_SQL + f", pb as (select symbol, rn - 1 as pos, ts, close, case when count(ret_1) over ({frame(24)}) >= 24 then stddev_samp(ret_1) over ({frame(24)}) * sqrt(48) end as sigma, ts::date as day from base)"


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.realised_vol(I.base(bars(spark, sf_dir)), (24,))
    pos = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    return b.select("symbol", pos.alias("pos"), "ts", "close", (F.col("rv_24") * F.sqrt(F.lit(48.0))).alias("sigma"), F.to_date("ts").alias("day"))


BARRIER_SQL = f"""with {POS_SQL}, ev as (select * from pb where pos >= 24 and (pos - 24) % 12 = 0 and sigma > 0),
path as (select e.symbol, e.pos as e, e.ts as t0, e.sigma, p.pos as p, p.ts as p_ts, ln(p.close / e.close) as r, case when ln(p.close / e.close) >= 1.5 * e.sigma then 1 when ln(p.close / e.close) <= -1.5 * e.sigma then -1 end as side
  from ev e join pb p on p.symbol = e.symbol and p.pos > e.pos and p.pos <= e.pos + 48 SAME_SEGMENT),
tch as (select symbol, e, t0, sigma, min(case when side is not null then p end) as tp, max(p) as lp from path group by 1, 2, 3, 4),
lab as (select t.symbol, t.e as pos0, x.p as pos1, t.t0, x.p_ts as t1, x.r as ret, coalesce(case when t.tp is not null then x.side end, 0) as label, case when t.tp is null then 'vertical' when x.side = 1 then 'upper' else 'lower' end as barrier, t.sigma, x.p - t.e as n_bars
  from tch t join path x on x.symbol = t.symbol and x.e = t.e and x.p = coalesce(t.tp, t.lp) where t.tp is not null WHOLE)"""
LABELS_SQL = BARRIER_SQL.replace("SAME_SEGMENT", "").replace("WHOLE", "or t.lp - t.e = 48")
LABEL_COLUMNS = "symbol, pos0::bigint as pos0, pos1::bigint as pos1, t0, t1, round(ret, 6) as ret, label::int as label, barrier, n_bars::bigint as n_bars"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _positions(spark, sf_dir)
    return L.triple_barrier(b, L.grid_events(b, 12, 24), 48)


def _shape(df: DataFrame) -> DataFrame:
    return df.select("symbol", F.col("pos0").cast("long"), F.col("pos1").cast("long"), "t0", "t1", "ret", F.col("label").cast("int"), "barrier", F.col("n_bars").cast("long"))


@add(f"{LABELS_SQL} select {LABEL_COLUMNS} from lab")
def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(_labels(spark, sf_dir))


@add(BARRIER_SQL.replace("SAME_SEGMENT", "and p.day = e.day").replace("WHOLE", "or true") + f" select {LABEL_COLUMNS} from lab")
def triple_barrier_roll_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _positions(spark, sf_dir)
    return _shape(L.triple_barrier(b, L.grid_events(b, 12, 24), 48, roll_close="day"))


UNIQUE_SQL = """, m as (select symbol, p, sum(d) as d from (select symbol, pos0 as p, 1 as d from lab union all select symbol, pos1 + 1, -1 from lab) group by 1, 2),
r as (select symbol, p, sum(d) over w as c, lead(p) over w as nxt from m window w as (partition by symbol order by p)),
area as (select l.symbol, l.pos0, sum(case when r.c > 0 then (least(r.nxt, l.pos1 + 1) - greatest(r.p, l.pos0)) / r.c::double end) / (l.pos1 + 1 - l.pos0) as u from lab l join r on r.symbol = l.symbol and r.p <= l.pos1 and r.nxt > l.pos0 group by l.symbol, l.pos0, l.pos1),
dec as (select *, u * (0.5 + 0.5 * sum(u) over (partition by symbol order by pos0) / sum(u) over (partition by symbol)) as w from area)"""


@add(f"{LABELS_SQL}{UNIQUE_SQL} select symbol, pos0::bigint as pos0, round(u, 6) as avg_uniqueness, round(w / avg(w) over (partition by symbol), 6) as weight from dec")
def uniqueness_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.uniqueness(_labels(spark, sf_dir), decay_oldest=0.5).select("symbol", F.col("pos0").cast("long"), "avg_uniqueness", "weight")


@add(f"{LABELS_SQL} select symbol, pos0::bigint as pos0, (case when label <> 0 then sign(label) when ret > 0 then 1 else -1 end)::int as direction, (case when label <> 0 then (sign(label) * ret > 0)::int else null end) as meta_label from lab")
def directional_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.meta_label(L.direction(_labels(spark, sf_dir)), "label", "ret")
    return d.select("symbol", F.col("pos0").cast("long"), "direction", "meta_label")


# --- cross-validation -----------------------------------------------------------------------------------------------------------------------

SPANS_SQL = "lb as (select event_id as id, ts as t0, ts + to_hours((event_id % 7 + 1)::int) as t1, row_number() over (order by ts, event_id) - 1 as row from events), nn as (select count(*) as n from lb)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("id"), ts.alias("t0"), (ts + F.make_interval(hours=(F.col("event_id") % 7 + 1).cast("int"))).alias("t1"))


@add(f"""with {SPANS_SQL}, f as (select row, ntile(6) over (order by row) - 1 as split from lb), runs as (select split, min(lb.row) as a, max(lb.row) as b, min(t0) as lo, max(t1) as hi from f join lb on f.row = lb.row group by split)
select split::int as split, row::int as row, 'test' as role from f union all select runs.split::int, lb.row::int, 'train' from lb, runs, nn
where not (lb.t0 <= runs.hi and lb.t1 >= runs.lo) and not (lb.row between runs.a and runs.b) and not (lb.row > runs.b and lb.row <= runs.b + ceil(0.01 * n))""")
def purged_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CV.purged_kfold(_spans(spark, sf_dir)).select(F.col("split").cast("int"), F.col("row").cast("int"), "role")


@add(f"""with {SPANS_SQL}, f as (select row, ntile(6) over (order by row) - 1 as fold from lb), c as (select a.i as g1, b.i as g2, row_number() over (order by a.i, b.i) - 1 as split from range(6) a(i), range(6) b(i) where a.i < b.i),
u as (select split, g1 as fold from c union all select split, g2 from c), pth as (select split, fold, row_number() over (partition by fold order by split) - 1 as path from u),
t as (select pth.split, f.row, pth.path from f join pth on f.fold = pth.fold),
runs as (select split, min(row) as a, max(row) as b, min(t0) as lo, max(t1) as hi from (select t.split, lb.row, t0, t1, lb.row - row_number() over (partition by t.split order by lb.row) as k from t join lb on t.row = lb.row) group by split, k),
tr as (select c.split, lb.row from c, lb where not exists (select 1 from runs, nn where runs.split = c.split and ((lb.t0 <= hi and lb.t1 >= lo) or lb.row between a and b or (lb.row > b and lb.row <= b + ceil(0.01 * n)))))
select split::int as split, role, path::int as path, count(*)::bigint as n, sum(row)::bigint as rows_sum from (select split, row, 'test' as role, path from t union all select split, row, 'train', null from tr) group by 1, 2, 3""")
def cpcv_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CV.cpcv(_spans(spark, sf_dir)).groupBy(F.col("split").cast("int").alias("split"), "role", F.col("path").cast("int").alias("path")).agg(F.count("*").alias("n"), F.sum("row").cast("long").alias("rows_sum"))


@add(f"""with {SPANS_SQL}, f as (select *, ntile(6) over (order by row) - 1 as fold from lb), s as (select fold as split_fold, min(t0) as start from f where fold > 0 group by fold)
select (fold - 1)::int as split, row::int as row, 'test' as role from f where fold > 0 union all select (s.split_fold - 1)::int, f.row::int, 'train' from f join s on f.fold < s.split_fold where f.t1 < s.start""")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CV.walk_forward(_spans(spark, sf_dir)).select(F.col("split").cast("int"), F.col("row").cast("int"), "role")


# --- volatility -----------------------------------------------------------------------------------------------------------------------------

RV_SQL = f"""{TICKS_SQL}, gr as (select symbol, ts::date as day, g.i as grid, floor((epoch_us(ts) - g.i * 1440000000) / 7200000000) as cell, arg_max(price, ts) as close from t, range(5) g(i) group by 1, 2, 3, 4),
rr as (select *, ln(close) - lag(ln(close)) over (partition by symbol, day, grid order by cell) as r from gr),
rg as (select symbol, day, grid, sum(r * r) as rv, count(r) as n from rr group by 1, 2, 3), rvd as (select * from (select symbol, day, avg(rv) as rv, max(case when grid = 0 then n end) as n_returns from rg group by 1, 2) where n_returns >= 3 and rv > 0)"""


def _rv(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).select("symbol", F.to_date("ts").alias("day"), "ts", F.col("price").alias("close"))
    return V.daily_variance(t, "day", 7_200_000_000, 5, 3, ["symbol"])


def _har(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.har_predictors(_rv(spark, sf_dir), ["symbol"], "day", lags=(1, 3, 5))
    return V.forward_log_variance(d, ["symbol"], "day", 1)


def _day(n: int) -> str:
    return f"partition by symbol order by day rows between {n - 1} preceding and current row"


HAR_SQL = RV_SQL + ", har as (select *, " + ", ".join(f"case when count(rv) over ({_day(n)}) >= {n} then ln(avg(rv) over ({_day(n)})) end as har_{n}" for n in (1, 3, 5)) + ", ln(lead(rv) over (partition by symbol order by day)) as fwd_1 from rvd)"


@add(f"with {RV_SQL} select symbol, day, round(rv, 10) as rv, n_returns::bigint as n_returns from rvd", digits=10)
def rv_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rv(spark, sf_dir)


@add(f"with {HAR_SQL} select symbol, day, round(har_1, 6) as har_1, round(har_3, 6) as har_3, round(har_5, 6) as har_5, round(fwd_1, 6) as fwd_1 from har")
def har_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _har(spark, sf_dir).select("symbol", "day", "har_1", "har_3", "har_5", "fwd_1")


@add(f"""with {RV_SQL}, m as (select *, case when count(rv) over ({_day(5)}) >= 5 then avg(rv) over ({_day(5)}) end as m from rvd)
select symbol, day, case when m is not null then case when m > quantile_cont(m, 0.5) over (partition by symbol order by day rows between unbounded preceding and current row) then 'high' else 'low' end end as regime from m""")
def variance_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.regime(_rv(spark, sf_dir), ["symbol"], "day", 5).select("symbol", "day", "regime")


@add(f"with {BARS_SQL}, d as (select symbol, ts::date as day, arg_min(open, ts) as o, arg_max(close, ts) as c from bars group by 1, 2) select symbol, day, round(ln(c) - ln(o), 6) as day_ret from d")
def day_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.day_return(bars(spark, sf_dir).withColumn("day", F.to_date("ts")), "day", ["symbol"])


def _covs(y: str, x: str, table_: str) -> str:
    return f"select symbol, count(*) as n, avg({x} * {y}) - avg({x}) * avg({y}) as cxy, avg({x} * {x}) - avg({x}) * avg({x}) as cxx, avg({y}) as my, avg({x}) as mx from {table_} where {x} is not null and {y} is not null group by symbol"


@add(f"with {HAR_SQL}, m as ({_covs('fwd_1', 'har_1', 'har')}) select symbol, n::bigint as n, round(my - cxy / cxx * mx, 6) as b_0, round(cxy / cxx, 6) as b_har_1 from m")
def har_ols_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ols(_har(spark, sf_dir), "fwd_1", ["har_1"], ["symbol"])


@add(f"""with {HAR_SQL}, m as (select symbol, count(*) as n, avg(fwd_1) as y, avg(har_1) as a, avg(har_3) as b, avg(har_5) as c, avg(har_1 * har_1) - avg(har_1) * avg(har_1) as aa, avg(har_1 * har_3) - avg(har_1) * avg(har_3) as ab, avg(har_1 * har_5) - avg(har_1) * avg(har_5) as ac, avg(har_3 * har_3) - avg(har_3) * avg(har_3) as bb, avg(har_3 * har_5) - avg(har_3) * avg(har_5) as bc, avg(har_5 * har_5) - avg(har_5) * avg(har_5) as cc, avg(har_1 * fwd_1) - avg(har_1) * avg(fwd_1) as ay, avg(har_3 * fwd_1) - avg(har_3) * avg(fwd_1) as by_, avg(har_5 * fwd_1) - avg(har_5) * avg(fwd_1) as cy from har where fwd_1 is not null and har_1 is not null and har_3 is not null and har_5 is not null group by symbol),
d as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det from m),
k as (select *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det as k1, (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det as k3, (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det as k5 from d)
select symbol, n::bigint as n, round(y - k1 * a - k3 * b - k5 * c, 6) as b_0, round(k1, 6) as b_har_1, round(k3, 6) as b_har_3, round(k5, 6) as b_har_5 from k""")
def har_ols_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ols(_har(spark, sf_dir), "fwd_1", ["har_1", "har_3", "har_5"], ["symbol"])


@add(f"""with {HAR_SQL}, d as (select symbol, greatest(-30, least(30, fwd_1 - har_1)) as a, greatest(-30, least(30, fwd_1 - har_5)) as b from har where fwd_1 is not null and har_5 is not null)
select symbol, count(*)::bigint as n, round(avg(exp(a) - a - 1), 6) as qlike_rw, round(avg(exp(b) - b - 1), 6) as qlike_mean, round(sqrt(avg(a * a)), 6) as rmse_rw, round(avg(abs(a)), 6) as mae_rw from d group by symbol""")
def qlike_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _har(spark, sf_dir).where("fwd_1 is not null and har_5 is not null")
    a = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("fwd_1") - F.col("har_1")))
    return h.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(V.qlike("fwd_1", "har_1")).alias("qlike_rw"), F.avg(V.qlike("fwd_1", "har_5")).alias("qlike_mean"), F.sqrt(F.avg(a * a)).alias("rmse_rw"), F.avg(F.abs(a)).alias("mae_rw"))


T_SQL = "exp(lgamma((n - 1 + 1) / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * 3.141592653589793)"


@add(f"""with {HAR_SQL}, d as (select symbol, day, greatest(-30, least(30, fwd_1 - har_5)) as a, greatest(-30, least(30, fwd_1 - har_1)) as b from har where fwd_1 is not null and har_5 is not null), x as (select symbol, (exp(a) - a) - (exp(b) - b) as x from d),
g as (select symbol, count(*) as n, avg(x) / sqrt(var_pop(x) / count(*)) * sqrt((count(*) - 1.0) / count(*)) as stat from x group by 1)
select symbol, round(stat, 6) as stat, n::bigint as n, round(0.5 + stat / 6000.0 * {T_SQL} * (select sum((case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end) * power(1 + power(stat * i / 2000.0, 2) / (n - 1), -n / 2.0)) from range(2001) r(i)), 6) as p from g""")
def diebold_mariano(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _har(spark, sf_dir).where("fwd_1 is not null and har_5 is not null").select("symbol", "day", V.qlike("fwd_1", "har_5").alias("a"), V.qlike("fwd_1", "har_1").alias("b"))
    return RS.diebold_mariano(h, ["symbol"], "day", "a", "b")


@add("with recursive " + RV_SQL + ", b as (select *, row_number() over (partition by symbol order by day) as rn from rvd), " + recursion("e", "b", {"y": ("rv", 1 - 0.94)}) + " select b.symbol, b.day, round(e.y, 10) as ewma_var from b join e on b.symbol = e.symbol and b.rn = e.rn", digits=10)
def risk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.risk_metrics(_rv(spark, sf_dir), ["symbol"], "day", "rv", "ewma_var").select("symbol", "day", "ewma_var")


@add("with recursive " + RV_SQL + ", b as (select *, row_number() over (partition by symbol order by day) as rn, avg(rv) over (partition by symbol) as m from rvd), e as (select symbol, rn, 0.000001 + 0.1 * rv + 0.85 * m as y from b where rn = 1 union all select s.symbol, s.rn, 0.000001 + 0.1 * s.rv + 0.85 * p.y from e p join b s on s.symbol = p.symbol and s.rn = p.rn + 1) select b.symbol, b.day, round(e.y, 10) as garch_var from b join e on b.symbol = e.symbol and b.rn = e.rn", digits=10)
def garch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.garch(_rv(spark, sf_dir), ["symbol"], ["day"], "rv", 1e-6, 0.1, 0.85).select("symbol", "day", "garch_var")


@add(f"""with {RV_SQL}, d as (select symbol, ts::date as day, arg_min(price, ts) as o, arg_max(price, ts) as c from t group by 1, 2), j as (select r.symbol, r.day, r.rv, lead(ln(d.c) - ln(d.o)) over (partition by r.symbol order by r.day) as nxt from rvd r join d on r.symbol = d.symbol and r.day = d.day),
w as (select *, greatest(0, least(1.5, 0.00012 / nullif(5 * rv, 0))) as w_mv, greatest(0.1, least(1.5, 0.1 / nullif(sqrt(rv * 252), 0))) as w_vt from j)
select symbol, day, round(w_mv, 6) as w_mv, round(w_vt, 6) as w_vt, round(abs(w_vt - coalesce(lag(w_vt) over (partition by symbol order by day), 0)), 6) as turnover, round(w_vt * nxt - abs(w_vt - coalesce(lag(w_vt) over (partition by symbol order by day), 0)) * 0.0000498, 6) as net_ret from w""")
def econ_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).select("symbol", "ts", F.col("price").alias("open"), F.col("price").alias("close"), F.to_date("ts").alias("day"))
    j = _rv(spark, sf_dir).join(V.day_return(t, "day", ["symbol"]), ["symbol", "day"])
    j = j.withColumn("next_ret", F.lead("day_ret").over(Window.partitionBy("symbol").orderBy("day")))
    return V.net_returns(V.overlay(j, "rv", 1.2e-4), ["symbol"], "day", "w_vt", "next_ret", 4.98e-5).select("symbol", "day", "w_mv", "w_vt", "turnover", "net_ret")


# --- statistics -----------------------------------------------------------------------------------------------------------------------------


@add(f"""with {BARS_SQL}, r as (select symbol, ln(close) - lag(ln(close)) over (partition by symbol order by ts) as x from bars), m as (select symbol, count(*) as n, avg(x) as m1, avg(x * x) as m2, avg(x * x * x) as m3, avg(x * x * x * x) as m4 from r where x is not null group by symbol)
select symbol, n::bigint as n, round(m1 / nullif(sqrt(greatest(m2 - m1 * m1, 0) * n / nullif(n - 1, 0)), 0), 6) as sharpe, round((m3 - 3 * m1 * m2 + 2 * power(m1, 3)) / nullif(power(m2 - m1 * m1, 1.5), 0), 6) as skew,
  round((m4 - 4 * m1 * m3 + 6 * power(m1, 2) * m2 - 3 * power(m1, 4)) / nullif((m2 - m1 * m1) * (m2 - m1 * m1), 0), 6) as kurt from m""")
def moments_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.moments(I.base(bars(spark, sf_dir)), ["symbol"], "ret_1")


def cdf_sql(x: str) -> str:
    """The normal distribution function of a column of the outer query, by Simpson's rule."""
    return f"(0.5 + {x} / 6000.0 * 0.3989422804014327 * (select sum((case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end) * exp(-0.5 * power({x} * i / 2000.0, 2))) from range(2001) r(i)))"


_Z = NormalDist().inv_cdf
TOP = 0.5772156649015329
TOP_SQL = f"({(1 - TOP) * _Z(1 - 1 / 5) + TOP * _Z(1 - 1 / (5 * 2.718281828459045))!r})"


def _moments_sql(x: str) -> str:
    return f"count(*) as n, avg({x}) as m1, avg(power({x}, 2)) as m2, avg(power({x}, 3)) as m3, avg(power({x}, 4)) as m4"


@add(f"""with {BARS_SQL}, r as (select symbol, ln(close) - lag(ln(close)) over (partition by symbol order by ts) as x from bars), m as (select symbol, {_moments_sql('x')} from r where x is not null group by symbol),
s as (select symbol, n, m1 / sqrt((m2 - m1 * m1) * n / (n - 1)) as sr, (m3 - 3 * m1 * m2 + 2 * power(m1, 3)) / power(m2 - m1 * m1, 1.5) as sk, (m4 - 4 * m1 * m3 + 6 * power(m1, 2) * m2 - 3 * power(m1, 4)) / power(m2 - m1 * m1, 2) as ku from m),
z as (select symbol, sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) as a, (sr - sqrt((select var_samp(sr) from s)) * {TOP_SQL}) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) as b from s)
select symbol, round({cdf_sql('z.a')}, 6) as psr, round({cdf_sql('z.b')}, 6) as dsr from z""")
def psr_dsr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.moments(I.base(bars(spark, sf_dir)), ["symbol"], "ret_1").collect()  # a row a symbol
    var = float(np.var([r["sharpe"] for r in rows], ddof=1)) if len(rows) > 1 else 0.0
    out = [(r["symbol"], S.psr(r["sharpe"], 0.0, r["n"], r["skew"], r["kurt"]), S.deflated_sharpe(r["sharpe"], var, len(rows), r["n"], r["skew"], r["kurt"])) for r in rows]
    return spark.createDataFrame(out, "symbol string, psr double, dsr double")


@add()
def bootstrap_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether click's daily return is above error's, by resampled days; random, so without SQL."""
    d = V.day_return(bars(spark, sf_dir).withColumn("day", F.to_date("ts")), "day", ["symbol"]).groupBy("day").pivot("symbol", ["click", "error"]).agg(F.first("day_ret"))
    series = RS.placed(d.select(F.lit("click - error").alias("pair"), "day", (F.coalesce("click", F.lit(0.0)) - F.coalesce("error", F.lit(0.0))).alias("d")), ["pair"], "day", "d")
    return RS.stationary_bootstrap(series, ["pair"]).select("p", "mean", F.col("n").cast("int").alias("n"))


@add(f"with {RV_SQL} select symbol, round(corr(rv, n_returns), 6) as corr, round(regr_slope(rv, n_returns) * 1000000, 6) as slope_ppm from rvd group by symbol")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no day of a symbol has another number of returns both are NaN, as in the SQL."""
    undefined = lambda c: F.coalesce(c, F.lit(float("nan")))
    return _rv(spark, sf_dir).groupBy("symbol").agg(undefined(X.corr("rv", "n_returns")).alias("corr"), undefined(X.slope("rv", "n_returns") * 1_000_000).alias("slope_ppm"))


# --- quality --------------------------------------------------------------------------------------------------------------------------------

DEFECTS_SQL = BARS_SQL + """, db as (select symbol as contract_id, ts, open, case when hour(ts) = 3 then low - 1 else high end as high, low, close, ts + case when hour(ts) = 5 then interval (-1) minute else interval 1 minute end as ts_ingest, close - 0.1 as bid, close + case when hour(ts) = 7 then -0.2 else 0.1 end as ask from bars),
dd as (select * from db union all select * from db where hour(ts) = 9)"""


@add(f"""with {DEFECTS_SQL}, gp as (select epoch_us(ts) - lag(epoch_us(ts)) over (partition by contract_id order by ts) as gap from dd)
select 'duplicates' as "check", (select coalesce(sum(c - 1), 0) from (select count(*) as c from dd group by contract_id, ts having count(*) > 1))::bigint as n
union all select 'ohlc', (select count(*) from dd where high < greatest(open, close, low) or low > least(open, close, high)) union all select 'ingest_before_event', (select count(*) from dd where ts_ingest < ts)
union all select 'crossed', (select count(*) from dd where bid > ask) union all select 'gaps', (select count(*) from gp where gap > 7200000000)""")
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.hour("ts")
    b = bars(spark, sf_dir).select(F.col("symbol").alias("contract_id"), "ts", "open", F.when(h == 3, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", "close", (F.col("ts") + F.when(h == 5, F.expr("interval -1 minute")).otherwise(F.expr("interval 1 minute"))).alias("ts_ingest"), (F.col("close") - 0.1).alias("bid"), (F.col("close") + F.when(h == 7, -0.2).otherwise(0.1)).alias("ask"))
    return QA.findings(b.unionByName(b.where(F.hour("ts") == 9)), ["contract_id", "ts"], step_us=3_600_000_000)


@add(f"with {TICKS_SQL} select symbol, instrument, count(*)::bigint as n, min(ts) as first_ts, max(ts) as last_ts from t group by 1, 2")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.coverage(ticks(spark, sf_dir), ["symbol", "instrument"])


@add(f"""with {BARS_SQL}, s as (select symbol, ts::date as day, count(*) as n from bars group by 1, 2), g as (select symbol, count(*) as sessions, min(n) as least, quantile_cont(n, 0.5) as median, max(n) as most from s group by symbol)
select g.symbol, sessions::bigint as sessions, least::bigint as least, round(median, 6) as median, most::bigint as most, (select count(*) from s where s.symbol = g.symbol and s.n < g.median / 3)::bigint as thin from g""")
def session_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.session_health(bars(spark, sf_dir).withColumn("day", F.to_date("ts")), "day", "symbol")


@add(f"""{LABELS_SQL}{UNIQUE_SQL} select l.symbol, count(*)::bigint as n, sum((label = 1)::int)::bigint as up, sum((label = 0)::int)::bigint as flat, sum((label = -1)::int)::bigint as down, sum((barrier = 'vertical')::int)::bigint as vertical,
round(quantile_cont(n_bars, 0.25), 6) as bars_q1, round(quantile_cont(n_bars, 0.5), 6) as bars_q2, round(quantile_cont(n_bars, 0.75), 6) as bars_q3, round(sum(u), 6) as effective_n from lab l join area a on a.symbol = l.symbol and a.pos0 = l.pos0 group by 1""")
def label_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.label_health(L.uniqueness(_labels(spark, sf_dir)))


@add(f"with {BASE_SQL}, f as (select ret_1, prev_close, case when rn > 15 then logc end as warm from base) select feature, round(null_rate, 6) as null_rate from (select 'ret_1' as feature, avg((ret_1 is null)::int) as null_rate from f union all select 'prev_close', avg((prev_close is null)::int) from f union all select 'warm', avg((warm is null)::int) from f) order by null_rate desc, feature limit 2")
def top_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.base(bars(spark, sf_dir)).withColumn("warm", F.when(F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) > 15, F.col("logc")))
    return QA.null_rates(b, ["ret_1", "prev_close", "warm"], 2)


@add("select quality, (n_chars > 300)::int as pred, count(*)::bigint as n, round(sum(1.0), 6) as w from labels join documents using (doc_id) group by 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.confusion(_predicted(spark, sf_dir), "quality", "pred")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", (F.col("n_chars") > 300).cast("int").alias("pred"), "toxic")


@add("""with c as (select quality as t, (n_chars > 300)::int as p from labels join documents using (doc_id)), k as (select distinct t as cls from c union select distinct p from c),
s as (select cls, (select count(*) from c where t = cls) as members, (select count(*) from c where p = cls) as predicted, (select count(*) from c where t = cls and p = cls) as hits from k)
select cls, members::bigint as members, predicted::bigint as predicted, round(coalesce(hits / nullif(predicted, 0)::double, 0), 6) as precision, round(coalesce(hits / nullif(members, 0)::double, 0), 6) as recall,
round(coalesce(2 * hits / nullif(predicted + members, 0)::double, 0), 6) as f1 from s""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.class_scores(QA.confusion(_predicted(spark, sf_dir), "quality", "pred"), "quality", "pred")


@add("with g as (select quality, sum(1.0 + toxic)::double as mass from labels group by quality) select quality, round(mass, 6) as mass, round(sum(mass) over () / (count(*) over () * mass), 6) as class_weight from g")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.class_weights(table(spark, sf_dir, "labels").withColumn("w", F.lit(1.0) + F.col("toxic")), "quality", "w")


@add(f"with {BASE_SQL}, f as (select case when rn % 7 = 0 then null else symbol end as label, case when rn % 11 = 0 then 'Infinity'::double else ret_1 end as x, case when rn % 13 = 0 then null else logc end as y from base) select sum((label is null)::int)::bigint as null_required, sum((label is not null and x = 'Infinity'::double)::int)::bigint as infinite, sum((label is not null and x is null and y is null)::int)::bigint as unmatched, sum((label is not null and coalesce(x <> 'Infinity'::double, true) and not (x is null and y is null))::int)::bigint as kept from f")
def row_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    f = I.base(bars(spark, sf_dir)).withColumn("rn", rn).select(F.when(F.col("rn") % 7 != 0, F.col("symbol")).alias("label"), F.when(F.col("rn") % 11 == 0, float("inf")).otherwise(F.col("ret_1")).alias("x"), F.when(F.col("rn") % 13 != 0, F.col("logc")).alias("y"))
    return QA.staged_rows(f, ["label"], ["x", "y"])
