"""Queries of whole studies: matrices, bases, forecast arms, gate batteries, economic value, window news, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import boosting as B
from ..operators import cv as CV
from ..operators import indicators as I
from ..operators import labels as L
from ..operators import modeling as M
from ..operators import news as N
from ..operators import quality as QA
from ..operators import recurrences as R
from ..operators import selection as SE
from ..operators import studies as ST
from ..operators import volatility as V
from ..operators.asof import asof_attach
from .domain import BARS_SQL, TICKS_SQL, Catalogue, bars, table, ticks
from .market_queries import BASE_SQL, recursion
from .model_queries import STEPS_SQL, _forecasts, _matrix
from .news_queries import NEWS_SQL, _window_sql, news
from .news_queries import TARGETS_SQL as NEWS_TARGETS_SQL
from .news_queries import _targets as news_targets
from .research_queries import HAR_SQL, LABELS_SQL, RV_SQL, UNIQUE_SQL, _day, _har, _labels, _moments_sql, _rv

catalogue = Catalogue()
add = catalogue.add


# --- matrices --------------------------------------------------------------------------------------------------------------------------------------


@add(f"""{LABELS_SQL}{UNIQUE_SQL}, j as (select l.symbol, l.t0, l.t1, l.label, l.ret, a.u, a.u / avg(a.u) over (partition by l.symbol) as weight from lab l join area a on a.symbol = l.symbol and a.pos0 = l.pos0),
k as (select j.*, b.ret_1, b.logc from j asof left join base b on j.symbol = b.symbol and j.t0 >= b.ts)
select symbol, t0, t1, label::int as label, round(ret, 6) as ret, round(u, 6) as avg_uniqueness, round(weight, 6) as weight, round(ret_1, 6) as ret_1, round(logc, 6) as logc, (case when label <> 0 then sign(label) when ret > 0 then 1 else -1 end)::int as direction from k where ret_1 is not null and logc is not null""")
def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with weights, features as of their start, gated rows, the directional target."""
    m = ST.training_matrix(L.uniqueness(_labels(spark, sf_dir)), I.base(bars(spark, sf_dir)), ["ret_1", "logc"])
    return m.select("symbol", "t0", "t1", F.col("label").cast("int").alias("label"), "ret", "avg_uniqueness", "weight", "ret_1", "logc", "direction")


WIDE = 45
_WIDE_SQL = ", ".join(f"l_extendedprice * {i + 1} / (l_quantity + {i}) as f{i}" for i in range(WIDE))


@add(f"""with f as (select l_shipdate + to_microseconds(((l_orderkey * 8 + l_linenumber) * 4 + k)::bigint) as ts, {_WIDE_SQL} from lineitem, (values (0), (1), (2), (3)) x(k)), lab as (select doc_id, timestamp '1994-01-01' + to_seconds((doc_id * 7919 % 100000000)::bigint) as t0 from documents)
select lab.doc_id, {", ".join(f"round(f.f{i}, 6) as f{i}" for i in range(WIDE))} from lab asof left join f on lab.t0 >= f.ts""")
def matrix_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four feature rows of 45 columns a line item, as of one time a document: the wide side is read, not sorted."""
    li = table(spark, sf_dir, "lineitem")
    k = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k")
    f = li.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", k)
    f = f.select(F.timestamp_micros(X.us("l_shipdate") + (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4 + F.col("k")).alias("ts"), *[(F.col("l_extendedprice") * (i + 1) / (F.col("l_quantity") + i)).alias(f"f{i}") for i in range(WIDE)])
    lab = table(spark, sf_dir, "documents").select("doc_id", F.timestamp_micros(X.us(F.lit("1994-01-01").cast("timestamp")) + (F.col("doc_id") * 7919 % 100_000_000) * 1_000_000).alias("t0"))
    return asof_attach(lab, f, ["doc_id"], "t0", "ts", [], [f"f{i}" for i in range(WIDE)], bucket_us=30 * 86_400_000_000).drop("t0")


RV_ONLY, BARS_ONLY = RV_SQL[len(TICKS_SQL) + 2 :], BARS_SQL[len(TICKS_SQL) + 2 :]  # without the ticks they begin with
CLOSE_SQL = f"{BASE_SQL}, {RV_ONLY}, tc as (select symbol, ts::date as day, max(ts) as t_close from t group by 1, 2), bs as (select r.symbol, r.day, tc.t_close, r.rv from rvd r join tc on r.symbol = tc.symbol and r.day = tc.day)"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = ticks(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max("ts").alias("t_close"))
    return _rv(spark, sf_dir).join(close, ["symbol", "day"]).select("symbol", F.col("day").alias("session_date"), "t_close", "rv")


@add(f"""with {CLOSE_SQL}, h as (select *, {", ".join(f"case when count(rv) over ({_day(n)}) >= {n} then ln(avg(rv) over ({_day(n)})) end as har_{n}" for n in (1, 3, 5))}, case when count(rv) over (partition by symbol order by day rows between 1 following and 2 following) = 2 then ln(avg(rv) over (partition by symbol order by day rows between 1 following and 2 following)) end as fwd_2,
  coalesce(lead(t_close, 2) over (partition by symbol order by day), max(t_close) over (partition by symbol)) as t1 from bs), f as (select h.*, b.ts as f_ts, b.logc as f_logc from h asof left join base b on h.symbol = b.symbol and h.t_close >= b.ts)
select symbol, day as session_date, t_close as t0, t1, round(har_1, 6) as har_1, round(har_3, 6) as har_3, round(har_5, 6) as har_5, round(fwd_2, 6) as fwd_2, case when ((f_ts at time zone 'UTC') at time zone 'America/New_York')::date = day then round(f_logc, 6) end as logc from f where har_1 is not null and har_3 is not null and har_5 is not null and fwd_2 is not null""")
def volatility_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ST.volatility_base(_sessions(spark, sf_dir), I.base(bars(spark, sf_dir)), ("logc",), horizon=2, lags=(1, 3, 5))
    return b.select("symbol", "session_date", "t0", "t1", "har_1", "har_3", "har_5", "fwd_2", "logc")


# --- arms and gates ----------------------------------------------------------------------------------------------------------------------------------

ARMS_SQL = f"""{STEPS_SQL.replace('with ', 'with recursive ', 1)}, nb as (select *, row_number() over (partition by symbol order by day) as rn, avg(rv) over (partition by symbol) as m from rvd), {recursion("ew", "nb", {"y": ("rv", 1 - 0.94)})},
gv as (select symbol, rn, 0.000001 + 0.1 * rv + 0.85 * m as y from nb where rn = 1 union all select s.symbol, s.rn, 0.000001 + 0.1 * s.rv + 0.85 * p.y from gv p join nb s on s.symbol = p.symbol and s.rn = p.rn + 1),
rg2 as (select symbol, day, case when count(rv) over ({_day(5)}) >= 5 then avg(rv) over ({_day(5)}) end as m from rvd), rgm as (select symbol, day, case when m is not null then case when m > quantile_cont(m, 0.5) over (partition by symbol order by day rows between unbounded preceding and current row) then 'high' else 'low' end end as regime from rg2),
arms as (select fc.symbol, fc.day, fc.step as fold, rgm.regime, fc.fwd_1, fc.forecast as f_har, fc.har_1 as f_rw, ln(ew.y) as f_ewma, ln(gv.y) as f_garch from fc join nb on fc.symbol = nb.symbol and fc.day = nb.day join ew on ew.symbol = nb.symbol and ew.rn = nb.rn join gv on gv.symbol = nb.symbol and gv.rn = nb.rn join rgm on rgm.symbol = fc.symbol and rgm.day = fc.day)"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rv = _rv(spark, sf_dir)
    f = _forecasts(spark, sf_dir).select("symbol", "day", F.col("step").alias("fold"), "fwd_1", F.col("forecast").alias("f_har"), F.col("har_1").alias("f_rw"))
    ewma = R.risk_metrics(rv, ["symbol"], "day", "rv", "y").select("symbol", "day", F.ln("y").alias("f_ewma"))
    garch = R.garch(rv, ["symbol"], ["day"], "rv", 1e-6, 0.1, 0.85).select("symbol", "day", F.ln("garch_var").alias("f_garch"))
    return f.join(ewma, ["symbol", "day"]).join(garch, ["symbol", "day"]).join(V.regime(rv, ["symbol"], "day", 5).select("symbol", "day", "regime"), ["symbol", "day"])


@add(f"{ARMS_SQL} select symbol, day, fold, regime, round(f_har, 6) as f_har, round(f_rw, 6) as f_rw, round(f_ewma, 6) as f_ewma, round(f_garch, 6) as f_garch from arms")
def forecast_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample forecasts of every arm on the same rows."""
    return _arms(spark, sf_dir).drop("fwd_1")


def _qlike_sql(f: str) -> str:
    d = f"greatest(-30, least(30, fwd_1 - {f}))"
    return f"exp({d}) - {d} - 1"


@add()
def fitted_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean QLIKE by symbol of the regression, of GARCH fitted anew on each fold's past returns, and of trees boosted on QLIKE on each fold's past rows; fits have no SQL."""
    f = _forecasts(spark, sf_dir).select("symbol", "day", F.col("step").alias("fold"), "fwd_1", "har_1", F.col("forecast").alias("f_har"))
    span = f.groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = V.day_return(bars(spark, sf_dir).withColumn("day", F.to_date("ts")), "day", ["symbol"]).join(span, "symbol").join(f.select("symbol", "day", "fold"), ["symbol", "day"], "left")
    days = days.where("day <= hi and (day < lo or fold is not null)").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    garch = R.garch_arm(days, ["symbol"], "day", "day_ret").select("symbol", "day", "f_garch")
    rows = _har(spark, sf_dir).where("fwd_1 is not null and har_5 is not null").join(days.select("symbol", "day", "fold"), ["symbol", "day"])
    rows = rows.select("symbol", "day", "fold", F.concat_ws(":", "symbol", "day").alias("id"), F.col("day").cast("timestamp").alias("t0"), "har_1", "har_3", "har_5", F.col("fwd_1").alias("y"), F.lit(1.0).alias("w"))
    rows = CV.numbered(rows)
    last = rows.agg(F.max("fold").alias("last"))
    splits = rows.join(F.broadcast(last)).select("row", "fold", F.explode(F.sequence(F.greatest(F.col("fold"), F.lit(0)), "last")).alias("split"))
    splits = splits.select("split", "row", F.when(F.col("fold") < F.col("split"), "train").otherwise("test").alias("role"))
    features = ["har_1", "har_3", "har_5"]
    trees = B.predict(rows, splits, features, B.fit(rows, splits, features, B.qlike(), B.Settings(rounds=6, depth=2, min_rows=5, rate=0.3)), B.qlike())
    trees = trees.join(rows.select(F.col("row").cast("int").alias("row"), "symbol", "day"), "row").select("symbol", "day", F.col("pred").alias("f_tree"))
    arms = ["f_har", "f_garch", "f_tree"]
    loss = ST.losses(f.join(garch, ["symbol", "day"]).join(trees, ["symbol", "day"]), arms, "fwd_1", ["symbol", "day", "fold"])
    return loss.groupBy("symbol", "arm").agg(F.count("*").alias("n"), F.avg("loss").alias("loss"))


@add(f"""{ARMS_SQL}, q as (select *, {_qlike_sql('f_har')} as har, {_qlike_sql('f_rw')} as rw, {_qlike_sql('f_ewma')} as ew, {_qlike_sql('f_garch')} as gc from arms where f_har is not null and f_rw is not null and f_ewma is not null and f_garch is not null),
mm as (select symbol, avg(har) as har, avg(rw) as rw, avg(ew) as ew, avg(gc) as gc, count(*) as n from q group by 1), rgr as (select symbol, bool_and(ok) as every, count(*) as found from (select symbol, regime, avg(har) <= avg(rw) as ok from q where regime is not null group by 1, 2) group by 1),
ff as (select symbol, sum(ok::int) as won, count(*) as folds from (select symbol, fold, avg(har) < avg(rw) as ok from q group by 1, 2) group by 1)
select mm.symbol, round(har, 6) as loss_f_har, round(rw, 6) as loss_f_rw, round(ew, 6) as loss_f_ewma, round(gc, 6) as loss_f_garch, n::bigint as n, won::bigint as folds_won, folds::bigint as folds, har < rw and har < ew and har < gc as gate_accuracy, coalesce(every and found >= 2, false) as gate_regimes, won >= 3 as gate_folds,
  har < rw and har < ew and har < gc and coalesce(every and found >= 2, false) and won >= 3 as passed from mm left join rgr on mm.symbol = rgr.symbol left join ff on mm.symbol = ff.symbol""")
def horizon_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = ["f_har", "f_rw", "f_ewma", "f_garch"]
    return ST.battery(ST.losses(_arms(spark, sf_dir), arms, "fwd_1", ["symbol", "fold", "regime"]), "f_har", arms[1:], ["symbol"], min_folds=3)


TWO_SQL = f"""with {HAR_SQL}, ok as (select *, row_number() over (partition by symbol order by day) - 1 as p, count(*) over (partition by symbol) as n from har where fwd_1 is not null and har_1 is not null and har_5 is not null),
st as (select *, case when p < 8 then -1 else least(floor((p - 8) / greatest(ceil((n - 8) / 4.0), 1)), 3) end::int as step from ok), sp as (select distinct symbol, step from st where step >= 0),
mo as (select sp.symbol, sp.step, avg(fwd_1) as y, avg(har_1) as a, avg(har_5) as b, avg(har_1 * fwd_1) - avg(har_1) * avg(fwd_1) as ay, avg(har_5 * fwd_1) - avg(har_5) * avg(fwd_1) as by_, avg(har_1 * har_1) - avg(har_1) * avg(har_1) as aa, avg(har_5 * har_5) - avg(har_5) * avg(har_5) as bb, avg(har_1 * har_5) - avg(har_1) * avg(har_5) as ab
  from sp join st s on s.symbol = sp.symbol and s.step < sp.step group by 1, 2),
fc2 as (select st.symbol, st.day, st.step as fold, st.fwd_1, y + ay / aa * (har_1 - a) as f1, y + (ay * bb - by_ * ab) / (aa * bb - ab * ab) * (har_1 - a) + (by_ * aa - ay * ab) / (aa * bb - ab * ab) * (har_5 - b) as f2 from st join mo on st.symbol = mo.symbol and st.step = mo.step),
rg2 as (select symbol, day, case when count(rv) over ({_day(5)}) >= 5 then avg(rv) over ({_day(5)}) end as m from rvd), rgm as (select symbol, day, case when m is not null then case when m > quantile_cont(m, 0.5) over (partition by symbol order by day rows between unbounded preceding and current row) then 'high' else 'low' end end as regime from rg2),
q as (select f.symbol, f.fold, r.regime, {_qlike_sql('f1')} as base, {_qlike_sql('f2')} as aug from fc2 f join rgm r on f.symbol = r.symbol and f.day = r.day),
mm as (select symbol, avg(base) as base, avg(aug) as aug, count(*) as n from q group by 1), rgr as (select symbol, bool_and(ok) as every, count(*) as found from (select symbol, regime, avg(aug) <= avg(base) as ok from q where regime is not null group by 1, 2) group by 1),
ff as (select symbol, sum(ok::int) as won, count(*) as folds from (select symbol, fold, avg(aug) < avg(base) as ok from q group by 1, 2) group by 1),
vd as (select mm.symbol, base, aug, n, won, folds, aug < base as g1, coalesce(every and found >= 2, false) as g2, won >= 2 as g3, case when mm.symbol = 'view' then 0.1 else 0.9 end::double as coverage from mm left join rgr on mm.symbol = rgr.symbol left join ff on mm.symbol = ff.symbol)"""


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _har(spark, sf_dir).where("har_5 is not null")
    regime = V.regime(_rv(spark, sf_dir), ["symbol"], "day", 5).select("symbol", "day", "regime")
    arm = lambda xs: M.anchored_ols(d, "fwd_1", xs, ["symbol"], "day", 8, 4).join(regime, ["symbol", "day"]).select("symbol", "day", F.col("step").alias("fold"), "regime", V.qlike("fwd_1", "forecast").alias("loss"))
    coverage = d.select("symbol").distinct().withColumn("coverage", F.when(F.col("symbol") == "view", 0.1).otherwise(0.9))
    return ST.incremental(arm(["har_1"]), arm(["har_1", "har_5"]), coverage, ["symbol"], "day", 0.5, 2)


@add(f"{TWO_SQL} select symbol, round(aug, 6) as loss_augmented, round(base, 6) as loss_base, n::bigint as n, won::bigint as folds_won, folds::bigint as folds, g1 as gate_accuracy, g2 as gate_regimes, g3 as gate_folds, coverage >= 0.5 and g1 and g2 and g3 as passed, round(coverage, 6) as coverage, case when coverage >= 0.5 then 'run' else 'deferred_coverage' end as status from vd")
def incremental_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a second predictor lower the loss of the same rows? One symbol's coverage is too thin for a verdict."""
    return _incremental(spark, sf_dir)


@add(f"{TWO_SQL}, s as (select 'har_5' as block, coverage >= 0.5 and g1 and g2 and g3 as passed, coverage < 0.5 as deferred from vd) select block, count(*)::bigint as n, sum(passed::int)::bigint as passes, case when sum(deferred::int) = count(*) then 'deferred_coverage' when sum(passed::int) = count(*) then 'adds_incremental_value' when sum(passed::int) > 0 then 'fragile_single_symbol' else 'no_incremental_value' end as verdict from s group by 1")
def block_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.across_symbols(_incremental(spark, sf_dir).withColumn("block", F.lit("har_5")), ["block"])


def _clip(x: str, lo: float) -> str:
    return f"greatest({lo}, least(1.5, {x}))"


ECON_ARMS = ["static", "treat", "rw"]
ECON_SQL = f"""{STEPS_SQL}, {BARS_ONLY}, dr as (select symbol, ts::date as day, arg_min(open, ts) as o, arg_max(close, ts) as c from bars group by 1, 2), jr as (select r.symbol, r.day, r.rv, lead(ln(d.c) - ln(d.o)) over (partition by r.symbol order by r.day) as r_next from rvd r join dr d on r.symbol = d.symbol and r.day = d.day),
pa as (select fc.symbol, fc.day, fc.step as fold, jr.r_next, jr.rv as s2_rw, exp(fc.forecast) as s2_treat, (select avg(x.rv) from jr x where x.symbol = fc.symbol and x.day < (select min(y.day) from fc y where y.symbol = fc.symbol and y.step = fc.step)) as s2_static, 0.0002 as mu, case when fc.har_1 > -9 then 'high' else 'low' end as regime from fc join jr on fc.symbol = jr.symbol and fc.day = jr.day where jr.r_next is not null),
we as (select *, {", ".join(f"{_clip(f'mu / (5.0 * s2_{a})', 0.0)} as mv_{a}, {_clip(f'{0.10 / 252**0.5!r} / sqrt(s2_{a})', 0.1)} as vt_{a}" for a in ECON_ARMS)} from pa), fs as (select symbol, fold, {", ".join(f"sum(mv_{a}) as s_{a}" for a in ECON_ARMS)} from we group by 1, 2),
mt as (select symbol, fold, {", ".join(f"coalesce(case when sum(s_{a}) over w > 0 then sum(s_static) over w / sum(s_{a}) over w end, 1.0) as c_{a}" for a in ECON_ARMS)} from fs window w as (partition by symbol order by fold rows between unbounded preceding and 1 preceding)),
wm as (select we.*, {", ".join(f"{_clip(f'c_{a} * mv_{a}', 0.0)} as mvm_{a}" for a in ECON_ARMS)} from we join mt on we.symbol = mt.symbol and we.fold = mt.fold)"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = V.day_return(bars(spark, sf_dir).withColumn("day", F.to_date("ts")), "day", ["symbol"])
    j = _rv(spark, sf_dir).join(day, ["symbol", "day"])
    w = Window.partitionBy("symbol").orderBy("day")
    j = j.select("symbol", "day", F.lead("day_ret").over(w).alias("r_next"), F.col("rv").alias("s2_rw"), F.avg("rv").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_past"))
    f = _forecasts(spark, sf_dir).select("symbol", "day", F.col("step").alias("fold"), F.exp("forecast").alias("s2_treat"), F.when(F.col("har_1") > -9, "high").otherwise("low").alias("regime"))
    p = f.join(j, ["symbol", "day"])
    static = p.groupBy("symbol", "fold").agg(F.min_by("_past", "day").alias("s2_static"))
    return p.join(static, ["symbol", "fold"]).drop("_past").withColumn("mu", F.lit(0.0002)).where("r_next is not null")


@add(f"{ECON_SQL} select symbol, day, fold, " + ", ".join(f"round(mvm_{a}, 6) as mvm_{a}, round(vt_{a}, 6) as vt_{a}" for a in ECON_ARMS) + " from wm")
def econ_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-variance weights matched to the static exposure of earlier folds, and volatility-target weights, by arm."""
    return ST.exposures(_panel(spark, sf_dir), ECON_ARMS, ["symbol"]).select("symbol", "day", "fold", *[f"{w}_{a}" for a in ECON_ARMS for w in ("mvm", "vt")])


def _net(a: str, s: float) -> str:
    return f"(mvm_{a} * r_next - {2 * 1e-5 * s!r} * mvm_{a})"


def _util(a: str, s: float) -> str:
    return f"((1 + {_net(a, s)}) - {5 / 12!r} * (1 + {_net(a, s)}) * (1 + {_net(a, s)}))"


def _fee(k: str, s: float) -> str:
    a = 5 / 6
    qa, qb, qc = f"({0.5 * a!r} * count(r_next))", f"(count(r_next) - {a!r} * sum(1 + {_net('treat', s)}))", f"(sum({_util(k, s)}) - sum({_util('treat', s)}))"
    disc = f"({qb} * {qb} - 4 * {qa} * {qc})"
    r1, r2 = f"((-{qb} + sqrt(greatest({disc}, 0))) / (2 * {qa}))", f"((-{qb} - sqrt(greatest({disc}, 0))) / (2 * {qa}))"
    return f"case when {disc} >= 0 then case when abs({r1}) <= abs({r2}) then {r1} else {r2} end * 2520000 end"


def _vte(a: str) -> str:
    return f"case when stddev_samp(vt_{a} * r_next) > 0 then abs(ln(stddev_samp(vt_{a} * r_next) / {0.10 / 252**0.5!r})) end"


@add(f"""{ECON_SQL}, g as (select symbol, {_vte('treat')} as vte_treat, {_vte('static')} as vte_static, {_vte('rw')} as vte_rw, {_fee('static', 1.0)} as fee_static_plain, {_fee('static', 3.0)} as fee_static_stressed, {_fee('rw', 1.0)} as fee_rw_plain, {_fee('rw', 3.0)} as fee_rw_stressed, {_fee('static', 0.0)} as fee_gross,
  avg(mvm_treat) as w_treat, avg(mvm_static) as w_static, coalesce(case when isfinite(corr(mvm_treat - mvm_static, r_next)) then corr(mvm_treat - mvm_static, r_next) end, 0) as corr_static, coalesce(case when isfinite(corr(mvm_treat - mvm_rw, r_next)) then corr(mvm_treat - mvm_rw, r_next) end, 0) as corr_rw from wm group by 1),
r as (select symbol, min(coalesce(fee, -1e300)) as worst, count(*) as regimes from (select symbol, regime, {_fee('static', 1.0)} as fee from wm group by 1, 2) group by 1),
f as (select symbol, sum(v::int) as vte_folds, sum(us::int) as value_folds_static, sum(ur::int) as value_folds_rw from (select symbol, fold, coalesce({_vte('treat')} < {_vte('static')}, false) as v, avg({_util('treat', 1.0)}) > avg({_util('static', 1.0)}) as us, avg({_util('treat', 1.0)}) > avg({_util('rw', 1.0)}) as ur from wm group by 1, 2) group by 1)
select g.symbol, round(vte_treat, 6) as vte_treat, round(fee_static_plain, 4) as fee_static_plain, round(fee_rw_stressed, 4) as fee_rw_stressed, vte_folds::bigint as vte_folds, value_folds_static::bigint as value_folds_static, coalesce(vte_treat < vte_static and vte_treat < vte_rw, false) as g1_target_error, vte_folds >= 2 as g2_target_error_folds, coalesce(fee_static_plain > 0, false) as g3_value_static,
  coalesce(fee_rw_plain > 0, false) as g4_value_benchmarks, coalesce(fee_static_stressed > 0 and fee_rw_stressed > 0, false) as g5_stressed, coalesce(worst >= 0 and regimes >= 2, false) as g6_regimes, value_folds_static >= 2 and value_folds_rw >= 2 as g7_value_folds,
  coalesce(abs(w_treat - w_static) <= 0.1 * w_static and fee_static_stressed / case when fee_gross > 0 then fee_gross end >= 0.5, false) as g8_neutral, abs(corr_static) < 0.3 and abs(corr_rw) < 0.3 as e9_not_directional from g left join r on g.symbol = r.symbol join f on g.symbol = f.symbol""")
def econ_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ST.exposures(_panel(spark, sf_dir), ECON_ARMS, ["symbol"])
    g = ST.economic_gates(p, ECON_ARMS, "treat", ["symbol"], min_folds=2)
    g = g.withColumns({c: F.round(c, 4) for c in ("fee_static_plain", "fee_rw_stressed")})
    return g.select("symbol", "vte_treat", "fee_static_plain", "fee_rw_stressed", "vte_folds", "value_folds_static", *[c for c in g.columns if c[:2] in ("g1", "g2", "g3", "g4", "g5", "g6", "g7", "g8", "e9")])


@add()
def econ_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap test of the treatment's utility gain; its resampling has no SQL."""
    return ST.bootstrap_significance(ST.exposures(_panel(spark, sf_dir), ECON_ARMS, ["symbol"]), "treat", "static", ["symbol"], "day")


@add()
def qlike_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out forecasts of a linear model fitted to QLIKE itself; an iterative fit has no SQL."""
    d = _har(spark, sf_dir).where("fwd_1 is not null and har_5 is not null")
    d = d.select(F.concat_ws(":", "symbol", "day").alias("id"), F.col("day").cast("timestamp").alias("t0"), F.date_add("day", 1).cast("timestamp").alias("t1"), "har_1", "har_3", "har_5", F.col("fwd_1").alias("y"), F.lit(1.0).alias("w"))
    rows = CV.numbered(d)
    fits = M.fit_splits(rows, CV.walk_forward(d, 4), ["har_1", "har_3", "har_5"], {"qlike": ST.qlike_linear()})
    return fits.groupBy("split").agg(F.count("*").alias("n"), F.avg(V.qlike("y", "pred")).alias("loss"))


TREE_FEATURES = ["mom", "last", "sigma"]


def _three_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The matrix with its return as class 0 (down), 1 (within a twentieth of a deviation) or 2 (up), and its purged splits with inner validation."""
    m = _matrix(spark, sf_dir)
    near = F.col("sigma") / 20
    m = m.withColumn("y", F.when(F.col("ret") < -near, 0.0).when(F.col("ret") > near, 2.0).otherwise(1.0))
    return m, B.inner_validation(m, CV.purged_kfold(m.drop("row"), 2))


@add()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out accuracy of boosted trees of three classes under purged splits, stopped on a purged tail of each training set; fits have no SQL."""
    m, splits = _three_classes(spark, sf_dir)
    loss = B.softmax(3)
    preds = B.predict(m, splits, TREE_FEATURES, B.fit(m, splits, TREE_FEATURES, loss, B.Settings(rounds=6, depth=2, patience=3)), loss)
    return preds.groupBy("split").agg(F.count("*").alias("n"), (F.sum(F.when(F.col("pred") == F.col("y"), F.col("w"))) / F.sum("w")).alias("accuracy"))


@add()
def boosted_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean held-out QLIKE of trees boosted on QLIKE itself, walk-forward; fits have no SQL."""
    d = _har(spark, sf_dir).where("fwd_1 is not null and har_5 is not null")
    d = d.select(F.concat_ws(":", "symbol", "day").alias("id"), F.col("day").cast("timestamp").alias("t0"), F.date_add("day", 1).cast("timestamp").alias("t1"), "har_1", "har_3", "har_5", F.col("fwd_1").alias("y"), F.lit(1.0).alias("w"))
    rows, features = CV.numbered(d), ["har_1", "har_3", "har_5"]
    splits = B.inner_validation(rows, CV.walk_forward(d, 3))
    preds = B.predict(rows, splits, features, B.fit(rows, splits, features, B.qlike(), B.Settings(rounds=8, depth=2, min_rows=10, patience=4)), B.qlike())
    return preds.groupBy("split").agg(F.count("*").alias("n"), F.avg(V.qlike("y", "pred")).alias("loss"))


@add()
def tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's share of the absolute contributions to held-out margins, by split and class; fits have no SQL."""
    m, splits = _three_classes(spark, sf_dir)
    forests = B.fit(m, splits, TREE_FEATURES, B.softmax(3), B.Settings(rounds=4, depth=2, patience=3))
    return B.attribution_shares(B.contributions(m, splits, TREE_FEATURES, forests), TREE_FEATURES, ["split", "class"])


@add()
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much held-out accuracy each feature carries, by shuffling it; random, so without SQL."""
    m = _matrix(spark, sf_dir)
    return ST.permutation_importance(m, CV.purged_kfold(m.drop("row"), 4), ["mom", "last", "sigma"], M.logistic())


@add()
def evaluation_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinatorial paths of three estimators with the probability of overfitting among them; fits have no SQL."""
    m = _matrix(spark, sf_dir)
    pooled, by_path, signed = ST.evaluate(m, CV.cpcv(m.drop("row"), 4, 2), ["mom", "last", "sigma"], {"logistic": M.logistic(), "majority": M.majority(), "momentum": M.momentum()})
    spread = M.summary(by_path, ["estimator"], "accuracy").withColumnRenamed("mean", "path_mean")
    return pooled.join(spread, "estimator").join(ST.overfitting(signed, 6))


# --- scores of fixed signals --------------------------------------------------------------------------------------------------------------------------

MATRIX_SQL = f"""{LABELS_SQL}{UNIQUE_SQL}, ft as (select symbol, pos, ln(close / lag(close, 5) over w) as mom, sigma, ln(close / lag(close, 1) over w) as last from pb window w as (partition by symbol order by pos)),
mj as (select l.symbol, l.pos0, l.t0, l.ret, case when l.label <> 0 then sign(l.label) when l.ret > 0 then 1 else -1 end as y, a.u / avg(a.u) over (partition by l.symbol) as w, f.mom, f.last, f.sigma from lab l join area a on a.symbol = l.symbol and a.pos0 = l.pos0 join ft f on f.symbol = l.symbol and f.pos = l.pos0),
mx as (select *, row_number() over (order by t0, symbol || ':' || pos0) - 1 as row, count(*) over () as n from mj where mom is not null and last is not null and sigma is not null),
sc as (select *, case when row < (n % 4) * (n // 4 + 1) then row // (n // 4 + 1) else n % 4 + (row - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) end as split, case when mom > 0 then 1 else -1 end as pred from mx)"""


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = _matrix(spark, sf_dir)
    return m, M.fit_splits(m, CV.purged_kfold(m.drop("row"), 4), ["mom", "last", "sigma"], {"momentum": M.momentum()})


@add(f"""{MATRIX_SQL}, ac as (select split, sum(w * (pred = y)::int) / sum(w) as accuracy from sc group by 1) select 'momentum' as estimator, round(avg(accuracy), 6) as mean, round(stddev_pop(accuracy), 6) as std, round(min(accuracy), 6) as min, round(quantile_cont(accuracy, 0.5), 6) as median, round(max(accuracy), 6) as max from ac""")
def path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(M.accuracy(_signals(spark, sf_dir)[1], ["estimator", "split"]), ["estimator"], "accuracy")


@add(f"""{MATRIX_SQL}, g as (select {_moments_sql('pred * ret')} from sc), e as (select {_moments_sql('(pred - 1) * ret')} from sc) select 'momentum' as estimator, g.n::bigint as n, round(g.m1 / nullif(sqrt(greatest(g.m2 - g.m1 * g.m1, 0) * g.n / nullif(g.n - 1, 0)), 0), 6) as gross_sharpe,
  round((g.m3 - 3 * g.m1 * g.m2 + 2 * power(g.m1, 3)) / nullif(power(g.m2 - g.m1 * g.m1, 1.5), 0), 6) as gross_skew, round((g.m4 - 4 * g.m1 * g.m3 + 6 * power(g.m1, 2) * g.m2 - 3 * power(g.m1, 4)) / nullif(power(g.m2 - g.m1 * g.m1, 2), 0), 6) as gross_kurt,
  round(e.m1 / nullif(sqrt(greatest(e.m2 - e.m1 * e.m1, 0) * e.n / nullif(e.n - 1, 0)), 0), 6) as excess_sharpe from g, e""")
def signal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, p = _signals(spark, sf_dir)
    return M.signal_returns(p.join(m.select("row", "ret"), "row"), ["estimator"])


@add("with g as (select event_id % 5 as fold, event_type as label, sum(value) as mass from events group by 1, 2) select fold::int as fold, label, round(mass, 6) as mass, round(sum(mass) over (partition by fold) / (count(*) over (partition by fold) * mass), 6) as class_weight from g")
def fold_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 5).cast("int").alias("fold"), F.col("event_type").alias("label"), "value")
    return QA.fold_class_weights(e, "fold", "label", "value")


# --- statistics ---------------------------------------------------------------------------------------------------------------------------------------


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.day_return(bars(spark, sf_dir).withColumn("day", F.to_date("ts")), "day", ["symbol"])
    every = d.select("day").distinct().withColumn("symbol", F.explode(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))))
    return every.join(d, ["symbol", "day"], "left").select("symbol", "day", F.coalesce("day_ret", F.lit(0.0)).alias("r"))


@add(f"""with {BARS_SQL}, d as (select symbol, ts::date as day, ln(arg_max(close, ts)) - ln(arg_min(open, ts)) as r from bars group by 1, 2), dy as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n from (select distinct day from d)),
pt as (select day, case when i < (n % 10) * (n // 10 + 1) then i // (n // 10 + 1) else n % 10 + (i - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1) end as p from dy), sy as (select distinct symbol from d),
ce as (select pt.p, sy.symbol, count(*) as n, sum(coalesce(d.r, 0)) as s, sum(power(coalesce(d.r, 0), 2)) as q from pt cross join sy left join d on d.day = pt.day and d.symbol = sy.symbol group by 1, 2), co as (select i from range(1024) r(i) where bit_count(i::int) = 5),
io as (select co.i, ce.symbol, ((co.i >> ce.p::int) & 1) as inside, sum(n) as n, sum(s) as s, sum(q) as q from co cross join ce group by 1, 2, 3), sh as (select i, symbol, inside, case when (q - s * s / n) / (n - 1) > 1e-18 then s / n / sqrt((q - s * s / n) / (n - 1)) else 0 end as sr from io),
be as (select i, symbol from (select *, row_number() over (partition by i order by sr desc, symbol) as k from sh where inside = 1) where k = 1),
rk as (select be.i, (select sum((o.sr < me.sr)::int) + (sum((o.sr = me.sr)::int) + 1) / 2.0 from sh o where o.i = be.i and o.inside = 0) / 6.0 as w from be join sh me on me.i = be.i and me.symbol = be.symbol and me.inside = 0)
select round(avg((w <= 0.5)::int), 6) as pbo, count(*)::int as n_splits from rk""")
def overfitting_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.overfitting(_daily(spark, sf_dir), 10, "symbol", "day")


@add(f"""with {BARS_SQL}, gd as (select symbol, ts::date as day, ln(arg_max(close, ts)) - ln(arg_min(open, ts)) as r from bars group by 1, 2),
gs as (select symbol, day, r, sign(r)::int as t, sign(lag(r) over (partition by symbol order by day))::int as p from gd), gg as (select *, p * r as g, day(day) % 3 as path from gs where p is not null),
gm as (select symbol, avg(g) as mean_gross, avg((p <> 0)::int) as action_rate from gg group by 1),
gp as (select symbol, quantile_cont(sharpe, 0.5) as path_median_sharpe from (select symbol, path, avg(g) / nullif(stddev_samp(g), 0) as sharpe from gg group by 1, 2) group by 1),
gf as (select symbol, avg(f1) as macro_f1 from (select symbol, c, coalesce(2.0 * sum((t = c and p = c)::int) / nullif(sum((t = c)::int) + sum((p = c)::int), 0), 0) as f1 from gg, (values (-1), (0), (1)) x(c) group by 1, 2) group by 1),
st as (select gm.*, path_median_sharpe, macro_f1, (select pbo from ({catalogue.sql["overfitting_probability"]})) as pbo from gm join gp using (symbol) join gf using (symbol))
select symbol, round(mean_gross, 6) as mean_gross, round(action_rate, 6) as action_rate, round(path_median_sharpe, 6) as path_median_sharpe, round(macro_f1, 6) as macro_f1, round(pbo, 6) as pbo, coalesce(pbo < 0.5, false) as gate_pbo, false as gate_dsr,
  coalesce(mean_gross > 0, false) as gate_gross, coalesce(action_rate >= 0.05, false) as gate_action, coalesce(path_median_sharpe > 0, false) as gate_paths, coalesce(macro_f1 >= 0.34, false) as gate_f1, false as passed from st""")
def signal_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six gates of yesterday's direction as today's signal, by symbol; one signal is no trial series, so its deflated ratio is missing and fails."""
    d = V.day_return(bars(spark, sf_dir).withColumn("day", F.to_date("ts")), "day", ["symbol"])
    w = Window.partitionBy("symbol").orderBy("day")
    g = d.select("symbol", "day", F.col("day_ret").alias("r"), F.signum("day_ret").cast("int").alias("t"), F.signum(F.lag("day_ret").over(w)).cast("int").alias("p")).where("p is not null").withColumn("g", F.col("p") * F.col("r"))
    paths = V.moments(g.withColumn("path", F.day("day") % 3), ["symbol", "path"], "g").groupBy("symbol").agg(F.percentile("sharpe", 0.5).alias("path_median_sharpe"))
    stats = g.groupBy("symbol").agg(F.avg("g").alias("mean_gross"), F.avg((F.col("p") != 0).cast("double")).alias("action_rate"))
    stats = stats.join(paths, "symbol").join(SE.macro_f1(g, "t", "p", [-1, 0, 1], ["symbol"]), "symbol")
    stats = stats.join(F.broadcast(ST.overfitting(_daily(spark, sf_dir), 10, "symbol", "day").select("pbo"))).withColumn("dsr", F.lit(None).cast("double"))
    return SE.judged(stats, SE.micro_gates()).drop("dsr")


# --- window news ----------------------------------------------------------------------------------------------------------------------------------------


def _group_sql(column: str, value: str, m: int) -> str:
    return f"""(select count(*) from news x where x.{column} = '{value}' and not x.degraded and x.observed_at <= tg.ts and x.observed_at > tg.ts - interval {m} minute)::bigint as "{column}_{value}_n_{m}",
  round((select avg(x.sentiment_score) from news x where x.{column} = '{value}' and not x.degraded and x.observed_at <= tg.ts and x.observed_at > tg.ts - interval {m} minute), 6) as "{column}_{value}_mean_{m}\""""


@add(f"with {NEWS_SQL}, {NEWS_TARGETS_SQL} select tg.id, {_group_sql('source', 'web', 240)}, {_group_sql('source', 'books', 240)} from tg")
def sentiment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window sentiment by source."""
    return N.sentiment_by_group(news(spark, sf_dir), news_targets(spark, sf_dir), [240], "source", ["web", "books"]).drop("ts")


@add(f"{LABELS_SQL}, {NEWS_SQL}, tg as (select symbol || ':' || pos0 as id, t0 as ts from lab), {_window_sql(1440)} select w1440.id, n::bigint as n_1440, round(mean, 6) as mean_1440, nd::bigint as n_degraded_1440 from w1440")
def sentiment_onto_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label with the news before its start; the scored events come twice and count once."""
    n = news(spark, sf_dir).select(F.col("doc_id").cast("string").alias("content_hash"), "observed_at", F.col("observed_at").alias("scored_at"), "positive_score", "negative_score", "neutral_score", "sentiment_score", "degraded", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model_name"))
    lab = _labels(spark, sf_dir).select(F.concat_ws(":", "symbol", F.col("pos0").cast("string")).alias("id"), "t0")
    return N.attach_sentiment(lab, n, [1440]).select("id", "n_1440", "mean_1440", "n_degraded_1440")


@add("with d as (select distinct o_orderdate::date as day from orders), r as (select min(l_shipdate)::date as lo, max(l_shipdate)::date as hi from lineitem where l_quantity > 49) select round(avg((day between lo and hi)::int), 6) as coverage from d, r")
def range_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return QA.range_coverage(days, table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.to_date("l_shipdate").alias("obs_date")))


@add("with d as (select distinct o_orderdate::date as day from orders) select round(avg((day in (select l_shipdate::date from lineitem where l_quantity > 49))::int), 6) as coverage from d")
def day_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return QA.day_coverage(days, table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.to_date("l_shipdate").alias("day")))


@add(f"with {BASE_SQL} select symbol, count(*)::bigint as n, round(avg((rn <= 60)::int), 6) as degraded_share, round(avg(((ret_1 is null)::int + (prev_close is null)::int) / 2.0), 6) as missing_share from base group by 1")
def feature_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.base(bars(spark, sf_dir)).withColumn("degraded", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) <= 60)
    return QA.feature_health(b, ["ret_1", "prev_close"])


@add(f"with {BASE_SQL} select symbol, ts, round(ret_1, 6) as ret_1 from base where ret_1 is not null and volume > 0 and 1 / nullif(hour(ts) % 5, 0) is not null")
def finite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with finite features only: every fifth hour holds an infinity, first rows a null."""
    b = I.base(bars(spark, sf_dir)).withColumn("x", F.when(F.hour("ts") % 5 == 0, F.lit(float("inf"))).otherwise(1.0))
    return QA.finite_rows(b, ["symbol"], ["ret_1", "x"]).select("symbol", "ts", "ret_1")


@add(f"with {BARS_SQL} select symbol, ts, case when hour(ts) % 5 <> 0 then 1.0 end as x from bars")
def infinities_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("x", F.when(F.hour("ts") % 5 == 0, F.lit(float("-inf"))).otherwise(1.0))
    return b.select("symbol", "ts", X.clean("x").alias("x"))


@add(f"with {TICKS_SQL} select event_id, symbol, instrument from t")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks in the one order that does not depend on how they were made."""
    t = ticks(spark, sf_dir).select("event_id", "symbol", "instrument", F.col("ts").alias("ts_event"), F.col("instrument").alias("con_id"))
    return QA.canonical(t).select("event_id", "symbol", "instrument")


@add(f"with {BARS_SQL}, x as (select *, case when hour(ts) = 4 then -1 else 0 end as late, row_number() over (partition by symbol order by ts) as rn from bars), y as (select *, ts + case when late = -1 then interval (-3) hour else interval 0 hour end as seen from x) select (select count(*) from (select seen < lag(seen) over (partition by symbol order by rn) as back from y) where back)::bigint as n")
def not_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive older than the one before them."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    b = bars(spark, sf_dir).withColumn("arrival", place).withColumn("ts", F.when(F.hour("ts") == 4, F.col("ts") - F.expr("interval 3 hours")).otherwise(F.col("ts")))
    found = QA.findings(b.select("symbol", "ts", "arrival"), ["symbol", "arrival"], series="symbol", arrival="arrival")
    return found.where("check = 'not_monotonic'").select("n")
