"""Queries that compose families: feature tables, out-of-sample forecasts, evaluation and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import cv as CV
from ..operators import labels as L
from ..operators import meta as ME
from ..operators import modeling as M
from ..operators import scorers as SC
from ..operators import selection as SE
from ..operators import volatility as V
from .domain import BARS_SQL, TICKS_SQL, Catalogue, bars, table, ticks
from .features import FeatureConfig, compute_features
from .market_queries import LOCAL
from .market_queries import catalogue as market
from .news_queries import HEADLINE_SQL, NEG, POS, WORDS_SQL, _headlines
from .research_queries import HAR_SQL, LABELS_SQL, _har, _labels, _positions
from .shipping import shared_folder

catalogue = Catalogue()
add = catalogue.add

SMALL = FeatureConfig(returns=(1, 5, 15), roc=(15,), zscores=(30,), vols=(15,), rvols=(30,), volume_z=60, regime=(120, 30), warmup=60)
FAMILIES = {
    "returns_roc": "ret_1, ret_5, ret_15, roc_15", "ema_macd": "macd, macd_signal, macd_hist, ema_slope_12, ema_dist_z_12, ema_slope_26, ema_dist_z_26", "adx": "adx_14", "rsi": "rsi_14", "bollinger_zscore": "bb_pctb_20, zscore_30", "realized_vol": "rv_15",
    "atr": "atr_pct_14", "parkinson_gk": "parkinson_30, gk_30", "vol_regime": "vol_regime", "rvol_vol_z": "rvol_30, vol_z_60", "rvol_tod": "rvol_tod", "obv_norm": "obv_norm_60", "vwap_dist": "vwap_dist", "stoch": "stoch_k, stoch_d", "cci": "cci", "mfi": "mfi",
    "vortex": "vortex_pos, vortex_neg", "trix": "trix_15", "degraded_flag": "degraded",
}
TIMES_SQL = f"""select symbol, ts, round(sin(m * (2 * 3.141592653589793 / 1440)), 6) as mod_sin, round(cos(m * (2 * 3.141592653589793 / 1440)), 6) as mod_cos, round(sin(d * (2 * 3.141592653589793 / 7)), 6) as dow_sin, round(cos(d * (2 * 3.141592653589793 / 7)), 6) as dow_cos,
  (m - 570)::int as mins_since_open, (960 - m)::int as mins_to_close, 'v1' as feature_version from (select symbol, ts, (hour(l) * 60 + minute(l))::bigint as m, (isodow(l) - 1)::bigint as d from (select symbol, ts, {LOCAL} as l from bars))"""
FEATURES_SQL = f"with {BARS_SQL}, times as ({TIMES_SQL}) select symbol, ts, {', '.join(FAMILIES.values())}, mod_sin, mod_cos, dow_sin, dow_cos, mins_since_open, mins_to_close, feature_version from times " + " ".join(f"join ({market.sql[k]}) using (symbol, ts)" for k in FAMILIES)


@add(FEATURES_SQL)
def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composition of all families, against the join of their own SQL."""
    return compute_features(bars(spark, sf_dir), SMALL, ("2024-01-05", "2024-01-12"))


@add(f"{LABELS_SQL} select lab.symbol, lab.pos0::bigint as pos0, round(pb.close, 6) as f_close, round(pb.sigma, 6) as f_sigma from lab asof left join pb on lab.symbol = pb.symbol and lab.t0 >= pb.ts")
def labels_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label row with the features as of its start."""
    lab = _labels(spark, sf_dir).select("symbol", "pos0", "t0")
    j = A.asof_join(lab, _positions(spark, sf_dir).select("symbol", "ts", "close", "sigma"), on="t0", right_on="ts", by=["symbol"], take=["close", "sigma"], prefix="f_", bucket_us=7 * A.DAY_US)
    return j.selectExpr("symbol", "cast(pos0 as long) as pos0", "f_close", "f_sigma")


STEPS_SQL = f"""with {HAR_SQL}, ok as (select *, row_number() over (partition by symbol order by day) - 1 as p, count(*) over (partition by symbol) as n from har where fwd_1 is not null and har_1 is not null),
st as (select *, case when p < 10 then -1 else least(floor((p - 10) / greatest(ceil((n - 10) / 6.0), 1)), 5) end::int as step from ok),
fc as (select a.symbol, a.day, a.step, a.fwd_1, a.har_1, (select avg(b.fwd_1) - (avg(b.har_1 * b.fwd_1) - avg(b.har_1) * avg(b.fwd_1)) / (avg(b.har_1 * b.har_1) - avg(b.har_1) * avg(b.har_1)) * (avg(b.har_1) - a.har_1) from st b where b.symbol = a.symbol and b.step < a.step) as forecast from st a where a.step >= 0)"""


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.anchored_ols(_har(spark, sf_dir), "fwd_1", ["har_1"], ["symbol"], "day", 10, 6)


@add(STEPS_SQL + " select symbol, day, step, round(forecast, 6) as forecast from fc")
def anchored_oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecasts(spark, sf_dir).select("symbol", "day", "step", "forecast")


@add(STEPS_SQL + """, q as (select symbol, avg(exp(greatest(-30, least(30, fwd_1 - forecast))) - greatest(-30, least(30, fwd_1 - forecast)) - 1) as har, avg(exp(greatest(-30, least(30, fwd_1 - har_1))) - greatest(-30, least(30, fwd_1 - har_1)) - 1) as rw, count(*) as n from fc group by symbol)
select symbol, har < rw as gate_beats_rw, n >= 10 as gate_enough, har < 2 as gate_level, (har < rw and n >= 10 and har < 2) as passed from q""")
def forecast_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _forecasts(spark, sf_dir).groupBy("symbol").agg(F.avg(V.qlike("fwd_1", "forecast")).alias("har"), F.avg(V.qlike("fwd_1", "har_1")).alias("rw"), F.count("*").alias("n"))
    return M.verdict(f.withColumn("gain", F.col("rw") - F.col("har")), {"beats_rw": ("gain", ">", 0.0), "enough": ("n", ">=", 10), "level": ("har", "<", 2.0)}, ["symbol"])


def _settled(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A written table: what follows reads it several times."""
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with three features at t0, weights and targets."""
    lab = L.direction(L.uniqueness(_labels(spark, sf_dir))).drop("sigma")
    b = _positions(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("pos")
    f = b.select("symbol", F.col("pos").alias("pos0"), F.ln(F.col("close") / F.lag("close", 5).over(w)).alias("mom"), "sigma", F.ln(F.col("close") / F.lag("close", 1).over(w)).alias("last"))
    m = lab.join(f, ["symbol", "pos0"]).dropna(subset=["mom", "sigma", "last"])
    m = m.withColumn("id", F.concat_ws(":", "symbol", F.col("pos0").cast("string")))
    m = _settled(spark, m.withColumn("y", F.col("direction").cast("double")), "matrix")
    return CV.numbered(m, "id").select("row", "id", "t0", "t1", "ret", F.col("mom"), F.col("last"), "sigma", "y", F.col("weight").alias("w"))


FIT_FEATURES = ["mom", "last", "sigma"]


def _preds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = _matrix(spark, sf_dir)
    splits = CV.purged_kfold(m.drop("row"), 4)
    fitted = SE.predict_logistic(m, splits, FIT_FEATURES, SE.fit_logistic(m, splits, FIT_FEATURES, {"logistic": 1.0}))
    return m, fitted.unionByName(SE.rule(m, splits, "majority")).unionByName(SE.rule(m, splits, "momentum", F.col("mom")))


@add()
def cv_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled purged K-fold accuracy of each estimator."""
    return M.accuracy(_preds(spark, sf_dir)[1], ["estimator"])


@add()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and deflated Sharpe ratio of each configuration of a small grid; the number of rows is the number of trials."""
    m = _matrix(spark, sf_dir)
    splits = CV.purged_kfold(m.drop("row"), 4)
    cells = SE.fit_logistic(m, splits, FIT_FEATURES, {f"l2={c['l2']}": c["l2"] for c in M.grid(l2=[0.1, 1.0, 10.0])})
    return SE.trials(SE.predict_logistic(m, splits, FIT_FEATURES, cells), m)


@add()
def selected_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a grid, put alone through combinatorial splits, with its six gates; fits have no SQL."""
    m = _matrix(spark, sf_dir)
    folds, paths = CV.purged_kfold(m.drop("row"), 4), CV.cpcv(m.drop("row"), 4, 2)
    return SE.search(m, folds, paths, FIT_FEATURES, {f"l2={x}": x for x in (0.1, 1.0, 10.0)})[1]


META_SQL = f"""{LABELS_SQL}, f as (select symbol, pos as pos0, ln(close / lag(close, 5) over (partition by symbol order by pos)) as mom from pb),
ms as (select symbol, pos0, ret, sign(mom)::int as side, abs(mom) as abs_mom, ((case when label <> 0 then sign(label) when ret > 0 then 1 else -1 end) = sign(mom))::int as meta, 1.0::double / (1 + n_bars) as w, abs(mom) / (abs(mom) + lab.sigma) as p from lab join f using (symbol, pos0) where sign(mom) <> 0),
bets as (select *, coalesce(p > 0.5, false) as acted, case when p > 0.5 then side else 0 end * ret as gross from ms)"""
STATS_SQL = """round(sum(gross * w) / sum(w), 6) as mean_gross, round(sum(side * ret * w) / sum(w), 6) as always_gross, round(avg(acted::int), 6) as action_rate, round(coalesce((avg(case when meta = 1 then acted::int end) + avg(case when meta = 0 then (not acted)::int end)) / 2,
avg(case when meta = 1 then acted::int end), avg(case when meta = 0 then (not acted)::int end)), 6) as balanced_accuracy, round(avg(case when acted then meta end), 6) as hit_acted, round(avg(meta), 6) as hit_always"""


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels whose five-bar momentum has a sign, timeouts by the sign of their return, with a probability that needs no fit."""
    w = Window.partitionBy("symbol").orderBy("pos")
    f = _positions(spark, sf_dir).select("symbol", F.col("pos").alias("pos0"), F.ln(F.col("close") / F.lag("close", 5).over(w)).alias("mom"))
    d = ME.meta_set(L.direction(_labels(spark, sf_dir)).join(f, ["symbol", "pos0"]), "mom", "direction")
    return d.withColumns({"w": 1.0 / (1 + F.col("n_bars")), "p": F.col("abs_mom") / (F.col("abs_mom") + F.col("sigma"))})


@add(META_SQL + " select symbol, pos0::bigint as pos0, side, meta, round(abs_mom, 6) as abs_mom from ms")
def meta_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).select("symbol", F.col("pos0").cast("long"), "side", "meta", "abs_mom")


@add(META_SQL + f" select symbol, count(*)::bigint as n, round(avg(gross) / stddev_samp(gross), 6) as sharpe, {STATS_SQL} from bets group by symbol")
def gated_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a gate on the primary side buys, by symbol."""
    return ME.bet_stats(ME.gated(_meta(spark, sf_dir), "p"), ["symbol"]).drop("skew", "kurt")


ARMS_SQL = META_SQL + """, arms as (select symbol, sum(side * ret * w) > 0 as b, sum(gross * w) > 0 and avg(acted::int) >= 0.05 and coalesce(avg(case when acted then meta end) > avg(meta), false) as t from bets group by symbol)"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every side taken against gated sides, on the same rows."""
    d = _settled(spark, _meta(spark, sf_dir), "arms")
    gates = {"gate_gross": F.col("mean_gross") > 0, "gate_action": F.col("action_rate") >= 0.05}

    def study(matrix: DataFrame, arm: str) -> DataFrame:
        if arm == "baseline":
            return SE.judged(ME.bet_stats(ME.gated(matrix.withColumn("p", F.lit(1.0)), "p"), ["symbol"]), gates)
        return SE.judged(ME.bet_stats(ME.gated(matrix, "p"), ["symbol"]), gates | {"gate_hits": F.coalesce(F.col("hit_acted") > F.col("hit_always"), F.lit(False))})

    return ME.paired_arms(d, d, ["symbol", "pos0", "meta", "ret", "w"], study, ["symbol"])


@add(ARMS_SQL + " select symbol, b as baseline_passed, t as treatment_passed, case when not t then 'null' when b then 'not_cleanly_attributable' else 'attributable' end as attribution from arms")
def arm_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir)


@add(ARMS_SQL + """, c as (select count(*)::bigint as n, count(*) filter (where t)::bigint as candidates from arms) select n, candidates, candidates > 0 and candidates < n as fragile,
case when candidates = 0 then 'no_significant_edge' when candidates = n then 'edge_candidate' else 'edge_candidate_fragile' end as overall from c""")
def arm_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ME.decision(_arms(spark, sf_dir))


@add()
def meta_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum as the primary side, a grid of gates under purged folds, the best through combinatorial splits, its six gates; fits have no SQL."""
    d = CV.numbered(_settled(spark, ME.meta_set(_matrix(spark, sf_dir).drop("row"), "mom", "y"), "meta_set"), "id")
    folds, paths = CV.purged_kfold(d.drop("row"), 4), CV.cpcv(d.drop("row"), 4, 2)
    return ME.meta_search(d, folds, paths, [*FIT_FEATURES, "abs_mom"], {f"l2={x}": x for x in (0.1, 1.0, 10.0)})[1]


@add(f"""{LABELS_SQL}, d as (select symbol, (ret > 0)::int as y, 1.0 / (1 + abs(n_bars - 24) / 24.0) as p from lab) select symbol, round((avg(case when y = 1 then (p > 0.5)::int end) + avg(case when y = 0 then (p <= 0.5)::int end)) / 2, 6) as balanced_accuracy, round(avg((p > 0.5)::int), 6) as action_rate,
round(avg(case when p > 0.5 then y end), 6) as hit_acted, round(avg(y), 6) as hit_always from d group by symbol""")
def meta_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labels(spark, sf_dir).select("symbol", (F.col("ret") > 0).cast("int").alias("y"), (1.0 / (1 + F.abs(F.col("n_bars") - 24) / 24.0)).alias("p"))
    return M.meta_skill(d, ["symbol"])


@add(f"with {TICKS_SQL}, a as (select symbol, avg(price) as m, count(*) as n from t where instrument = 0 group by 1), b as (select symbol, avg(price) as m, count(*) as n from t where instrument = 1 group by 1) select a.symbol, round(b.m - a.m, 6) as d_m, (b.n - a.n)::bigint as d_n from a join b on a.symbol = b.symbol")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    a, b = (t.where(F.col("instrument") == i).groupBy("symbol").agg(F.avg("price").alias("m"), F.count("*").alias("n")) for i in (0, 1))
    return M.compare_runs(a, b, ["symbol"], ["m", "n"])


@add("select (select count(*) from (select l_orderkey, l_linenumber from lineitem where l_quantity > 10 except all select l_orderkey, l_linenumber from lineitem where l_discount > 0.02))::bigint as only_a, (select count(*) from (select l_orderkey, l_linenumber from lineitem where l_discount > 0.02 except all select l_orderkey, l_linenumber from lineitem where l_quantity > 10))::bigint as only_b")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return M.same_rows(li.where("l_quantity > 10"), li.where("l_discount > 0.02"), ["l_orderkey", "l_linenumber"])


@add("""with h as (select ('0x' || substr(sha256(o_orderkey::varchar || chr(31) || o_custkey::varchar || chr(31) || o_orderpriority), 1, 15))::bigint as h from orders) select count(*)::bigint as n, sum(h::hugeint)::varchar as hash_sum from h""")
def frame_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


@add(f"""with h as (select n_nationkey, {HEADLINE_SQL} as text from nation), c as (select n_nationkey, len(list_filter({WORDS_SQL}, lambda w: list_contains({POS}, w))) as p, len(list_filter({WORDS_SQL}, lambda w: list_contains({NEG}, w))) as g from h)
select n_nationkey, round(p / (p + g + 1.0), 6) as positive_score, round(g / (p + g + 1.0), 6) as negative_score, round(1.0 / (p + g + 1.0), 6) as neutral_score, round((p - g) / (p + g + 1.0), 6) as sentiment_score from c""")
def scorer_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    SC.register("registered", SC.lexicon)
    return SC.score(_headlines(spark, sf_dir), "text", "registered").select("n_nationkey", "score.*")
