"""Queries through the store: writes, latest-ingest reads, contracts, macro and news lakes, parsers, caches and run summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import indicators as I
from ..operators import macro as M
from ..operators import news as N
from ..operators import quality as QA
from ..sources import lake as LK
from ..sources import plans as P
from ..sources.store import Store, parse_fixture, vendor_rows
from .domain import BARS_SQL, TICKS_SQL, Catalogue, bars, table, ticks
from .market_queries import BASE_SQL, LOCAL
from .news_queries import NEWS_SQL, TITLE_SQL, _lake_rows, news
from .research_queries import CONT_SQL, FRONT_SQL, LABELS_SQL, _labels, _rolls, contract_bars
from .shipping import shared_folder

catalogue = Catalogue()
add = catalogue.add
NY = "'America/New_York'"


def _store(spark: SparkSession, name: str) -> Store:
    return Store(spark, shared_folder(spark, name))


def utc(local: str) -> str:
    """SQL: local exchange time as UTC."""
    return f"(({local}) at time zone {NY}) at time zone 'UTC'"


# --- bars, quotes, rolls -----------------------------------------------------------------------------------------------------------------------


@add(f"with {BARS_SQL} select ts as ts_event, round(close + case when hour(ts) % 6 = 0 then 1 else 0 end, 6) as close, round(volume, 6) as volume from bars where symbol = 'click' and ts between timestamp '2024-01-05' and timestamp '2024-01-20'")
def store_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of one symbol whose every sixth hour was ingested twice: the later one counts."""
    store, rows = _store(spark, "store-bars"), _lake_rows(spark, sf_dir)
    again = rows.where("hour(ts_event) % 6 = 0").withColumns({"close": F.col("close") + 1, "ts_ingest": F.col("ts_ingest") + F.expr("interval 1 hour")})
    store.write("bars_1m", rows.unionByName(again))
    return store.bars("click", "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("ts_event", "close", "volume")


@add(f"with {BARS_SQL} select symbol, count(*)::bigint as n, sum((hour(ts) % 6 = 0)::int)::bigint as gone, round(sum(close + case when hour(ts) % 6 = 0 then 1 else 0 end), 6) as closes from bars group by symbol")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table compacted: one row a key is left, and reads see it."""
    store, rows = _store(spark, "compacted"), _lake_rows(spark, sf_dir)
    again = rows.where("hour(ts_event) % 6 = 0").withColumns({"close": F.col("close") + 1, "ts_ingest": F.col("ts_ingest") + F.expr("interval 1 hour")})
    store.write("bars_1m", rows.unionByName(again))
    before = store.scan("bars_1m").groupBy("symbol").agg(F.count("*").alias("before")).collect()  # a row a symbol
    store.compact("bars_1m")
    held = spark.createDataFrame(before, "symbol string, before long")
    return store.scan("bars_1m").groupBy("symbol").agg(F.count("*").alias("n"), F.sum("close").alias("closes")).join(held, "symbol").select("symbol", "n", (F.col("before") - F.col("n")).alias("gone"), "closes")


@add(f"select * from ({CONT_SQL}) where date between date '1994-01-01' and date '1996-12-31'")
def store_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored contract bars, rolls found and stored from them, and a window of the adjusted series."""
    store, b = _store(spark, "store-continuous"), contract_bars(spark, sf_dir)
    store.write("bars_1d", b.select(F.col("ts").alias("ts_event"), F.col("ts").alias("ts_ingest"), F.lit("LI").alias("symbol"), "contract_id", "con_id", "close", "volume"))
    store.build_continuous("LI", b.select("contract_id", "expiry").distinct(), freq="1d")
    s = store.bars("LI", "1994-01-01 00:00:00", "1996-12-31 00:00:00", "1d", continuous=True)
    return s.select(F.to_date("ts_event").alias("date"), "contract_id", "close", "raw_close", "adj_factor")


@add(f"with {FRONT_SQL} select roll_date, from_contract, to_contract from rolls")
def store_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll events written twice (the second write is new in nothing) and read back."""
    store = _store(spark, "store-rolls")
    found = _rolls(spark, sf_dir)[1]
    store.persist_rolls("LI", found)
    if store.persist_rolls("LI", found):
        raise AssertionError("a second write of the same rolls added rows")
    return store.rolls("LI").select(F.to_date("ts_event").alias("roll_date"), F.col("from_contract_id").alias("from_contract"), F.col("to_contract_id").alias("to_contract"))


@add("""with li as (select l_shipdate::date as date, l_returnflag as symbol, l_quantity, l_extendedprice / l_quantity as unit from lineitem),
q as (select *, (date_trunc('quarter', date) + to_months((3 + 3 * k)::int) - interval 1 day)::date as expiry from li, (values (0), (1)) x(k)),
cb as (select symbol, date, 'C' || strftime(expiry, '%Y%m') as contract_id, expiry, sum(l_quantity * (case when k = 0 then 1.0 else 1.0 + (dayofyear(date) % 91) / 30.0 - 1.5 end)) as volume from q group by symbol, date, expiry, k),
ranked as (select *, row_number() over w as r, lead(contract_id) over w as nxt, lead(volume) over w as nv from cb where expiry >= date window w as (partition by symbol, date order by expiry, contract_id)),
front as (select symbol, date, case when nxt is not null and (nv > volume or date_diff('day', date, expiry) <= 5) then nxt else contract_id end as front from ranked where r = 1)
select symbol, roll_date, from_contract, to_contract from (select symbol, date as roll_date, lag(front) over (partition by symbol order by date) as from_contract, front as to_contract from front) where from_contract <> to_contract""")
def rolls_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolls of several products at once, kept apart by their key."""
    from ..operators import continuous as C

    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_quantity", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    li = li.withColumn("expiry", F.to_date(F.last_day(F.add_months(F.date_trunc("quarter", "date"), 2 + 3 * F.col("k")))))
    w = F.when(F.col("k") == 0, 1.0).otherwise(1.0 + (F.dayofyear("date") % 91) / 30.0 - 1.5)
    b = li.groupBy("symbol", "date", "expiry", "k").agg(F.sum(F.col("l_quantity") * w).alias("volume"))
    b = b.select("symbol", F.col("date").cast("timestamp").alias("ts"), F.concat(F.lit("C"), F.date_format("expiry", "yyyyMM")).alias("contract_id"), "expiry", "volume", F.lit(0).cast("long").alias("con_id"))
    return C.rolls(C.front_month(C.daily_volume(b, ["symbol"]), keys=["symbol"]), ["symbol"])


@add(f"with {TICKS_SQL} select ts as ts_event, 'I' || instrument as contract_id, round(price - 0.05, 6) as bid, round(price + 0.05, 6) as ask from (select *, row_number() over (partition by ts, instrument order by event_id desc) as r from t where symbol = 'view') where r = 1 and ts between timestamp '2024-01-05' and timestamp '2024-01-20'")
def store_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, "store-quotes")
    q = ticks(spark, sf_dir).select(F.col("ts").alias("ts_event"), (F.col("ts") + F.make_dt_interval(secs=F.col("event_id"))).alias("ts_ingest"), "symbol", F.concat(F.lit("I"), "instrument").alias("contract_id"), (F.col("price") - 0.05).alias("bid"), (F.col("price") + 0.05).alias("ask"))
    store.write("quotes_l1", q)
    return store.quotes("view", "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("ts_event", "contract_id", "bid", "ask")


@add(f"""with e as (select *, {LOCAL} as l from events) select event_id as con_id, 'MX' as symbol, 'C' || (user_id % 3) as contract_id, round(value, 6) as close, 1 as schema_version,
case when isodow(l) < 6 and hour(l) * 60 + minute(l) >= 570 and hour(l) * 60 + minute(l) < 960 then 'RTH' else 'ETH' end as session, 'vendor' as source from e""")
def vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts_event"), F.concat(F.lit("C"), F.col("user_id") % 3).alias("symbol"), F.col("event_id").alias("instrument_id"), F.col("value").cast("string").alias("close"))
    return vendor_rows(e, "MX", "bars_1m").select("con_id", "symbol", "contract_id", "close", "schema_version", "session", "source")


@add(f"select distinct ts::date as day, {utc('ts::date + interval 570 minute')} as fetch_from, {utc('ts::date + interval 960 minute')} as fetch_to from events where isodow(ts) < 6")
def fetch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().where(F.weekday("day") < 5)
    return P.fetch_windows(days)


@add("select l_returnflag as symbol, round(sum(l_tax), 6) as cost, sum(l_quantity)::bigint as bytes, count(*)::bigint as days from lineitem group by 1")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.estimate_cost(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "symbol"), ["symbol"], "l_tax", "l_quantity")


@add("select l_orderkey, l_linenumber, coalesce(case when s_suppkey % 3 <> 0 then s_name end, 'id' || l_suppkey) as contract from lineitem left join supplier on l_suppkey = s_suppkey")
def contract_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("contract"))
    return P.contract_names(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), names, "l_suppkey").select("l_orderkey", "l_linenumber", "contract")


# --- features and labels -----------------------------------------------------------------------------------------------------------------------


@add(f"with {BASE_SQL}, f as (select ts, logc, ret_1 from base where symbol = 'view') select e.event_id, round(f.logc, 6) as logc, round(f.ret_1, 6) as ret_1 from (select * from events where event_type = 'click') e asof left join f on e.ts >= f.ts")
def store_features_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features stored by symbol, written twice, and attached to other times as of each."""
    store = _store(spark, "store-features")
    LK.feature_dataset("features_price", ["logc", "ret_1"])
    f = I.base(bars(spark, sf_dir)).select(F.col("ts").alias("ts_event"), F.col("ts").alias("ts_ingest"), "symbol", "logc", "ret_1", F.lit(False).alias("degraded"), F.lit("v1").alias("feature_version"))
    store.write("features_price", f)
    store.write("features_price", f)
    left = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "ts")
    return store.attach(left, "features_price", "view", ["logc", "ret_1"], on="ts").select("event_id", "logc", "ret_1")


@add(f"{LABELS_SQL} select t0, t1, label::int as label, round(ret, 6) as ret, n_bars::bigint as n_bars from lab where symbol = 'click' and t0 between timestamp '2024-01-05' and timestamp '2024-01-25'")
def store_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, "store-labels")
    store.write("labels", _labels(spark, sf_dir).withColumns({"ts_ingest": F.col("t0"), "label_version": F.lit("v1")}))
    return store.read_window("labels", "click", "2024-01-05 00:00:00", "2024-01-25 00:00:00").select("t0", "t1", "label", "ret", "n_bars")


# --- macro and market ----------------------------------------------------------------------------------------------------------------------------

PRINTS_SQL = """fp as (select case l_returnflag when 'A' then 'cpi' when 'N' then 'gdp' else 'nfp' end as event_type, l_returnflag as series_id, date_trunc('month', l_shipdate)::date as ref_period, round(avg(l_discount) * 100, 6) as value,
  (date_trunc('month', l_shipdate) + interval 1 month + interval 9 day)::date as release_date from lineitem group by 1, 2, 3, 5)"""
CLOCKS = {"cpi": 510, "gdp": 510, "nfp": 515}


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON payload of observations a series, every seventh value missing."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("m")).agg(F.round(F.avg("l_discount") * 100, 6).alias("value"))
    o = li.select("series_id", F.struct(F.date_format("m", "yyyy-MM-dd").alias("date"), F.when(F.month("m") == 7, ".").otherwise(F.col("value").cast("string")).alias("value"), F.date_format(F.date_add(F.add_months("m", 1), 9), "yyyy-MM-dd").alias("realtime_start")).alias("o"))
    return o.groupBy("series_id").agg(F.to_json(F.struct(F.collect_list("o").alias("observations"))).alias("payload"))  # a row a series


@add(f"with {PRINTS_SQL} select ref_period as obs_date, round(value, 6) as value, release_date from fp where month(ref_period) <> 7")
def first_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.observations(_payloads(spark, sf_dir), "payload")


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "cpi").when(F.col("l_returnflag") == "N", "gdp").otherwise("nfp")
    m = F.to_date(F.date_trunc("month", "l_shipdate"))
    return li.groupBy(kind.alias("event_type"), F.col("l_returnflag").alias("series_id"), m.alias("ref_period")).agg(F.round(F.avg("l_discount") * 100, 6).alias("value")).withColumn("release_date", F.date_add(F.add_months("ref_period", 1), 9))


EVENTS_SQL = f"""{PRINTS_SQL}, rel as (select {utc("release_date + to_minutes(case event_type when 'nfp' then 515 else 510 end)")} as event_time, event_type, ref_period, value as actual_pit, lag(value) over (partition by event_type order by ref_period) as prior from fp),
dd as (select distinct l_shipdate::date as day from lineitem where day(l_shipdate) = 15 and month(l_shipdate) % 3 = 0), rates as (select ref_period, avg(value) as value from fp group by 1),
fa as (select d.day, r.value as actual_pit from (select day, day + 3 as k from dd) d asof left join rates r on d.k >= r.ref_period), fb as (select d.day, r.value as prior from (select day, day - 3 as k from dd) d asof left join rates r on d.k >= r.ref_period),
ev as (select * from rel union all select {utc("fa.day + interval 840 minute")}, 'fomc', fa.day, fa.actual_pit, fb.prior from fa join fb on fa.day = fb.day)"""


def _macro_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    clocks = spark.createDataFrame(list(CLOCKS.items()), "event_type string, minute int")
    fp = _prints(spark, sf_dir)
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct().where("day(day) = 15 and month(day) % 3 = 0")
    rates = fp.groupBy("ref_period").agg(F.avg("value").alias("value"))
    return M.release_events(fp, clocks).unionByName(M.scheduled_events(days, rates, "fomc", "rate", 840))


@add(f"with {EVENTS_SQL} select event_time, event_type, ref_period, round(actual_pit, 6) as actual_pit, round(prior, 6) as prior from ev")
def macro_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases with their priors and the calendar meetings with the rate around them, through the store."""
    store = _store(spark, "macro-events")
    store.write("macro_events", _macro_events(spark, sf_dir).withColumns({"ingest_ts": F.current_timestamp(), "macro_version": F.lit("m1")}))
    return store.scan("macro_events").select("event_time", "event_type", "ref_period", "actual_pit", "prior")


@add(f"with {EVENTS_SQL} select event_type, count(*)::bigint as first_run, 0::bigint as second_run from ev group by 1")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows by type of an ingestion and of the same one again."""
    store = _store(spark, "ingest-counts")
    every = _macro_events(spark, sf_dir).withColumns({"ingest_ts": F.current_timestamp(), "macro_version": F.lit("m1")}).persist()
    try:
        parts = {t: every.where(F.col("event_type") == t) for t in ("cpi", "fomc", "gdp", "nfp")}
        first, second = M.ingest(store, "macro_events", parts), M.ingest(store, "macro_events", parts)
    finally:
        every.unpersist()
    return spark.createDataFrame([(t, first[t], second[t]) for t in parts], "event_type string, first_run long, second_run long")


TARGETS_SQL = "tg as (select o_orderkey as id, o_orderdate + to_minutes((o_orderkey * 37 % 1440)::int) as ts from orders)"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") * 37 % 1440).cast("int"))).alias("ts"))


def _timing_sql(name: str, condition: str) -> str:
    return f"""e_{name} as (select distinct event_time as e from ev where {condition}), p_{name} as (select tg.id, (epoch_us(tg.ts) - epoch_us(x.e)) / 60000000.0 as since from tg asof left join e_{name} x on tg.ts >= x.e),
n_{name} as (select tg.id, (epoch_us(x.e) - epoch_us(tg.ts)) / 60000000.0 as until from tg asof left join e_{name} x on tg.ts < x.e)"""


@add(f"""with {EVENTS_SQL}, {TARGETS_SQL}, {_timing_sql('cpi', "event_type = 'cpi'")}, {_timing_sql('fomc', "event_type = 'fomc'")}, {_timing_sql('event', "event_type in ('cpi', 'fomc', 'nfp')")},
ahead as (select a.id, a.n - b.n as n from (select tg.id, coalesce(c.n, 0) as n from tg asof left join (select e, row_number() over (order by e) as n from e_event) c on tg.ts + interval 24 hour >= c.e) a
  join (select tg.id, coalesce(c.n, 0) as n from tg asof left join (select e, row_number() over (order by e) as n from e_event) c on tg.ts >= c.e) b on a.id = b.id),
fd as (select distinct ((event_time at time zone 'UTC') at time zone {NY})::date as d from ev where event_type = 'fomc')
select tg.id, round(p_cpi.since, 6) as macro_mins_since_cpi, round(n_cpi.until, 6) as macro_mins_to_cpi, round(p_fomc.since, 6) as macro_mins_since_fomc, round(n_fomc.until, 6) as macro_mins_to_fomc, round(p_event.since, 6) as macro_mins_since_event,
  round(n_event.until, 6) as macro_mins_to_event, round(case when n_event.until <= 30 then 1.0 else 0.0 end, 6) as macro_in_blackout, ahead.n::bigint as macro_events_next_24h,
  round(case when exists (select 1 from fd where fd.d = ((tg.ts at time zone 'UTC') at time zone {NY})::date) then 1.0 else 0.0 end, 6) as macro_is_fomc_day
from tg join p_cpi using (id) join n_cpi using (id) join p_fomc using (id) join n_fomc using (id) join p_event using (id) join n_event using (id) join ahead using (id)""")
def macro_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.macro_features(_targets(spark, sf_dir), _macro_events(spark, sf_dir).select("event_time", "event_type"), ["cpi", "fomc"], ["cpi", "fomc", "nfp"], ["fomc"]).drop("ts")


DAILY_SQL = "md as (select l_returnflag as series_id, l_shipdate::date as obs_date, avg(l_extendedprice) as value from lineitem group by 1, 2)"


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("obs_date")).agg(F.avg("l_extendedprice").alias("value"))
    parts = [M.market_rows(li.where(F.col("series_id") == s).select("obs_date", "value"), s) for s in ("A", "N", "R")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@add(f"with {DAILY_SQL} select series_id, obs_date, round(value, 6) as value, obs_date + interval 86399 second as observed_at from md")
def market_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, "market-daily")
    store.write("market_daily", _market(spark, sf_dir))
    return LK.latest_ingest(store.scan("market_daily"), ["series_id", "obs_date"], "ingested_at").drop("ingested_at")


@add(f"""with {DAILY_SQL}, {TARGETS_SQL}, ob as (select *, obs_date + interval 86399 second as at from md), a as (select tg.id, x.value from tg asof left join (select * from ob where series_id = 'A') x on tg.ts >= x.at), r as (select tg.id, x.value from tg asof left join (select * from ob where series_id = 'R') x on tg.ts >= x.at)
select a.id, round(a.value - r.value, 6) as "curve_A_R" from a join r on a.id = r.id""")
def curve_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(spark, sf_dir).withColumn("series_id", F.explode(F.array(F.lit("A"), F.lit("R"))))
    levels = M.market_state(t, _market(spark, sf_dir).select("series_id", "observed_at", "value"), (1,), 5)
    return M.curve_spread(levels, ["id"], "A", "R")


# --- news ------------------------------------------------------------------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=(F.col("doc_id") * 7 % 20000).cast("int"))
    return d.select(F.md5(F.col("text").cast("binary")).alias("content_hash"), "source", F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("doc_id") % 11 != 0, at).alias("published_at"), at.alias("observed_at"), (F.lit("2024-02-01").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id"))).alias("ingested_at"), F.col("lang").alias("query_topic"), (F.col("doc_id") % 10 == 0).alias("degraded"))


@add("select h as content_hash, doc_id::varchar as source_id from (select md5(text) as h, doc_id, row_number() over (partition by md5(text) order by doc_id desc) as r from documents) where r = 1")
def news_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events through the store: the latest ingest of each content hash."""
    store = _store(spark, "news-lake")
    store.write("news_raw", _raw(spark, sf_dir))
    return store.news().select("content_hash", "source_id")


@add(f"with {NEWS_SQL} select doc_id::varchar as content_hash, m as model_name, round(sentiment_score, 6) as sentiment_score, false as degraded from news, (values ('a'), ('b')) x(m)")
def scored_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events by two models, written twice, read back normalised."""
    store = _store(spark, "scored-lake")
    n = news(spark, sf_dir).select(F.col("doc_id").cast("string").alias("content_hash"), "source", "observed_at", F.col("observed_at").alias("scored_at"), "positive_score", "negative_score", "neutral_score", "sentiment_score", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model_name"))
    store.write("news_scored", n)
    store.write("news_scored", n)
    return N.normalise_scored(store.news("news_scored")).select("content_hash", "model_name", "sentiment_score", "degraded")


@add("select doc_id from documents where doc_id % 4 in (1, 2) or doc_id % 8 = 0")
def slot_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four slots, one of them written again with less; the days asked for hold three."""
    store, d = _store(spark, "slot-lake"), table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("content_hash"), "doc_id", F.lit("2024-01-01").cast("timestamp").alias("observed_at"))
    slots = [dt.datetime(2024, 1, 1 + 2 * (k == 3), 6, 15 * k) for k in range(4)]
    for k, s in enumerate(slots):
        store.write_slot("kg", rows.where(F.col("doc_id") % 4 == k), s)
    store.write_slot("kg", rows.where("doc_id % 8 = 0"), slots[0])
    return store.read_slots("kg", dt.date(2024, 1, 1), dt.date(2024, 1, 2)).select("doc_id")


FILED_SQL = "select 'filings' as source, 'A' || l_orderkey || '-' || l_linenumber as source_id, s_name || ' ' || l_linestatus as title, l_shipdate + case when l_linenumber % 2 = 0 then interval 0 hour else interval 13 hour end as seen from lineitem join supplier on l_suppkey = s_suppkey"


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload a supplier with its line items as parallel arrays; even lines lack an acceptance time."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    at = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.date_format(F.col("l_shipdate").cast("timestamp") + F.expr("interval 13 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    x = F.struct(F.concat(F.lit("A"), "l_orderkey", F.lit("-"), "l_linenumber").alias("n"), F.col("l_linestatus").alias("f"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), at.alias("t"))
    g = li.groupBy("s_suppkey", "s_name").agg(F.collect_list(x).alias("x"))
    arrays = F.struct(F.col("x.n").alias("accessionNumber"), F.col("x.f").alias("form"), F.col("x.d").alias("filingDate"), F.col("x.t").alias("acceptanceDateTime"))
    return g.select(F.to_json(F.struct(F.col("s_name").alias("name"), F.struct(arrays.alias("recent")).alias("filings"))).alias("payload"))


@add(f"select source, source_id, title, seen as published_at, false as degraded from ({FILED_SQL})")
def parse_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.parse_filings(_filings(spark, sf_dir), "payload").select("source", "source_id", "title", "published_at", "degraded")


@add(f"select source, count(*)::bigint as n, sum(degraded::int)::bigint as degraded from (select source, false as degraded from ({FILED_SQL}) union all select 'articles', page_id % 5 = 0 or {TITLE_SQL} = '' from pages) group by 1")
def parse_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of both kinds in one table, parsed by what they hold."""
    title = F.when(F.col("page_id") % 5 != 0, X.page_title("html"))
    articles = table(spark, sf_dir, "pages").select(F.to_json(F.struct(F.array(F.struct(F.col("url"), title.alias("title"), F.lit("20240102T030405Z").alias("seendate"))).alias("articles"))).alias("payload"))
    found = parse_fixture(spark, articles.unionByName(_filings(spark, sf_dir)), "payload", "macro")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("degraded").cast("long")).alias("degraded"))


@add("""with n as (select count(*) as rows, count(distinct md5(text)) as u, sum((doc_id % 11 = 0)::int) as gone, sum((doc_id % 10 = 0)::int) as bad from documents), s as (select avg(l_discount) as m, stddev_samp(l_discount) as sd, min(l_discount) as lo, max(l_discount) as hi, count(*) as c from lineitem)
select 'source' as section, source as name, round(count(*), 6) as value from documents group by 2 union all select 'topic', lang, count(*) from documents group by 2 union all select 'raw', 'rows', rows from n union all select 'raw', 'duplicate_rate', round((rows - u) / rows::double, 6) from n
union all select 'raw', 'missing_timestamps', gone from n union all select 'raw', 'degraded', bad from n union all select 'scored', 'rows', c from s union all select 'scored', 'mean', round(m, 6) from s union all select 'scored', 'std', round(sd, 6) from s union all select 'scored', 'min', lo from s union all select 'scored', 'max', hi from s""")
def sentiment_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("sentiment_score"))
    return QA.sentiment_health(_raw(spark, sf_dir), scored)


@add("select page_id, u as url from (select page_id, url as u, row_number() over (partition by split_part(url, '/', 3) order by page_id) as r from pages) where r = 1")
def earliest_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest row of each key."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    return N.dedupe(p, "host", F.asc("page_id")).select("page_id", "url")


@add("select count(*)::bigint as n, sum((doc_id % 7 = 0)::int)::bigint as bad from documents")
def clock_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose three clocks are out of order."""
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id"))
    d = table(spark, sf_dir, "documents").select(at.alias("published_at"), F.when(F.col("doc_id") % 7 == 0, at - F.expr("interval 1 second")).otherwise(at).alias("observed_at"), (at + F.expr("interval 1 hour")).alias("ingested_at"))
    return d.agg(F.count("*").alias("n"), F.count_if(N.violates_clock()).alias("bad"))


# --- caches and runs ------------------------------------------------------------------------------------------------------------------------------


@add("select o_orderpriority, count(*)::bigint as n from orders group by 1")
def matrix_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table built once under its versions; the second build is not run."""
    store, o = _store(spark, "matrix-cache"), table(spark, sf_dir, "orders")
    store.cached("matrix", {"features": "v1"}, lambda: o.groupBy("o_orderpriority").agg(F.count("*").alias("n")))
    return store.cached("matrix", {"features": "v1"}, lambda: o.limit(0).select("o_orderpriority", F.lit(0).cast("long").alias("n")))


@add("select * from (values ('A', true, 0.25, 7), ('B', true, 0.5, null), ('C', false, null, null)) x(symbol, has_run, pbo, trials)")
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, "runs")
    for symbol, summary in (("A", {"pbo": 0.9}), ("B", {"pbo": 0.5}), ("A", {"pbo": 0.25, "trials": 7})):
        store.save_run("model", symbol, summary)
    return store.run_health("model", ["A", "B", "C"], {"pbo": "double", "trials": "int"})


@add(f"with e as (select event_id, {LOCAL} as l from events) select event_id, l::date as session_date from e where isodow(l) < 6 and hour(l) * 60 + minute(l) >= 570 and hour(l) * 60 + minute(l) < 960")
def rth_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(X.session_tag("ts") == "RTH").select("event_id", F.to_date(X.local("ts")).alias("session_date"))


@add("select event_id from events")
def no_spread_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.no_spreads(table(spark, sf_dir, "events").withColumn("contract_id", F.col("event_type"))).select("event_id")


@add("""select l_orderkey, l_linenumber, round((l_extendedprice + l_extendedprice + 1) / 2, 6) as mid, round((l_extendedprice * (l_partkey % 5) + (l_extendedprice + 1) * l_quantity) / nullif(l_quantity + l_partkey % 5, 0), 6) as micro,
round((l_quantity - l_partkey % 5) / nullif(l_quantity + l_partkey % 5, 0), 6) as imbalance from lineitem""")
def book_maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("bid"), (F.col("l_extendedprice") + 1).alias("ask"), F.col("l_quantity").alias("bs"), (F.col("l_partkey") % 5).cast("double").alias("as_"))
    return li.select("l_orderkey", "l_linenumber", X.mid("bid", "ask").alias("mid"), X.micro_price("bid", "bs", "ask", "as_").alias("micro"), X.queue_imbalance("bs", "as_").alias("imbalance"))
