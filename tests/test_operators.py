"""Known answers and invariants of the engine's own operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 2, 14, 30)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def test_asof_known_answer(spark):
    from tidemark.operators.asof import asof_join

    left = spark.createDataFrame([(i, minutes(i)) for i in range(29, 34)], "bar_id int, ts timestamp")
    right = spark.createDataFrame([(v, T0 + dt.timedelta(minutes=m, seconds=30)) for v, m in ((1, 29), (2, 31), (3, 33))], "value int, ts timestamp")
    for bucket in (60_000_000, 86_400_000_000):
        got = [r["r_value"] for r in asof_join(left, right, take=["value"], bucket_us=bucket).orderBy("bar_id").collect()]
        assert got == [None, 1, 1, 2, 2]
        got = [r["r_value"] for r in asof_join(left, right, take=["value"], forward=True, bucket_us=bucket).orderBy("bar_id").collect()]
        assert got == [1, 2, 2, 3, 3]


def test_asof_equality_keys_and_truncation(spark):
    from tidemark.operators.asof import asof_join

    rng = np.random.default_rng(0)
    L = pd.DataFrame({"id": range(300), "k": rng.integers(0, 4, 300), "ts": [minutes(int(x)) for x in rng.integers(0, 9000, 300)]})
    R = pd.DataFrame({"v": range(200), "k": rng.integers(0, 4, 200), "ts": [minutes(int(x)) for x in rng.choice(9000, 200, replace=False)]})
    left, right = spark.createDataFrame(L), spark.createDataFrame(R)
    wanted = pd.merge_asof(L.sort_values("ts"), R.sort_values("ts"), on="ts", by="k").set_index("id")["v"]
    got = {r["id"]: r["r_v"] for r in asof_join(left, right, by=["k"], take=["v"]).collect()}
    assert all((got[i] is None and math.isnan(v)) or got[i] == v for i, v in wanted.items())
    cut = minutes(5000)  # what is known later changes nothing before
    part = {r["id"]: r["r_v"] for r in asof_join(left.where(F.col("ts") <= F.lit(cut)), right.where(F.col("ts") <= F.lit(cut)), by=["k"], take=["v"]).collect()}
    assert all(got[i] == v for i, v in part.items())


def test_blocked_windows_equal_plain_ones(spark):
    from tidemark.operators.indicators import zscore
    from tidemark.operators.windows import blocked

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("hot" if i % 3 else "b", minutes(i * 7), float(x)) for i, x in enumerate(rng.normal(size=900))], "symbol string, ts timestamp, close double")
    plain = {(r["symbol"], r["ts"]): r["z"] for r in zscore(df, "close", 30, "z").collect()}
    cut = blocked(df, ["symbol"], ["ts"], 29, lambda d, k: zscore(d, "close", 30, "z", keys=k), F.to_date("ts"), block_rows=50)
    rows = cut.collect()
    assert len(rows) == 900
    for r in rows:
        a, b = plain[r["symbol"], r["ts"]], r["z"]
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_block_chained_ewm(spark):
    from tidemark.operators.recurrences import Ewm, ewm

    rng = np.random.default_rng(2)
    x = [None, None, *rng.normal(size=200).tolist()]
    df = spark.createDataFrame([("s", T0 + dt.timedelta(days=i), v) for i, v in enumerate(x)], "symbol string, ts timestamp, x double")
    got = [r["y"] for r in ewm(df, ["symbol"], "ts", [Ewm("y", "x", 0.2, 5)]).orderBy("ts").collect()]
    wanted = pd.Series(x, dtype=float).ewm(alpha=0.2, adjust=False, min_periods=5).mean()
    for a, b in zip(got, wanted):
        assert (a is None and math.isnan(b)) or abs(a - b) < 1e-12


def test_cusum_known_answers():
    from tidemark.operators.recurrences import cusum

    def fire(r, h=1.0):
        return np.flatnonzero(cusum(np.array(r, float), np.full(len(r), h))).tolist()

    assert fire([0.3] * 12) == [3, 7, 11]
    assert fire([-0.4, -0.4, -0.4, 0, 0]) == [2]
    assert fire([1.0] * 4) == [0, 1, 2, 3]
    assert fire([0.6, float("nan"), 0.6, 0.6]) == [3]


def test_dollar_bars_known_answer():
    from tidemark.operators.recurrences import dollar_bar_ids

    ids, whole = dollar_bar_ids(np.full(6, 2000.0), 5000.0)
    assert ids.tolist() == [0, 0, 0, 1, 1, 1] and whole.all()
    ids, whole = dollar_bar_ids(np.full(4, 2000.0), 5000.0)
    assert ids.tolist() == [0, 0, 0, 1] and whole.tolist() == [True] * 3 + [False]


def test_front_month_and_seam(spark):
    from tidemark.operators import continuous as C

    days = [dt.date(2024, 1, d) for d in (2, 3, 4, 5)]
    rows = []
    for d, (a, b) in zip(days, ((1000, 200), (900, 400), (500, 800), (100, 1000))):
        for c, v, e, p in (("H", a, dt.date(2024, 3, 15), 5010.0), ("M", b, dt.date(2024, 6, 21), 5110.0)):
            rows.append((dt.datetime.combine(d, dt.time(15)), c, 1, e, float(v), p, p, p, p))
    bars = spark.createDataFrame(rows, "ts timestamp, contract_id string, con_id long, expiry date, volume double, open double, high double, low double, close double")
    rolls = C.rolls(C.front_month(C.daily_volume(bars)))
    assert [tuple(r) for r in rolls.collect()] == [(days[2], "H", "M")]
    for how, first in (("ratio", 5110.0), ("panama", 5110.0)):
        out = C.continuous(bars, rolls, how).orderBy("ts").collect()
        assert [r["contract_id"] for r in out] == ["H", "H", "M", "M"]
        assert all(abs(r["close"] - first) < 1e-9 for r in out) and out[0]["raw_close"] == 5010.0
    assert C.seam_gaps(C.continuous(bars, rolls), rolls).first()["gap"] == pytest.approx(0)
    assert C.continuous(bars, rolls.limit(0)).count() == 8


def test_statistics():
    from tidemark.functions import statistics as S

    assert S.psr(0.1, 0, 100) == pytest.approx(0.8395, abs=2e-4)
    assert S.min_track_record(0.1) == pytest.approx(272.907, abs=1e-3)
    assert S.expected_max_sharpe(0.04, 10) == pytest.approx(0.3150, abs=2e-4)
    assert S.average_ranks([10, 30, 20, 30]).tolist() == [1, 3.5, 2, 3.5]
    assert S.student_t_sf(2.228, 10) == pytest.approx(0.025, abs=1e-4)
    assert S.student_t_sf(-1.0, 5) == pytest.approx(1 - 0.18161, abs=1e-4)
    x = np.random.default_rng(0).normal(size=(200, 4))
    good = x.copy()
    good[:, 0] += 3
    assert S.pbo(good)["pbo"] == 0 and S.pbo(x)["n_splits"] == 252
    d = S.diebold_mariano(np.zeros(50), np.abs(x[:50, 0]))
    assert d["stat"] < 0 and d["p"] > 0.99 or d["p"] < 0.01
    assert S.stationary_bootstrap(x[:, 0] + 1, 500)["p"] < 0.01 and S.stationary_bootstrap(x[:, 0] + 1, 500) == S.stationary_bootstrap(x[:, 0] + 1, 500)
    r = np.random.default_rng(1).normal(0.001, 0.01, 500)
    assert S.performance_fee(r + 0.0002, r, 5) == pytest.approx(0.0002, abs=1e-6)
    assert S.embargo_rows(0.01, 101) == 2


def test_purge_leaves_no_overlap(spark):
    from tidemark.operators import cv

    rng = np.random.default_rng(3)
    spans = [(i, minutes(int(a)), minutes(int(a) + int(b))) for i, (a, b) in enumerate(zip(rng.integers(0, 3000, 200), rng.integers(1, 90, 200)))]
    labels = spark.createDataFrame(spans, "id int, t0 timestamp, t1 timestamp")
    r = {x["row"]: (x["t0"], x["t1"]) for x in cv.numbered(labels).collect()}
    for df in (cv.purged_kfold(labels, 5), cv.cpcv(labels, 5, 2), cv.walk_forward(labels, 4)):
        by = {}
        for x in df.collect():
            by.setdefault(x["split"], {}).setdefault(x["role"], []).append(x["row"])
        for roles in by.values():
            for i in roles["train"]:
                assert not any(r[i][0] <= r[j][1] and r[i][1] >= r[j][0] for j in roles["test"])
    assert cv.cpcv(labels, 5, 2).select("split").distinct().count() == 10


def test_lake(spark, tmp_path):
    from tidemark.sources.lake import DATASETS, Lake, coerce, empty

    lake = Lake(spark, str(tmp_path / "lake"))
    assert lake.scan("bars_1m").count() == 0 and empty(spark, "news_raw").columns == DATASETS["news_raw"].schema.names
    rows = [(minutes(i), minutes(i + 1), "ES", "ESH4", 10.0 + i) for i in range(6)]
    df = spark.createDataFrame(rows, "ts_event timestamp, ts_ingest timestamp, symbol string, contract_id string, close double")
    assert lake.write("bars_1m", df) == 6
    assert lake.write("bars_1m", df) == 0
    later = df.withColumns({"ts_ingest": F.col("ts_ingest") + F.expr("interval 1 hour"), "close": F.col("close") + 1})
    later.transform(lambda d: coerce(d, "bars_1m")).withColumn("_split", F.lit("ES")).withColumn("_date", F.to_date("ts_event")).write.mode("append").partitionBy("_split", "_date").parquet(str(tmp_path / "lake/bars_1m"))
    got = lake.read_window("bars_1m", "ES", str(minutes(1)), str(minutes(3))).collect()
    assert [r["close"] for r in got] == [12.0, 13.0, 14.0]  # inclusive ends, the latest ingest wins
    assert lake.compact("bars_1m") == lake.scan("bars_1m").count() == 6  # as many rows went as keys are left, and reads see it
    with pytest.raises(ValueError):
        coerce(df.drop("symbol"), "bars_1m")


def test_session_edges(spark):
    from tidemark.functions import exprs as X

    rows = [("2024-01-02 14:29:59", "ETH", "2024-01-02"), ("2024-01-02 14:30:00", "RTH", "2024-01-02"), ("2024-01-02 20:59:59", "RTH", "2024-01-02"), ("2024-01-02 21:00:00", "ETH", "2024-01-02"), ("2024-01-02 23:00:00", "ETH", "2024-01-03"), ("2024-01-06 16:00:00", "ETH", "2024-01-06"), ("2024-07-02 13:30:00", "RTH", "2024-07-02")]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").select(F.to_timestamp("t").alias("ts"))
    got = df.select(X.session_tag("ts").alias("s"), X.trade_date("ts").cast("string").alias("d")).collect()
    assert [(r["s"], r["d"]) for r in got] == [(r[1], r[2]) for r in rows]


def test_window_edges(spark):
    from tidemark.operators.news import sentiment_features

    t = minutes(100)
    events = spark.createDataFrame([(t, 1.0, 0.5, False), (t + dt.timedelta(minutes=1), 9.0, 0.5, False), (t - dt.timedelta(minutes=15), 2.0, 0.5, False), (t - dt.timedelta(minutes=5), 3.0, 0.5, True)], "observed_at timestamp, sentiment_score double, positive_score double, degraded boolean")
    r = sentiment_features(events, spark.createDataFrame([(1, t)], "id int, ts timestamp"), [15, 60]).first()
    assert (r["n_15"], r["sum_15"], r["n_degraded_15"], r["n_60"], r["sum_60"], r["age_15"]) == (1, 1.0, 1, 2, 3.0, 0.0)
    none = sentiment_features(events.limit(0), spark.createDataFrame([(1, t)], "id int, ts timestamp"), [15]).first()
    assert (none["n_15"], none["any_15"], none["mean_15"]) == (0, 0, None)


def test_parsers(spark):
    from tidemark.operators import news as N
    from tidemark.sources.plans import observations

    a = '{"articles":[{"url":"u1","title":"t","seendate":"20240102T030405Z","language":"en"},{"url":"u2","seendate":"bad"}]}'
    got = N.parse_article_list(spark.createDataFrame([(a,), ("{}",)], "p string"), "p", "fed").orderBy("source_id").collect()
    assert [(r["source_id"], r["degraded"]) for r in got] == [("u1", False), ("u2", True)]
    f = '{"name":"X","filings":{"recent":{"accessionNumber":["1","2"],"form":["8-K","10-Q"],"filingDate":["2024-01-02","2024-01-03"],"acceptanceDateTime":["2024-01-02T10:00:00.000Z",null]}}}'
    got = N.parse_filings(spark.createDataFrame([(f,)], "p string"), "p").orderBy("source_id").collect()
    assert [str(r["published_at"]) for r in got] == ["2024-01-02 10:00:00", "2024-01-03 00:00:00"]
    o = '{"observations":[{"date":"2024-01-01","value":".","realtime_start":"2024-02-01"},{"date":"2024-02-01","value":"3.5","realtime_start":"2024-03-01"}]}'
    got = observations(spark.createDataFrame([(o,)], "p string"), "p").collect()
    assert [(str(r["obs_date"]), r["value"], str(r["release_date"])) for r in got] == [("2024-02-01", 3.5, "2024-03-01")]


def test_plans_and_policy():
    from tidemark.sources import plans as P

    assert P.year_chunks(dt.date(2022, 6, 1), dt.date(2024, 2, 1)) == [(dt.date(2022, 6, 1), dt.date(2023, 1, 1)), (dt.date(2023, 1, 1), dt.date(2024, 1, 1)), (dt.date(2024, 1, 1), dt.date(2024, 2, 1))]
    assert len(P.slot_grid(minutes(0), minutes(60))) == 4
    plan = P.request_plan(["a"], dt.date(2024, 1, 1), dt.date(2024, 1, 4), dt.date(2024, 1, 3))
    assert plan == [("a", dt.date(2024, 1, 3)), ("a", dt.date(2024, 1, 2)), ("a", dt.date(2024, 1, 1))]
    m = P.Manifest()
    m.mark("x")
    assert P.Manifest.loads(m.dumps()).pending(["x", "y"]) == ["y"]
    policies = {"free": P.SourcePolicy("free", True, True, 1000, 5)}
    assert P.access_plan("free", policies, 1, 10, True)["bytes"] == 10
    for args in (("free", policies, 1, 10, False), ("free", policies, 9, 10, True), ("none", policies, 1, 1, True)):
        with pytest.raises(P.AccessDenied):
            P.access_plan(*args)


def test_feature_config():
    from tidemark.plans.features import FeatureConfig, feature_names

    c = FeatureConfig.load({"returns": [1, 2]})
    assert feature_names(c)[:2] == ["ret_1", "ret_2"] and len(set(feature_names(c))) == len(feature_names(c))
    with pytest.raises(ValueError):
        FeatureConfig.load({"typo": 1})


def test_whole_queries_leave_no_row_out(spark):
    from tidemark import registry

    path = "/root/testdata/sf0.001"
    rows = {t: spark.read.parquet(f"{path}/{t}.parquet").count() for t in ("events", "orders", "lineitem")}
    wanted = dict.fromkeys(("half_open_news", "gkg_tone", "event_timing", "event_change", "coerce_schema"), rows["events"]) | {"json_zip": rows["lineitem"], "market_state": 3 * rows["orders"]}
    for name, n in wanted.items():
        assert registry.QUERIES[name](spark, path).count() == n, name
    assert registry.QUERIES["news_coverage"](spark, path).first()["rows"] == rows["events"]
    assert registry.QUERIES["labels_with_features"](spark, path).count() == registry.QUERIES["triple_barrier"](spark, path).count() > 0
    news = {r["doc_id"]: r["doc_id"] * 7 % 20000 for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id").collect()}
    at = [r["m"] for r in spark.read.parquet(f"{path}/events.parquet").selectExpr("unix_micros(cast(ts as timestamp)) / 6e7 - unix_micros(timestamp '2024-01-01') / 6e7 as m").collect()]
    used = {d for d, m in news.items() if any(0 <= x - m < 15 for x in at)}
    assert {r["doc_id"] for r in registry.QUERIES["news_events_used"](spark, path).collect()} == used


def against_sql(spark, path, name, tables):
    """Sorted rows of a registered query over small tables written to ``path`` (name to DataFrame), and those of its SQL; NaN by name."""
    duckdb = pytest.importorskip("duckdb")
    from tidemark import registry

    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
        con.sql(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    found, wanted = registry.QUERIES[name](spark, str(path)), con.sql(registry.ORACLE_SQL[name])
    at = [list(wanted.columns).index(c) for c in found.columns]
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v
    return [sorted((tuple(plain(v) for v in r) for r in rows), key=repr) for rows in (found.collect(), [[r[i] for i in at] for r in wanted.fetchall()])]


def trades(spark, rows):
    """``events`` of (event_type, ts, value)."""
    return spark.createDataFrame([(i, ts, i % 7, kind, float(v), '{"k": 1}') for i, (kind, ts, v) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_calibration_without_variation(spark, tmp_path):
    days = [dt.datetime(2024, 1, d, h) for d in (2, 3, 4) for h in range(24)]  # as many returns each day
    fewer = [t for t in days if t.day < 4 or t.hour < 12]
    rows = [(k, t, (t.day * 7 + t.hour * 5) % 11) for k, ts in (("even", days), ("other", fewer), ("short", days[:24])) for t in ts]
    found, wanted = against_sql(spark, tmp_path, "calibration", {"events": trades(spark, rows)})
    assert found == wanted and len(found) == 3
    assert sum("nan" in r for r in found) == 2


def test_event_timing_rounds_as_sql(spark, tmp_path):
    rows = [("error", dt.datetime(2024, 1, 2, 0, 0), 1.0), ("error", dt.datetime(2024, 1, 2, 2, 0), 1.0)]
    rows += [("view", dt.datetime(2024, 1, 2, 0, 0) + dt.timedelta(microseconds=30 + 60 * (k * 7919 % 100_000_000)), 1.0) for k in range(2000)]  # half way between two of six digits
    found, wanted = against_sql(spark, tmp_path, "event_timing", {"events": trades(spark, rows)})
    assert found == wanted


def test_gkg_tone_of_equal_scores(spark, tmp_path):
    """Windows of one event, of equal ones and of ones that differ little."""
    said = {43: 14, 401: 44, 402: 44, 1201: 1500, 1202: 1501}  # observed seven minutes a doc_id after the start
    docs = [(d, "s", "the " * n + "x") for d, n in said.items()]
    documents = spark.createDataFrame([(d, w, "en", s, len(w)) for d, s, w in docs], "doc_id long, text string, lang string, source string, n_chars long")
    start = dt.datetime(2024, 1, 1)
    rows = [("view", start + dt.timedelta(minutes=d * 7 % 20000 + 20), 1.0) for d, _, _ in docs] + [("view", start, 1.0)]
    found, wanted = against_sql(spark, tmp_path, "gkg_tone", {"documents": documents, "events": trades(spark, rows)})
    assert found == wanted
    assert sum(r[1] == 1 for r in found) >= 1


@pytest.mark.parametrize("name", ["title_extract", "parse_articles", "parse_knowledge_graph"])
def test_titles_cut_off_in_a_reference(spark, tmp_path, name):
    titles = ["a &amp", "b &amp; &lt;i&gt;", "c &am", "d &quot", "e &amp;amp", "f &amp;lt; &&amp;", "g h&#39;", "&ampx; &unknown; & ;", ""]
    titles += ["&quot;i&quot;"] if name != "title_extract" else []  # its SQL resolves &quot; to nothing
    pages = [(2 * i + 2, f"http://x.example.com/a{i}", f"<html><TITLE lang='en'> {t} </title><title>no</title></html>") for i, t in enumerate(titles)]
    found, wanted = against_sql(spark, tmp_path, name, {"pages": spark.createDataFrame(pages, "page_id long, url string, html string")})
    assert found == wanted and len(found) == len(titles)


def test_page_title_resolves_all_references(spark):
    from tidemark.functions.exprs import page_title

    html = "<title>&eacute;&#xe9;&#233; &copy; &amp</title>"
    for closed, wanted in ((False, "ééé © &"), (True, "ééé © &amp")):
        assert spark.createDataFrame([(html,)], "html string").select(page_title("html", closed)).first()[0] == wanted


def test_features_of_a_pair(spark):
    from tidemark.plans.features import FeatureConfig, compute_features, feature_names, pair_names

    rng = np.random.default_rng(12)
    rows = []
    for k, symbol in enumerate(("A", "B", "C")):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))
        rows += [(symbol, minutes(5 * i + k), *(float(x),) * 4, float(rng.integers(1, 9)), 2.0 if symbol == "B" else 1.0) for i, x in enumerate(close)]
    fields = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, adj_factor double"
    bars = spark.createDataFrame(rows, fields)
    c = FeatureConfig(pair=("A", "B"), pair_ratio=20, pair_corr=10)
    got = compute_features(bars, c).toPandas()
    assert list(got.columns) == ["symbol", "ts", *feature_names(c), *pair_names(c), "degraded", "feature_version"] and len(got) == 360
    assert got[got.symbol == "C"][pair_names(c)].isna().all().all()
    p = pd.DataFrame(rows, columns=["symbol", "ts", "o", "h", "l", "close", "v", "adj"])
    p["raw"] = p.close / p.adj
    p["ret"] = np.log(p.close) - np.log(p.groupby("symbol").close.shift(1))
    a, b = (p[p.symbol == s].reset_index(drop=True) for s in "AB")
    for own, other, up in ((a, b, False), (b, a, True)):
        j = pd.merge_asof(own, other[["ts", "ret", "raw"]].rename(columns={"ret": "o_ret", "raw": "o_raw"}), on="ts")
        ratio = j.raw / j.o_raw if up else j.o_raw / j.raw
        spread = (j.ret - j.o_ret) if up else (j.o_ret - j.ret)
        z = (ratio - ratio.rolling(20).mean()) / ratio.rolling(20).std()
        mine = got[got.symbol == own.symbol[0]].sort_values("ts")
        for name, wanted in zip(pair_names(c), (spread, z, j.ret.rolling(10).corr(j.o_ret))):
            assert np.allclose(mine[name].astype(float), wanted, atol=1e-9, equal_nan=True), name
    with pytest.raises(ValueError):
        compute_features(bars.withColumn("contract_id", F.lit("A1-A2")), c)
