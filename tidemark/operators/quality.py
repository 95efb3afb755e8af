"""Data-quality findings, coverage and health, evaluation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import corr, sdiv, us


def findings(bars: DataFrame, key: list[str], ts: str = "ts", series: str = "contract_id", step_us: int = 60_000_000, ingest: str | None = "ts_ingest", session: str | None = None, arrival: str | None = None) -> DataFrame:
    """``check, n``: duplicate keys, OHLC order, ingest before event, gaps of more than twice the step inside a session, crossed quotes, and rows
    older than the one that arrived before them (``arrival`` names the order of arrival)."""
    checks = [bars.groupBy(*key).count().where("count > 1").agg(F.lit("duplicates").alias("check"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))]
    rows = []
    if {"open", "high", "low", "close"} <= set(bars.columns):
        rows.append(("ohlc", (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))))
    if ingest and ingest in bars.columns:
        rows.append(("ingest_before_event", F.col(ingest) < F.col(ts)))
    if {"bid", "ask"} <= set(bars.columns):
        rows.append(("crossed", F.col("bid") > F.col("ask")))
    w = Window.partitionBy(series, *([session] if session else [])).orderBy(ts)
    gapped = bars.withColumn("_gap", us(ts) - us(F.lag(ts).over(w)))
    rows.append(("gaps", F.col("_gap") > 2 * step_us))
    if arrival:
        gapped = gapped.withColumn("_back", F.col(ts) < F.lag(ts).over(Window.partitionBy(series).orderBy(arrival)))
        rows.append(("not_monotonic", F.col("_back")))
    sums = gapped.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in rows])
    checks.append(sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("n")) for name, _ in rows])).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, checks)


def coverage(df: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def null_rates(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k columns with most nulls or NaNs, by one aggregation."""
    rates = df.agg(*[F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")).alias(c) for c in columns])
    long = rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_rate")) for c in columns])).alias("x")).select("x.*")
    return long.orderBy(F.desc("null_rate"), "feature").limit(k)


def session_health(bars: DataFrame, session: str, key: str) -> DataFrame:
    """Bars a session: least, median, most; thin sessions (under a third of the median)."""
    s = bars.groupBy(key, session).agg(F.count("*").alias("n"))
    g = s.groupBy(key).agg(F.count("*").alias("sessions"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"))
    thin = s.join(g.select(key, "median"), key).where(F.col("n") < F.col("median") / 3).groupBy(key).agg(F.count("*").alias("thin"))
    return g.join(thin, key, "left").withColumn("thin", F.coalesce("thin", F.lit(0)))


def label_health(labels: DataFrame, key: str = "symbol") -> DataFrame:
    """Balance, barrier counts, span quartiles, effective number."""
    q = F.percentile("n_bars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = labels.groupBy(key).agg(F.count("*").alias("n"), *[F.sum((F.col("label") == v).cast("long")).alias(n) for v, n in ((1, "up"), (0, "flat"), (-1, "down"))], F.sum((F.col("barrier") == "vertical").cast("long")).alias("vertical"), q.alias("q"), F.sum("avg_uniqueness").alias("effective_n"))
    return g.select(key, "n", "up", "flat", "down", "vertical", *[F.col("q")[i].alias(f"bars_q{i + 1}") for i in range(3)], "effective_n")


def confusion(df: DataFrame, truth: str, pred: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(truth, pred).agg(F.count("*").alias("n"), F.sum(w).alias("w"))


def class_scores(conf: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of each class; a class without predictions or members scores 0."""
    t = conf.groupBy(F.col(truth).alias("cls")).agg(F.sum("n").alias("members"), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("hits"))
    p = conf.groupBy(F.col(pred).alias("cls")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, "cls", "full").fillna(0)
    precision, recall = F.coalesce(sdiv("hits", "predicted"), F.lit(0.0)), F.coalesce(sdiv("hits", "members"), F.lit(0.0))
    return j.select("cls", "members", "predicted", precision.alias("precision"), recall.alias("recall"), F.coalesce(sdiv(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def class_weights(df: DataFrame, label: str, weight: str) -> DataFrame:
    """Balanced class weights on sample-weight mass: total / (classes * mass of the class)."""
    g = df.groupBy(label).agg(F.sum(weight).alias("mass"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a class
    return g.select(label, "mass", sdiv(F.sum("mass").over(every), F.count("*").over(every) * F.col("mass")).alias("class_weight"))


def finite_rows(df: DataFrame, required: list[str], features: list[str]) -> DataFrame:
    """Rows without a null in the required columns, and with every feature finite."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in features])
    return df.dropna(subset=required).where(~bad)


def staged_rows(df: DataFrame, required: list[str], features: list[str]) -> DataFrame:
    """One row of drop counts by stage: null required, infinite feature, all features missing; and what is kept."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    inf = reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False)) for c in features])
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in features])
    stage = F.when(null, 1).when(inf, 2).when(empty, 3).otherwise(0)
    return df.select(stage.alias("s")).agg(*[F.sum((F.col("s") == i).cast("long")).alias(n) for i, n in ((1, "null_required"), (2, "infinite"), (3, "unmatched"), (0, "kept"))])


def no_spreads(df: DataFrame, contract: str = "contract_id") -> DataFrame:
    """The rows as they are; a spread contract (its name holds a dash) fails the job that meets it."""
    return df.withColumn(contract, F.when(F.col(contract).contains("-"), F.raise_error(F.concat(F.lit("spread contract "), F.col(contract)))).otherwise(F.col(contract)))


def canonical(df: DataFrame, order: tuple[str, ...] = ("symbol", "ts_event", "con_id", "ts_open")) -> DataFrame:
    """Rows in the one order that does not depend on who made them: range-partitioned and sorted by the columns there are."""
    return df.orderBy(*[c for c in order if c in df.columns])


def feature_health(df: DataFrame, features: list[str], key: str = "symbol", degraded: str = "degraded") -> DataFrame:
    """Rows, share degraded, and mean share of missing features by symbol."""
    missing = sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in features) / len(features)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col(degraded).cast("double")).alias("degraded_share"), F.avg(missing).alias("missing_share"))


def micro_health(bars: DataFrame, key: str, session: str, features: list[str]) -> DataFrame:
    """Order-flow bars by symbol: sessions and bars in them, thin sessions, rolls, share incomplete, median duration, flow against mid change, bad values."""
    bad = sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("long") for c in features)
    g = bars.groupBy(key).agg(
        (F.count_distinct("con_id") - 1).alias("rolls"), (100 * F.avg((~F.col("bar_complete")).cast("double"))).alias("pct_incomplete"), F.percentile("duration_s", 0.5).alias("median_duration_s"),
        corr("ofi_top", "dmid").alias("ofi_dmid_corr"), F.sum(bad).alias("bad_values"),
    )
    return session_health(bars, session, key).join(g, key)


def sentiment_health(raw: DataFrame, scored: DataFrame) -> DataFrame:
    """``section, name, value``: events by source and topic, duplicate share, missing timestamps, degraded events; scores' mean, deviation and range."""
    long = lambda df, section: df.select(F.lit(section).alias("section"), "name", F.col("value").cast("double").alias("value"))
    count = lambda c: raw.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("value"))
    gone = sum(F.col(c).isNull().cast("long") for c in ("published_at", "observed_at") if c in raw.columns)
    one = raw.agg(F.count("*").alias("rows"), sdiv(F.count("*") - F.count_distinct("content_hash"), F.count("*")).alias("duplicate_rate"), F.sum(gone).alias("missing_timestamps"), F.sum(F.coalesce("degraded", F.lit(False)).cast("long")).alias("degraded"))
    s = scored.agg(F.count("*").alias("rows"), F.avg("sentiment_score").alias("mean"), F.stddev_samp("sentiment_score").alias("std"), F.min("sentiment_score").alias("min"), F.max("sentiment_score").alias("max"))
    unpivot = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("x")).select("x.*")
    return reduce(DataFrame.unionByName, [long(count("source"), "source"), long(count("query_topic"), "topic"), long(unpivot(one), "raw"), long(unpivot(s), "scored")])


def range_coverage(days: DataFrame, observations: DataFrame, day: str = "day", obs_day: str = "obs_date") -> DataFrame:
    """Share of days inside the span of a series that is carried forward."""
    span = observations.agg(F.min(obs_day).alias("_lo"), F.max(obs_day).alias("_hi"))  # one row
    return days.join(F.broadcast(span)).agg(F.avg(F.coalesce(F.col(day).between(F.col("_lo"), F.col("_hi")), F.lit(False)).cast("double")).alias("coverage"))


def day_coverage(days: DataFrame, present: DataFrame, day: str = "day") -> DataFrame:
    """Share of days that a lake holds themselves."""
    have = present.select(F.col(day)).distinct().withColumn("_have", F.lit(1.0))
    return days.join(have, day, "left").agg(F.avg(F.coalesce("_have", F.lit(0.0))).alias("coverage"))


def fold_class_weights(df: DataFrame, fold: str, label: str, weight: str) -> DataFrame:
    """Balanced class weights of each fold's training rows, on their sample-weight mass."""
    g = df.groupBy(fold, label).agg(F.sum(weight).alias("mass"))
    every = Window.partitionBy(fold)  # a row a class
    return g.select(fold, label, "mass", sdiv(F.sum("mass").over(every), F.count("*").over(every) * F.col("mass")).alias("class_weight"))
