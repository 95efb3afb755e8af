"""News: parsers to events, point-in-time filters, deduplication, window sentiment, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import content_hash, page_title, sdiv, theme_match, us
from .asof import window_totals

ARTICLES = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>>"
FILINGS = "struct<name:string,filings:struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,primaryDocument:array<string>>>>"


def parse_article_list(df: DataFrame, payload: str, topic: str) -> DataFrame:
    """Raw events of article-list JSON payloads; an article without title or date is kept as degraded."""
    a = df.select(F.explode_outer(F.from_json(payload, ARTICLES)["articles"]).alias("a")).select("a.*").where("url is not null or title is not null")
    seen = F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    bad = F.col("title").isNull() | (F.trim("title") == "") | seen.isNull()
    return a.select(F.lit("articles").alias("source"), F.col("url").alias("source_id"), "title", seen.alias("published_at"), seen.alias("observed_at"), F.lit(topic).alias("query_topic"), "language", bad.alias("degraded"), content_hash(F.lit("articles"), "url", "title", F.lit(""), F.date_format(seen, "yyyy-MM-dd'T'HH:mm:ss")).alias("content_hash"))


def parse_filings(df: DataFrame, payload: str) -> DataFrame:
    """Raw events of filings JSON: parallel arrays zipped by position; acceptance time, or else the filing date."""
    r = df.select(F.from_json(payload, FILINGS).alias("p")).select(F.col("p.name").alias("name"), F.explode(F.arrays_zip("p.filings.recent.accessionNumber", "p.filings.recent.form", "p.filings.recent.filingDate", "p.filings.recent.acceptanceDateTime")).alias("f"))
    f = r.select("name", F.col("f.accessionNumber").alias("source_id"), F.col("f.form").alias("form"), F.col("f.filingDate").alias("d"), F.col("f.acceptanceDateTime").alias("t"))
    at = F.coalesce(F.try_to_timestamp("t", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), F.try_to_timestamp("d", F.lit("yyyy-MM-dd")))
    return f.select(F.lit("filings").alias("source"), "source_id", F.concat_ws(" ", "name", "form").alias("title"), at.alias("published_at"), at.alias("observed_at"), at.isNull().alias("degraded"))


def parse_knowledge_graph(lines: DataFrame, prefixes: tuple[str, ...], column: str = "value") -> DataFrame:
    """Rows of tab-separated knowledge-graph lines (27 fields) whose themes match; malformed lines are kept with ``malformed`` true."""
    p = F.split(column, "\t", -1)
    tone = F.split(F.try_element_at(p, F.lit(16)), ",")
    parts = {i: F.try_element_at(tone, F.lit(i + 1)).try_cast("double") for i in range(3)}
    at = F.try_to_timestamp(F.try_element_at(p, F.lit(2)), F.lit("yyyyMMddHHmmss"))
    rows = lines.select(
        F.try_element_at(p, F.lit(1)).alias("source_id"), at.alias("published_at"), F.try_element_at(p, F.lit(4)).alias("domain"), F.try_element_at(p, F.lit(5)).alias("source_url"),
        F.try_element_at(p, F.lit(8)).alias("themes"), parts[0].alias("tone"), parts[1].alias("pos"), parts[2].alias("neg"),
        F.regexp_extract(F.coalesce(F.try_element_at(p, F.lit(27)), F.lit("")), r"<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1).alias("title"), (F.size(p) < 27).alias("short"),
    )
    rows = rows.withColumn("malformed", F.col("short") | F.col("published_at").isNull() | F.col("tone").isNull()).drop("short")
    return rows.where(F.col("malformed") | theme_match(F.coalesce("themes", F.lit("")), prefixes))


def pages_to_events(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", page_title("html").alias("title"))


def point_in_time(events: DataFrame, as_of: Column) -> DataFrame:
    """Events observed by ``as_of`` and not degraded."""
    return events.where((F.col("observed_at") <= as_of) & ~F.coalesce(F.col("degraded"), F.lit(False)))


def violates_clock(published: str = "published_at", observed: str = "observed_at", ingested: str = "ingested_at") -> Column:
    """True where the three clocks are out of order: such rows go to quarantine."""
    return (F.col(observed) < F.col(published)) | (F.col(ingested) < F.col(observed))


def dedupe(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def select_unscored(raw: DataFrame, scored: DataFrame, model: str) -> DataFrame:
    done = scored.where(F.col("model_name") == model).select("content_hash").distinct()
    return raw.where(~F.coalesce(F.col("degraded"), F.lit(False))).join(done, "content_hash", "left_anti")


def normalise_scored(df: DataFrame) -> DataFrame:
    """Scored events ready for windows: timestamps as such, ``degraded`` false by default. A missing score or time column is an error."""
    needed = ("content_hash", "observed_at", "scored_at", "sentiment_score", "positive_score", "negative_score", "neutral_score", "model_name")
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"scored events need {', '.join(missing)}")
    times = {c: F.col(c).cast("timestamp") for c in ("published_at", "observed_at", "scored_at") if c in df.columns}
    degraded = F.coalesce(F.col("degraded").cast("boolean"), F.lit(False)) if "degraded" in df.columns else F.lit(False)
    return df.withColumns(times | {"degraded": degraded})


def dedupe_scored(df: DataFrame) -> DataFrame:
    """One row a content hash: the latest scored."""
    return dedupe(df, "content_hash", F.desc_nulls_last("scored_at"), F.asc("model_name"))


def sentiment_features(events: DataFrame, targets: DataFrame, minutes: list[int], event_time: str = "observed_at", target_time: str = "ts", lag_minutes: int = 0, by: list[str] | None = None) -> DataFrame:
    """Per target and window (t - w, t]: count, has_any, mean, sum, mean positive, negative and neutral, max abs score, deviation, latest age in
    minutes; degraded events counted apart.

    ``events(observed_at, sentiment_score, positive_score, negative_score, neutral_score, degraded)``; the count is 0 and the scores null where
    the window is empty. ``by`` columns (a source, a topic) must be equal in events and targets.
    """
    good = ~F.coalesce(F.col("degraded"), F.lit(False))
    s = F.when(good, F.col("sentiment_score"))
    present = [c for c in ("positive", "negative", "neutral") if f"{c}_score" in events.columns]
    sums = {"good": good.cast("int"), "sum": s, "square": s * s} | {c: F.when(good, F.col(f"{c}_score")) for c in present}
    at = targets.withColumn("_when", F.col(target_time).cast("timestamp") - F.expr(f"interval {lag_minutes} minutes"))
    w = window_totals(events, at, [m * 60_000_000 for m in minutes], sums, {"max_abs": F.abs(s), "latest": F.when(good, us(event_time))}, event_time, "_when", by)
    found = {}
    for i, m in enumerate(minutes):
        n = F.coalesce(F.col(f"good_{i}"), F.lit(0.0)).cast("long")
        some = lambda c: F.when(n > 0, c)  # noqa: E731, B023
        mean = sdiv(f"sum_{i}", n)
        var = sdiv(f"square_{i}", n) - mean * mean
        found |= {f"n_{m}": n, f"any_{m}": (n > 0).cast("int"), f"mean_{m}": mean, f"sum_{m}": some(F.col(f"sum_{i}")), f"std_{m}": some(F.when(var > 4e-15, F.sqrt(var)).otherwise(0.0)), f"max_abs_{m}": F.col(f"max_abs_{i}")}
        found |= {f"{c[:3]}_{m}": sdiv(f"{c}_{i}", n) for c in present}
        found |= {f"age_{m}": (us("_when") - F.col(f"latest_{i}")) / 60_000_000.0, f"n_degraded_{m}": F.col(f"n_{i}") - n}
    return w.select(*targets.columns, *[c.alias(k) for k, c in found.items()])


def sentiment_by_group(events: DataFrame, targets: DataFrame, minutes: list[int], column: str, values: list[str], event_time: str = "observed_at", target_time: str = "ts", target_key: str = "id") -> DataFrame:
    """Per target, window and configured value of ``column`` (a source or topic): ``<column>_<value>_n_<w>`` and ``..._mean_<w>``."""
    wide = targets.select(target_key, target_time).withColumn(column, F.explode(F.array(*map(F.lit, values))))
    long = sentiment_features(events.where(F.col(column).isin(*values)), wide, minutes, event_time, target_time, by=[column])
    cells = [F.max(F.when(F.col(column) == v, F.col(f"{f}_{m}"))).alias(f"{column}_{v}_{f}_{m}") for v in values for m in minutes for f in ("n", "mean")]
    return targets.join(long.groupBy(target_key).agg(*cells), target_key)


def attach_sentiment(labels: DataFrame, events: DataFrame, minutes: list[int], time: str = "t0") -> DataFrame:
    """Labels with the window features at their start; nothing later than it is read, and every label stays."""
    return sentiment_features(dedupe_scored(normalise_scored(events)), labels, minutes, target_time=time)


def coverage(features: DataFrame, minutes: list[int]) -> DataFrame:
    """Rows, and rows with any event in each window."""
    return features.agg(F.count("*").alias("rows"), *[F.sum(f"any_{m}").alias(f"any_{m}") for m in minutes])


def events_used(events: DataFrame, targets: DataFrame, width_us: int, event_time: str, target_time: str) -> DataFrame:
    """Events some target's window (t - w, t] holds: those whose next target lies less than w after them."""
    from .asof import asof_join

    nxt = asof_join(events, targets.select(F.col(target_time).alias("_next")), on=event_time, right_on="_next", take=["_next"], forward=True, prefix="")
    return nxt.where(us("_next") - us(event_time) < width_us).drop("_next")
