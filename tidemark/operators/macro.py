"""Releases and daily market series as of decision times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import TZ, local, sdiv, us
from .asof import asof_join, window_totals
from .windows import positions

BLOCK = 4096  # events that a task orders at once


def event_timing(targets: DataFrame, events: DataFrame, time: str = "ts", event_time: str = "event_time", blackout_minutes: int = 120) -> DataFrame:
    """Minutes since the last event (at or before), minutes to the next one, and whether either lies within the blackout."""
    e = events.select(F.col(event_time).alias("e")).distinct()
    out = asof_join(targets, e, on=time, right_on="e", take=["e"], prefix="prev_")
    out = asof_join(out, e, on=time, right_on="e", take=["e"], prefix="next_", forward=True, strict=True)
    since, to = (us(time) - us("prev_e")) / 60_000_000.0, (us("next_e") - us(time)) / 60_000_000.0
    near = F.coalesce(since <= blackout_minutes, F.lit(False)) | F.coalesce(to <= blackout_minutes, F.lit(False))
    return out.withColumns({"mins_since": since, "mins_to": to, "blackout": near}).drop("prev_e", "next_e")


def event_change(targets: DataFrame, events: DataFrame, time: str = "ts", event_time: str = "event_time", n: int = 3, kind: str | None = None) -> DataFrame:
    """The latest event's change against the one of its ``kind`` before it, and the mean of its last n changes. Without a kind all events are of one.

    Changes are found over blocks of a ``kind`` and month with the last n events before each, so no task orders a whole history.
    """
    by = [kind] if kind else []
    pos = positions(events, by, [event_time, "event_id"], F.to_date(event_time))
    # an event is written to its own block of places and, if it is among a block's last n, to the next one
    block = F.floor(F.col("pos") / BLOCK)
    late = F.col("pos") % BLOCK >= BLOCK - n - 1
    pos = pos.withColumn("_block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block)))).withColumn("_own", F.col("_block") == block)
    w = Window.partitionBy(*by, "_block").orderBy("pos")
    e = pos.withColumn("change", F.col("actual") - F.lag("actual").over(w)).withColumn("tendency", F.avg("change").over(w.rowsBetween(1 - n, 0))).where("_own")
    return asof_join(targets, e.select(event_time, "change", "tendency"), on=time, right_on=event_time, take=["change", "tendency"], prefix="")


def market_state(targets: DataFrame, series: DataFrame, changes: tuple[int, ...] = (1, 5, 20), z: int = 60, time: str = "ts", key: str = "series_id") -> DataFrame:
    """Level, changes over k observations and trailing z (population deviation, zero deviation gives 0) of each series as observed by each target."""
    w = Window.partitionBy(key).orderBy("observed_at")
    frame = w.rowsBetween(1 - z, 0)
    sd = F.stddev_pop("value").over(frame)
    score = F.when(F.count("value").over(frame) >= z, F.when(sd == 0, 0.0).otherwise(sdiv(F.col("value") - F.avg("value").over(frame), sd)))
    s = series.withColumns({f"chg_{k}": F.col("value") - F.lag("value", k).over(w) for k in changes} | {"z": score})
    return asof_join(targets, s, on=time, right_on="observed_at", by=[key], take=["value", *[f"chg_{k}" for k in changes], "z"], prefix="", bucket_us=30 * 86_400_000_000)


def observed_end_of_day(day: str):
    """A daily value may be known from the last second of its date on."""
    return F.to_timestamp(F.col(day)) + F.expr("interval 86399 seconds")


def release_events(first_prints: DataFrame, clocks: DataFrame, tz: str = TZ) -> DataFrame:
    """Macro events of first prints: the value, the one of the period before (``prior``), and the release day's local clock time in UTC.

    ``first_prints(event_type, series_id, ref_period, value, release_date)``; ``clocks(event_type, minute)``, a row a type.
    """
    w = Window.partitionBy("event_type").orderBy("ref_period")
    e = first_prints.withColumn("prior", F.lag("value").over(w)).join(clocks, "event_type")
    at = F.to_utc_timestamp(F.col("release_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("minute")), tz)
    return e.select(at.alias("event_time"), "event_type", "ref_period", F.col("value").alias("actual_pit"), "prior", F.lit(None).cast("double").alias("surprise"), F.concat(F.lit("series:"), "series_id").alias("source"), F.col("series_id").alias("fred_series_id"))


def scheduled_events(dates: DataFrame, rates: DataFrame, event_type: str, series: str, minute: int, days: int = 3, tz: str = TZ) -> DataFrame:
    """Events of a fixed calendar with the rate in force some days after and before; null outcomes beyond the rates' reach.

    ``dates(day)``; ``rates(ref_period, value)``.
    """
    r = rates.select(F.col("ref_period").cast("timestamp").alias("_p"), "value")
    d = dates.withColumns({"_after": F.date_add("day", days).cast("timestamp"), "_before": F.date_sub("day", days).cast("timestamp")})
    for name, at in (("actual_pit", "_after"), ("prior", "_before")):
        d = asof_join(d, r.withColumnRenamed("value", name), on=at, right_on="_p", take=[name], prefix="", bucket_us=365 * 86_400_000_000)
    event = F.to_utc_timestamp(F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(minute)), tz)
    return d.select(event.alias("event_time"), F.lit(event_type).alias("event_type"), F.col("day").alias("ref_period"), "actual_pit", "prior", F.lit(None).cast("double").alias("surprise"), F.lit(f"series:{series}").alias("source"), F.lit(series).alias("fred_series_id"))


def macro_features(targets: DataFrame, events: DataFrame, types: list[str], high: list[str], days_of: list[str], time: str = "ts", lead_minutes: int = 30, ahead_hours: int = 24, tz: str = TZ) -> DataFrame:
    """Schedule features at each target: minutes to and since each type and any high-impact event, the blackout before one, the number of
    high-impact times in the next hours, and whether the local date is a day of a type. ``events(event_time, event_type)``.
    """
    minutes = lambda a, b: (us(a) - us(b)) / 60_000_000.0
    out = targets
    for name, e in [*((t, events.where(F.col("event_type") == t)) for t in types), ("event", events.where(F.col("event_type").isin(*high)))]:
        times = e.select(F.col("event_time").cast("timestamp").alias("e")).distinct()
        out = asof_join(out, times, on=time, right_on="e", take=["e"], prefix="_prev_", bucket_us=30 * 86_400_000_000)
        out = asof_join(out, times, on=time, right_on="e", take=["e"], prefix="_next_", forward=True, strict=True, bucket_us=30 * 86_400_000_000)
        out = out.withColumns({f"macro_mins_since_{name}": minutes(time, "_prev_e"), f"macro_mins_to_{name}": minutes("_next_e", time)}).drop("_prev_e", "_next_e")
    blackout = F.coalesce((F.col("macro_mins_to_event") <= lead_minutes).cast("double"), F.lit(0.0))
    distinct = events.where(F.col("event_type").isin(*high)).select(F.col("event_time").alias("ts")).distinct()
    ahead = out.withColumn("_until", F.col(time).cast("timestamp") + F.expr(f"interval {ahead_hours} hours"))
    out = window_totals(distinct, ahead, [ahead_hours * 3_600_000_000], {}, target_time="_until").drop("_until").withColumnRenamed("n_0", f"macro_events_next_{ahead_hours}h")
    out = out.withColumn("macro_in_blackout", blackout)
    for t in days_of:
        on = events.where(F.col("event_type") == t).select(F.to_date(local("event_time", tz)).alias("_day")).distinct().withColumn(f"_is_{t}", F.lit(1.0))
        out = out.withColumn("_day", F.to_date(local(time, tz))).join(on, "_day", "left").withColumn(f"macro_is_{t}_day", F.coalesce(f"_is_{t}", F.lit(0.0))).drop("_day", f"_is_{t}")
    return out


def curve_spread(levels: DataFrame, keys: list[str], long: str, short: str, key: str = "series_id", value: str = "value") -> DataFrame:
    """``keys, curve``: level of one series less that of another, null where one is missing, from a row a target and series."""
    pick = lambda s: F.max(F.when(F.col(key) == s, F.col(value)))
    return levels.groupBy(*keys).agg((pick(long) - pick(short)).alias(f"curve_{long}_{short}"))


def market_rows(observations: DataFrame, series: str) -> DataFrame:
    """Daily market rows of ``observations(obs_date, value)``: known from the last second of their date on."""
    return observations.select(F.lit(series).alias("series_id"), "obs_date", "value", observed_end_of_day("obs_date").alias("observed_at"), F.current_timestamp().alias("ingested_at"))


def ingest(store, dataset: str, parts: dict[str, DataFrame]) -> dict[str, int]:
    """Writes each part (an event type, a series) to its lake and returns how many rows were new."""
    return {name: store.write(dataset, rows) for name, rows in parts.items()}
