"""Record decoding, calendars, request plans and access policy: what surrounds a source without touching the network."""

from __future__ import annotations

import datetime as dt
import json
import time
from dataclasses import dataclass, field
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import RTH_CLOSE, RTH_OPEN, TZ

NO_PRICE = 9223372036854775807  # fixed value: the feed's mark for a missing price


def decode_prices(df: DataFrame, raw: str, out: str, scale: float = 1e-9) -> DataFrame:
    """Fixed-point integers as prices, null where the feed has none."""
    return df.withColumn(out, F.when(F.col(raw) != NO_PRICE, F.col(raw) * scale))


def trade_sign(side: Column | str) -> Column:
    """Aggressor: B buys (1), A sells (-1), else 0."""
    side = F.col(side) if isinstance(side, str) else side
    return F.when(side == "B", 1).when(side == "A", -1).otherwise(0)


def contract_names(df: DataFrame, names: DataFrame, instrument: str = "instrument_id") -> DataFrame:
    """Contract symbol by instrument id, ``id<n>`` where unknown. The dictionary is a day's instruments."""
    return df.join(names, instrument, "left").withColumn("contract", F.coalesce("contract", F.concat(F.lit("id"), F.col(instrument).cast("string"))))


def trading_days(df: DataFrame, first: str, last: str) -> DataFrame:
    """Mondays to Fridays from first to last."""
    return df.select(F.explode(F.sequence(first, last)).alias("day")).where(F.weekday("day") < 5)


def fetch_windows(days: DataFrame, day: str = "day", rth_only: bool = True) -> DataFrame:
    """``fetch_from, fetch_to`` (UTC) of each day: its regular session in exchange time, or the whole UTC day."""
    midnight = F.col(day).cast("timestamp_ntz")
    if not rth_only:
        return days.withColumns({"fetch_from": F.col(day).cast("timestamp"), "fetch_to": F.date_add(day, 1).cast("timestamp")})
    local = lambda minutes: F.to_utc_timestamp(midnight + F.make_dt_interval(mins=F.lit(minutes)), TZ)
    return days.withColumns({"fetch_from": local(RTH_OPEN), "fetch_to": local(RTH_CLOSE)})


def estimate_cost(quotes: DataFrame, keys: list[str], cost: str, size: str) -> DataFrame:
    """Money and bytes by symbol from a quote a day: what the planned windows would take."""
    return quotes.groupBy(*keys).agg(F.sum(cost).alias("cost"), F.sum(size).cast("long").alias("bytes"), F.count("*").alias("days"))


def year_chunks(start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """[start, end) cut at calendar years."""
    edges = [start, *(dt.date(y, 1, 1) for y in range(start.year + 1, end.year + 1) if dt.date(y, 1, 1) < end), end]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def slot_grid(start: dt.datetime, end: dt.datetime, minutes: int = 15) -> list[dt.datetime]:
    step, out, t = dt.timedelta(minutes=minutes), [], start
    while t < end:
        out.append(t)
        t += step
    return out


def request_plan(topics: list[str], start: dt.date, end: dt.date, supported_from: dt.date) -> list[tuple[str, dt.date]]:
    """(topic, day) slices, the supported region first, newest day first inside each."""
    days = [start + dt.timedelta(i) for i in range((end - start).days)]
    slices = [(t, d) for d in reversed(days) for t in topics]
    return sorted(slices, key=lambda s: s[1] < supported_from)


def bisect_slice(start: dt.datetime, end: dt.datetime, least: dt.timedelta) -> list[tuple[dt.datetime, dt.datetime]]:
    """Two halves of a slice, or the slice itself where halves would be shorter than ``least``."""
    middle = start + (end - start) / 2
    return [(start, middle), (middle, end)] if middle - start >= least else [(start, end)]


def query_url(base: str, **params: str | int) -> str:
    return base + "?" + "&".join(f"{k}={quote_plus(str(v))}" for k, v in params.items())


@dataclass
class Manifest:
    """Which slices are done, kept as JSON text; the caller stores it."""

    done: set[str] = field(default_factory=set)

    def pending(self, slices: list[str]) -> list[str]:
        return [s for s in slices if s not in self.done]

    def mark(self, name: str) -> None:
        self.done.add(name)

    def dumps(self) -> str:
        return json.dumps(sorted(self.done))

    @classmethod
    def loads(cls, text: str) -> Manifest:
        return cls(set(json.loads(text)))


@dataclass(frozen=True)
class SourcePolicy:
    source: str
    free: bool
    network: bool
    max_bytes: int = 0
    max_requests: int = 0


class AccessDenied(RuntimeError):
    pass


def classify(source: str, registry: dict[str, SourcePolicy]) -> SourcePolicy:
    """The policy of a source; unknown sources are refused."""
    if source not in registry:
        raise AccessDenied(f"{source} has no policy")
    return registry[source]


def access_plan(source: str, registry: dict[str, SourcePolicy], requests: int, size: int, allow_network: bool, budget: float = 0.0, cost: float = 0.0) -> dict:
    """Fails closed: network, request, byte and money limits must all hold before a fetch may start."""
    p = classify(source, registry)
    for bad, why in ((p.network and not allow_network, "network is off"), (requests > p.max_requests, "too many requests"), (size > p.max_bytes, "too many bytes"), (not p.free and cost > budget, "over budget")):
        if bad:
            raise AccessDenied(f"{source}: {why}")
    return {"source": source, "requests": requests, "bytes": size, "cost": cost}


class Runner:
    """Walks pending slices of a plan under caps of requests, bytes and seconds, with a pause between requests and retries that back off.

    ``fetch(slice)`` returns the bytes it took or raises; ``clock`` and ``sleep`` are injected, so a test needs no time. What is done is marked in
    the manifest, so a stopped run goes on where it ended.
    """

    def __init__(self, manifest: Manifest, max_requests: int, max_bytes: int, max_seconds: float, pause: float = 0.0, retries: int = 3, backoff: float = 2.0, clock=time.monotonic, sleep=time.sleep):
        self.manifest, self.limits, self.pause, self.retries, self.backoff, self.clock, self.sleep = manifest, (max_requests, max_bytes, max_seconds), pause, retries, backoff, clock, sleep

    def run(self, slices: list[str], fetch) -> dict:
        began, requests, size, failed, stopped = self.clock(), 0, 0, [], "done"
        for name in self.manifest.pending(slices):
            for attempt in range(self.retries + 1):
                spent = (requests, size, self.clock() - began)
                if any(s >= m for s, m in zip(spent, self.limits, strict=True)):
                    stopped = ("requests", "bytes", "time")[[s >= m for s, m in zip(spent, self.limits, strict=True)].index(True)]
                    return {"requests": requests, "bytes": size, "failed": failed, "stopped": stopped}
                if requests:
                    self.sleep(self.pause)
                requests += 1
                try:
                    size += fetch(name)
                    self.manifest.mark(name)
                    break
                except OSError:
                    if attempt == self.retries:
                        failed.append(name)
                    else:
                        self.sleep(self.backoff ** (attempt + 1))
        return {"requests": requests, "bytes": size, "failed": failed, "stopped": stopped}


def observations(df: DataFrame, payload: str) -> DataFrame:
    """Series observations of JSON payloads: missing-value marks dropped, dates parsed, release date kept."""
    o = df.select(F.explode(F.from_json(payload, "struct<observations:array<struct<date:string,value:string,realtime_start:string>>>")["observations"]).alias("o")).select("o.*")
    value = F.col("value").try_cast("double")
    return o.where(value.isNotNull()).select(F.try_to_date("date").alias("obs_date"), value.alias("value"), F.try_to_date("realtime_start").alias("release_date"))
