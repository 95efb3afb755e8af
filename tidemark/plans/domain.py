"""The supplied tables in domain terms: ticks, bars, daily series, news."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: symbol by event type, price value + 100, size k + 1, one of three instruments."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") + 100).alias("price"), (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("size"), (F.col("user_id") % 3).alias("instrument"), "user_id")


TICKS_SQL = "t as (select event_id, event_type as symbol, ts, value + 100 as price, cast(json_extract_string(props, '$.k') as bigint) + 1 as size, user_id % 3 as instrument, user_id from events)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by symbol."""
    from ..operators.bars import time_bars

    return time_bars(ticks(spark, sf_dir), ["symbol"], "1 hour")


BARS_SQL = TICKS_SQL + """, bars as (
  select symbol, date_trunc('hour', ts) as ts, arg_min(price, ts) as open, max(price) as high, min(price) as low, arg_max(price, ts) as close,
    sum(size)::double as volume, coalesce(sum(price * size) / nullif(sum(size), 0), arg_max(price, ts)) as wap, count(*) as n
  from t group by 1, 2
)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, timestamps without zone: what both engines can be compared by.

    Rounded as SQL's engine does it, the scaled double to the nearest whole one: Spark rounds the decimal digits, and minutes of a whole number of
    microseconds lie half way between two of six digits often.
    """
    scale, most = 10.0**digits, 1.7e308 / 10.0**digits
    out = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            x = F.col(name).cast("double")
            out[name] = F.when(F.abs(x) < most, F.round(x * scale) / scale).otherwise(x) + F.lit(0.0)
        elif kind == "timestamp":
            out[name] = F.col(name).cast("timestamp_ntz")
    return df.withColumns(out) if out else df


class Catalogue:
    """Named queries with their SQL."""

    def __init__(self) -> None:
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None, digits: int = 6):
        def wrap(f):
            self.queries[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
            if sql is not None:
                self.sql[f.__name__] = sql.replace(f", {digits}) as ", f", {digits}) + 0.0 as ")  # no negative zero
            return f

        return wrap
