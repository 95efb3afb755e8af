"""Reads and writes by domain: bars and quotes, rolls, features and labels, news and macro lakes, slots, caches and run summaries."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import session_tag
from ..operators import continuous as C
from ..operators.asof import asof_join
from .lake import DATASETS, Lake, coerce, latest_ingest


def vendor_rows(df: DataFrame, symbol: str, dataset: str, source: str = "vendor") -> DataFrame:
    """A vendor's frame (ts_event, symbol as contract, instrument_id, prices) in the columns of ``bars_1m`` or ``trades``, with the session tag."""
    rows = df.withColumns({"contract_id": F.col("symbol").cast("string"), "con_id": F.col("instrument_id"), "symbol": F.lit(symbol), "ts_ingest": F.current_timestamp(), "source": F.lit(source), "session": session_tag("ts_event")})
    return coerce(rows, dataset)


class Store(Lake):
    """The lake in domain terms. Every read gives the latest ingest of a key."""

    def bars(self, symbol: str, start, end, freq: str = "1m", continuous: bool = False, adjustment: str = "ratio") -> DataFrame:
        """Bars of a symbol with start <= ts_event <= end; ``continuous``: front-month bars, adjusted over the whole history and then cut."""
        dataset = f"bars_{freq}"
        if not continuous:
            return self.read_window(dataset, symbol, start, end, ["ts_event", "contract_id"])
        every = latest_ingest(self.scan(dataset, symbol), ["ts_event", "contract_id"], "ts_ingest").withColumnRenamed("ts_event", "ts")
        rolls = self.rolls(symbol).select(F.to_date("ts_event").alias("roll_date"), F.col("from_contract_id").alias("from_contract"), F.col("to_contract_id").alias("to_contract"))
        return C.continuous(every, rolls, adjustment).withColumnRenamed("ts", "ts_event").where((F.col("ts_event") >= F.lit(start)) & (F.col("ts_event") <= F.lit(end))).orderBy("ts_event")

    def quotes(self, symbol: str, start, end) -> DataFrame:
        return self.read_window("quotes_l1", symbol, start, end, ["ts_event", "contract_id"])

    def rolls(self, symbol: str) -> DataFrame:
        return self.scan("rolls", symbol).orderBy("ts_event")

    def persist_rolls(self, symbol: str, rolls: DataFrame, source: str = "derived") -> int:
        """Writes ``roll_date, from_contract, to_contract`` as roll events; a contract rolled to before is there already."""
        rows = rolls.select(F.col("roll_date").cast("timestamp").alias("ts_event"), F.current_timestamp().alias("ts_ingest"), F.lit(symbol).alias("symbol"), F.col("from_contract").alias("from_contract_id"), F.col("to_contract").alias("to_contract_id"), F.lit("volume_or_expiry").alias("reason"), F.lit(source).alias("source"))
        return self.write("rolls", rows)

    def build_continuous(self, symbol: str, expiries: DataFrame, days_to_expiry: int = 5, adjustment: str = "ratio", freq: str = "1m") -> tuple[DataFrame, DataFrame, DataFrame]:
        """From a symbol's bars: rolls (stored), the continuous series, and the gaps left at its seams. ``expiries(contract_id, expiry)`` is a row a contract."""
        every = latest_ingest(self.scan(f"bars_{freq}", symbol), ["ts_event", "contract_id"], "ts_ingest").withColumnRenamed("ts_event", "ts").join(expiries, "contract_id")
        rolls = C.rolls(C.front_month(C.daily_volume(every), days_to_expiry))
        self.persist_rolls(symbol, rolls)
        series = C.continuous(every, rolls, adjustment)
        return rolls, series, C.seam_gaps(series, rolls)

    def attach(self, left: DataFrame, dataset: str, symbol: str, columns: list[str], on: str = "ts_event", prefix: str = "") -> DataFrame:
        """Columns of a stored table as of each row's time (features or labels to bars, features to labels): only these columns are read."""
        d = DATASETS[dataset]
        right = latest_ingest(self.scan(dataset, symbol).select(*dict.fromkeys([d.time, d.ingest, *columns])), [d.time], d.ingest)
        return asof_join(left, right.select(F.col(d.time).alias("_time"), *columns), on=on, right_on="_time", take=columns, prefix=prefix)

    def news(self, dataset: str = "news_raw") -> DataFrame:
        """Raw events: the latest ingest of a content hash; scored ones: of a hash and model."""
        d = DATASETS[dataset]
        return latest_ingest(self.scan(dataset), list(d.key), d.ingest)

    # --- slots: a file's events replace what the same slot held ---

    def write_slot(self, dataset: str, df: DataFrame, slot) -> None:
        """The rows of one 15-minute slot, one a content hash, in the partition (date, slot): writing a slot again replaces it."""
        at = F.lit(slot).cast("timestamp")
        rows = latest_ingest(df, ["content_hash"], "observed_at").withColumns({"_date": F.to_date(at), "_slot": F.date_format(at, "HHmm")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("_date", "_slot").parquet(f"{self.path}/{dataset}-slots")

    def read_slots(self, dataset: str, start=None, end=None) -> DataFrame:
        """Rows of the days from start to end; other days' folders are not listed."""
        df = self.spark.read.parquet(f"{self.path}/{dataset}-slots")
        if start is not None:
            df = df.where(F.col("_date") >= F.lit(start).cast("date"))
        return (df.where(F.col("_date") <= F.lit(end).cast("date")) if end is not None else df).drop("_slot")

    def covered_days(self, dataset: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{dataset}-slots").select(F.col("_date").alias("day")).distinct()

    # --- caches and summaries ---

    def cached(self, name: str, versions: dict[str, str], build: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
        """A table kept under its name and versions: built once, read after; other versions are other tables."""
        path = f"{self.path}/cache/{name}-" + "-".join(f"{k}={versions[k]}" for k in sorted(versions))
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if fresh or not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def save_run(self, kind: str, symbol: str, summary: dict) -> None:
        """A run's summary as JSON, one a kind and symbol; the last one counts."""
        row = self.spark.createDataFrame([(symbol, json.dumps(summary, sort_keys=True, default=str))], "symbol string, summary string")
        row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/runs/{kind}")

    def runs(self, kind: str) -> DataFrame:
        """``symbol, summary, saved_at``: the last run of each symbol; none if nothing was saved."""
        path = f"{self.path}/runs/{kind}"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], "symbol string, summary string, saved_at timestamp")
        return latest_ingest(self.spark.read.parquet(path), ["symbol"], "saved_at")

    def run_health(self, kind: str, symbols: list[str], fields: dict[str, str]) -> DataFrame:
        """A row a symbol with ``has_run`` and the named fields (JSON path, type) of its last summary, null where there is none."""
        wanted = self.spark.createDataFrame([(s,) for s in symbols], "symbol string")
        j = wanted.join(self.runs(kind), "symbol", "left")
        return j.select("symbol", F.col("summary").isNotNull().alias("has_run"), *[F.get_json_object("summary", f"$.{k}").try_cast(t).alias(k.replace(".", "_")) for k, t in fields.items()])


def parse_fixture(spark: SparkSession, payloads: DataFrame, column: str, topic: str) -> DataFrame:
    """Raw events of JSON payloads of either kind: article lists and filings by what they hold; ``source, source_id, title, observed_at, degraded``."""
    from ..operators import news as N

    common = ["source", "source_id", "title", "observed_at", "degraded"]
    articles = N.parse_article_list(payloads.where(F.get_json_object(column, "$.articles").isNotNull()), column, topic)
    filings = N.parse_filings(payloads.where(F.get_json_object(column, "$.filings").isNotNull()), column)
    return articles.select(*common).unionByName(filings.select(*common))
