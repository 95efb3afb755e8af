"""The parquet lake: pinned schemas, idempotent appends, latest-ingest reads, compaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    """A dataset's pinned columns and natural key."""

    name: str
    ddl: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ("ts_event", "ts_ingest", "symbol")
    time: str = "ts_event"
    ingest: str = "ts_ingest"
    split: str = "symbol"
    grain: str = "day"  # what a partition spans: a table of few rows a day takes a year

    def date(self) -> Column:
        """The day of the partition a row belongs to."""
        return F.to_date(F.date_trunc(self.grain, F.col(self.time)))

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.ddl)


_BAR = "ts_event timestamp, ts_ingest timestamp, symbol string, contract_id string, con_id bigint, open double, high double, low double, close double, volume double, wap double, n_trades bigint, session string, source string, schema_version int"
_QUOTE = "ts_event timestamp, ts_ingest timestamp, symbol string, contract_id string, con_id bigint, bid double, ask double, bid_size double, ask_size double, last double, last_size double, session string, source string, schema_version int"
_ROLL = "ts_event timestamp, ts_ingest timestamp, symbol string, from_contract_id string, to_contract_id string, reason string, source string, schema_version int"
_TRADE = "ts_event timestamp, ts_ingest timestamp, symbol string, contract_id string, con_id bigint, price double, size double, side string, source string, schema_version int"

DATASETS = {
    d.name: d
    for d in (
        Dataset("bars_1m", _BAR, ("ts_event", "contract_id")),
        Dataset("bars_5s", _BAR, ("ts_event", "contract_id")),
        Dataset("bars_1d", _BAR, ("ts_event", "contract_id"), grain="year"),
        Dataset("quotes_l1", _QUOTE, ("ts_event", "contract_id")),
        Dataset("trades", _TRADE, ("ts_event", "contract_id", "price", "size")),
        Dataset("rolls", _ROLL, ("symbol", "to_contract_id", "ts_event"), grain="year"),
        Dataset("macro_events", "event_time timestamp, event_type string, ref_period date, actual_pit double, prior double, surprise double, source string, fred_series_id string, ingest_ts timestamp, macro_version string", ("event_type", "event_time"), ("event_time", "event_type", "ingest_ts"), "event_time", "ingest_ts", "event_type", "year"),
        Dataset("market_daily", "series_id string, obs_date date, value double, observed_at timestamp, ingested_at timestamp", ("series_id", "obs_date"), ("series_id", "obs_date", "ingested_at"), "obs_date", "ingested_at", "series_id", "year"),
        Dataset("news_raw", "content_hash string, source string, source_id string, source_url string, title string, snippet_or_text string, published_at timestamp, observed_at timestamp, ingested_at timestamp, query_topic string, language string, entities array<string>, sentiment_feature_version string, degraded boolean, error string", ("content_hash",), ("content_hash", "source", "observed_at"), "observed_at", "ingested_at", "source"),
        Dataset("micro_bars", "ts_event timestamp, ts_ingest timestamp, symbol string, contract_id string, con_id bigint, ts_open timestamp, open double, high double, low double, close double, vwap double, volume double, dollar_volume double, mid_open double, mid_close double, n_trades bigint, n_events bigint, bar_complete boolean, ofi_top double, signed_vol double, trade_imbalance double, spread_twa double, imbalance_twa double, depth_twa double, rv_intrabar double, duration_s double, dmid double, ret_bar double, source string, schema_version int", ("ts_event",)),
        Dataset("labels", "t0 timestamp, t1 timestamp, symbol string, ret double, label int, barrier string, sigma double, n_bars bigint, avg_uniqueness double, weight double, label_version string, ts_ingest timestamp", ("t0",), ("t0", "symbol", "ts_ingest"), "t0"),
        Dataset("micro_labels", "t0 timestamp, t1 timestamp, symbol string, contract_id string, session_date date, ret double, label int, barrier string, sigma double, n_bars bigint, resolved_at_close boolean, avg_uniqueness double, weight double, label_version string, ts_ingest timestamp", ("t0",), ("t0", "symbol", "ts_ingest"), "t0"),
        Dataset("news_scored", "content_hash string, source string, query_topic string, published_at timestamp, observed_at timestamp, sentiment_feature_version string, positive_score double, negative_score double, neutral_score double, sentiment_score double, model_name string, model_version_or_hash string, scored_at timestamp", ("content_hash", "model_name"), ("content_hash", "model_name", "observed_at"), "observed_at", "scored_at", "source"),
    )
}


def feature_dataset(name: str, columns: list[str]) -> Dataset:
    """Registers a table of feature columns (doubles) by (symbol, ts_event); the same columns again change nothing."""
    ddl = "ts_event timestamp, ts_ingest timestamp, symbol string, " + "".join(f"`{c}` double, " for c in columns) + "degraded boolean, feature_version string"
    found = Dataset(name, ddl, ("ts_event",))
    if DATASETS.setdefault(name, found).ddl != ddl:
        raise ValueError(f"{name} has other columns")
    return found


def empty(spark: SparkSession, dataset: str) -> DataFrame:
    return spark.createDataFrame([], DATASETS[dataset].schema)


def coerce(df: DataFrame, dataset: str) -> DataFrame:
    """``df`` in the dataset's columns: values that do not cast are null, missing optional columns are null, schema_version is 1 by default.
    A missing required column is an error; columns the dataset does not have are dropped."""
    d = DATASETS[dataset]
    missing = [c for c in d.required if c not in df.columns]
    if missing:
        raise ValueError(f"{dataset} needs {', '.join(missing)}")
    out = []
    for f in d.schema.fields:
        if f.name in df.columns:
            x = F.col(f.name).cast(f.dataType) if dict(df.dtypes)[f.name] == f.dataType.simpleString() else F.col(f.name).try_cast(f.dataType)
            if f.name == "schema_version":
                x = F.coalesce(x, F.lit(1))
        else:
            x = F.lit(1 if f.name == "schema_version" else None).cast(f.dataType)
        out.append(x.alias(f.name))
    return df.select(*out)


def latest_ingest(df: DataFrame, key: list[str], ingest: str) -> DataFrame:
    """One row a key: the one ingested last."""
    w = Window.partitionBy(*key).orderBy(F.col(ingest).desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def new_rows(batch: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``existing``."""
    return batch.join(existing.select(*key).distinct(), key, "left_anti")


class Lake:
    """A folder of datasets, partitioned by (split column, UTC date or, for sparse tables, year)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, dataset: str) -> str:
        return f"{self.path}/{dataset}"

    def _exists(self, dataset: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._folder(dataset))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _files(self, dataset: str) -> DataFrame:
        d = DATASETS[dataset]
        schema = T.StructType([*d.schema.fields, T.StructField("_split", T.StringType()), T.StructField("_date", T.DateType())])
        return self.spark.read.schema(schema).parquet(self._folder(dataset))

    def scan(self, dataset: str, split: str | None = None) -> DataFrame:
        """All rows, or those of one symbol (series, source): partition values prune folders. An absent dataset is empty."""
        if not self._exists(dataset):
            return empty(self.spark, dataset)
        df = self._files(dataset)
        return (df.where(F.col("_split") == split) if split is not None else df).drop("_split", "_date")

    def write(self, dataset: str, df: DataFrame) -> int:
        """Appends rows whose key its partition does not hold yet, and returns their number. Duplicates inside a batch stay."""
        d = DATASETS[dataset]
        rows = coerce(df, dataset).withColumn("_split", F.col(d.split)).withColumn("_date", d.date())
        if self._exists(dataset):
            key = list(dict.fromkeys([*d.key, "_split", "_date"]))
            dates = [r[0] for r in rows.select("_date").distinct().collect()]  # a row a day of the batch: prunes the scan of what exists
            rows = rows.join(self._files(dataset).where(F.col("_date").isin(dates)).select(*key), key, "left_anti")
        rows = rows.persist()
        try:
            n = rows.count()
            if n:
                rows.repartition("_split", "_date").write.mode("append").option("compression", "zstd").partitionBy("_split", "_date").parquet(self._folder(dataset))
            return n
        finally:
            rows.unpersist()

    def compact(self, dataset: str, split: str | None = None) -> int:
        """Rewrites each partition (of one symbol, or all) as one file with one row a key, the last ingested; returns how many rows went.

        The compacted rows are written beside the dataset first and then replace its partitions, so a run that dies midway loses nothing.
        """
        d, beside = DATASETS[dataset], f"{self._folder(dataset)}-compacting"
        if not self._exists(dataset):
            return 0
        old = self._files(dataset)
        old = old.where(F.col("_split") == split) if split is not None else old
        before = old.count()
        rows = latest_ingest(old, [*dict.fromkeys([*d.key, "_split", "_date"])], d.ingest)
        rows.repartition("_split", "_date").write.mode("overwrite").option("compression", "zstd").partitionBy("_split", "_date").parquet(beside)
        done = self.spark.read.schema(old.schema).parquet(beside)
        after = done.count()
        done.repartition("_split", "_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("_split", "_date").parquet(self._folder(dataset))
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(beside)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return before - after

    def read_window(self, dataset: str, split: str, start, end, key: list[str] | None = None) -> DataFrame:
        """Rows of one symbol with start <= time <= end, the latest ingest of each key, in time order."""
        d = DATASETS[dataset]
        if not self._exists(dataset):
            return empty(self.spark, dataset)
        t = F.col(d.time)
        df = self._files(dataset).where((F.col("_split") == split) & F.col("_date").between(F.to_date(F.date_trunc(d.grain, F.lit(start).cast("timestamp"))), F.to_date(F.lit(end).cast("timestamp"))) & (t >= F.lit(start)) & (t <= F.lit(end)))
        return latest_ingest(df, key or list(d.key), d.ingest).drop("_split", "_date").orderBy(d.time, *[k for k in d.key if k != d.time])
