"""Structured Streaming jobs: windowed bars, event-by-event dollar bars, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bars import time_bars
from ..plans.shipping import ship

TICK = "event_id bigint, symbol string, ts timestamp, price double, size bigint, instrument bigint, user_id bigint"


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files_a_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


REPLAY_ROWS = 250_000  # rows of a file


def replay(rows: DataFrame, folder: str, order: list[str], run: Callable[[], object], rows_a_file: int = REPLAY_ROWS, files_a_run: int = 16) -> None:
    """A finite table arrives in ``folder`` in the order of ``order``, event time first: ``run`` (a stream over what is there, by one checkpoint) follows every lot of files.

    The rows are sorted in ranges, a task a file of about ``rows_a_file``, beside the folder, and files are moved in by their names. So neither a task nor a lot grows with
    the table, the watermark passes from lot to lot, and no row comes late.
    """
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // rows_a_file))
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(f"{folder}-sorted")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted((x for x in (f.getPath().getName() for f in fs.listStatus(path(f"{folder}-sorted"))) if x.startswith("part-")), key=lambda x: (int(x.split("-")[1]), x))
    fs.mkdirs(path(folder))
    for lo in range(0, max(1, len(names)), files_a_run):
        for x in names[lo : lo + files_a_run]:
            if not fs.rename(path(f"{folder}-sorted/{x}"), path(f"{folder}/{x}")):
                raise OSError(f"{x} can't be moved into {folder}")
        run()


def bars_stream(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed bars in append mode: a bar is final once the watermark passes its end. Ticks are deduplicated by id within the watermark."""
    t = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    g = t.groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"),
        F.sum("size").cast("double").alias("volume"), (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("wap"), F.count("*").alias("n"),
    )
    return g.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "wap", "n")


def append_new(batch: DataFrame, path: str, key: list[str], time: str, order: str | None = None) -> None:
    """foreachBatch body: rows of a batch whose key the table at ``path`` lacks are appended, so a replayed batch changes nothing.

    Of rows with one key the one with the latest ``order`` (by default ``time``) counts. Only rows of the batch's span of ``time`` are read back.
    """
    from ..sources.lake import latest_ingest

    spark = batch.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    batch = latest_ingest(batch, key, order or time).persist()
    try:
        lo, hi = batch.agg(F.min(time), F.max(time)).first()
        rows, there = batch, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        if there and lo is None:
            return
        if there:
            held = spark.read.parquet(path).where(F.col(time).between(F.lit(lo), F.lit(hi)))
            rows = batch.join(held.select(*key), key, "left_anti")
        rows.write.mode("append").parquet(path)
    finally:
        batch.unpersist()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, key: list[str], time: str) -> None:
    """Runs a stream over what is there (availableNow) into an idempotent table."""
    q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_new(df, path, key, time)).start()
    q.awaitTermination()


def latest_stream(rows: DataFrame, key: list[str], time: str, order: str, late: str = "2 hours", keep_minutes: int = 24 * 60) -> DataFrame:
    """Revisions as they come: a row goes on if its ``order`` (an integer) is above all earlier ones of its key and span; duplicates and older revisions go.

    A span is ``keep_minutes`` of event time. State is one row a key and span, in Spark's own aggregation: no key is a call of Python. It leaves when the watermark, ``late``
    and a span behind the end of the last span, has passed the span's end, so it is bounded by the keys of ``late`` and three spans; only rows more than ``late`` behind are
    ever dropped. A key's last row of a new span goes on whatever earlier spans held: ``latest_rows`` picks among spans. Rows without a time are a span that stays.
    For ``outputMode("update")``.
    """
    ms = F.unix_millis(F.col(time).cast("timestamp"))
    keep = F.lit(keep_minutes * 60_000)
    until = F.timestamp_millis(ms - F.pmod(ms, keep) + keep)
    at = F.current_timestamp()  # a batch's own time, the same when it is replayed
    spans = rows.where(F.col(order).isNotNull()).withColumns({"_until": until, "_at": at}).withWatermark("_until", f"{late} {keep_minutes} minutes")
    first = F.struct(F.col(order), -F.unix_micros("_at"))  # of equals the earliest batch's
    best = spans.groupBy(*key, "_until").agg(F.max_by(F.struct(*rows.columns, "_at"), first).alias("_row"))
    return best.where(F.col("_row._at") == at).select(*[F.col(f"_row.`{c}`") for c in rows.columns])


FILES_A_DATE = 8  # of a batch, at most


def run_to_revisions(stream: DataFrame, path: str, checkpoint: str, time: str) -> dict:
    """Runs a stream of revisions over what is there (availableNow): each batch writes its own files of the dates that it touches, and a replay overwrites them.

    Revisions are dealt out by date into ``FILES_A_DATE`` groups first: else every partition of the state writes a file a date. Returns the last progress, which has the number of rows in state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumns({"_date": F.to_date(time), "_batch": F.lit(batch_id), "_group": F.spark_partition_id() % FILES_A_DATE}).repartition("_date", "_group").drop("_group")
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_date", "_batch").parquet(path)

    q = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return q.lastProgress or {}


def latest_rows(spark: SparkSession, path: str, key: list[str], order: str, dates: list[str] | None = None) -> DataFrame:
    """The last revision of each key of a table that ``run_to_revisions`` wrote; of some ``dates`` only, if a key's date never changes. Combined before the shuffle."""
    df = spark.read.parquet(path)
    df = df.where(F.col("_date").cast("string").isin(dates)) if dates is not None else df
    names = [c for c in df.columns if c not in ("_date", "_batch")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("_row")).select("_row.*")


QUOTE = "event_id bigint, symbol string, ts timestamp, bid double, ask double, bid_size double, ask_size double"


def quotes_stream(quotes: DataFrame, width: str = "1 minute", late: str = "2 hours") -> DataFrame:
    """The last quote of each symbol and window, in append mode, quotes deduplicated by id within the watermark."""
    q = quotes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    g = q.groupBy("symbol", F.window("ts", width)).agg(F.max_by(F.struct("bid", "ask", "bid_size", "ask_size"), F.struct("ts", "event_id")).alias("q"), F.count("*").alias("n"))
    return g.select("symbol", F.col("window.start").alias("ts"), "q.*", "n")


BAR = "symbol string, instrument bigint, day date, bar_id bigint, ts_open timestamp, ts_close timestamp, open double, high double, low double, close double, volume double, vwap double, n bigint"
_STATE = "bar_id bigint, total double, ts_open timestamp, ts_close timestamp, open double, high double, low double, close double, volume double, notional double, n bigint"


def dollar_bars_stream(ticks: DataFrame, threshold: float) -> DataFrame:
    """Completed dollar bars of each (symbol, instrument, day), one running bar of state a key. Ticks must arrive in order within a key."""
    ship(ticks.sparkSession)
    keyed = ticks.withColumn("day", F.to_date("ts"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bar = list(state.get) if state.exists else None
        bar_id = bar[0] if bar else 0
        cur = bar[1:] if bar and bar[10] else None
        done = []
        for t in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples():
            x = t.price * t.size
            if cur is None:
                cur = [0.0, t.ts, t.ts, t.price, t.price, t.price, t.price, 0.0, 0.0, 0]
            cur = [cur[0] + x, cur[1], t.ts, cur[3], max(cur[4], t.price), min(cur[5], t.price), t.price, cur[7] + t.size, cur[8] + x, cur[9] + 1]
            if cur[0] >= threshold:
                done.append((*key, bar_id, cur[1], cur[2], cur[3], cur[4], cur[5], cur[6], cur[7], cur[8] / cur[7], cur[9]))
                bar_id, cur = bar_id + 1, None
        stamp = pd.Timestamp(0)
        state.update((bar_id, *(cur or [0.0, stamp, stamp, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0])))
        names = [f.split(" ")[0] for f in BAR.split(", ")]
        yield pd.DataFrame(done, columns=names)

    return keyed.groupBy("symbol", "instrument", "day").applyInPandasWithState(step, BAR, _STATE, "append", "NoTimeout")


def sentinel(ticks: DataFrame, hours: int = 24) -> DataFrame:
    """A late tick after all others, which lets the last windows of a finite stream close."""
    last = ticks.agg(F.max("ts").alias("ts"))
    return last.select(F.lit(-1).cast("bigint").alias("event_id"), F.lit("~end").alias("symbol"), (F.col("ts") + F.expr(f"interval {hours} hours")).alias("ts"), F.lit(0.0).alias("price"), F.lit(1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("instrument"), F.lit(0).cast("bigint").alias("user_id"))


__all__ = ["QUOTE", "TICK", "append_new", "bars_stream", "dollar_bars_stream", "latest_rows", "latest_stream", "quotes_stream", "read_events", "replay", "run_to_revisions", "run_to_table", "sentinel", "time_bars"]
