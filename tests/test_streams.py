"""Streams of revisions: late rows replace, duplicates and replays change nothing, state leaves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs as J

T0 = dt.datetime(2024, 3, 1)


def rows(*xs):
    return [(k, T0 + dt.timedelta(minutes=m), o, float(v)) for k, m, o, v in xs]


SCHEMA = "k string, ts timestamp, o long, v double"


@pytest.mark.parametrize("restart", [True, False])
def test_latest_rows_after_restarts_and_replays(spark, tmp_path, restart):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    parts = [
        rows(("a", 0, 1, 1), ("a", 0, 1, 1), ("b", 5, 1, 10), ("c", 9, 4, 7)),
        rows(("a", 3, 3, 3), ("b", 6, 1, 10), ("d", 20, None, 5), ("c", 9, 2, 6)),  # a revision, a duplicate, no order, an older revision
        rows(("a", 1, 2, 2), ("b", 2, 9, 90)),  # late: an older and a newer revision
    ]
    progress = []
    for p in parts:
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if restart:
            stream = J.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema)
            progress.append(J.run_to_revisions(J.latest_stream(stream, ["k"], "ts", "o", late="1 hour"), out, check, "ts"))
    stream = lambda: J.latest_stream(J.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema, 1), ["k"], "ts", "o", late="1 hour")
    progress.append(J.run_to_revisions(stream(), out, check, "ts"))  # nothing new, or all of it
    wanted = {"a": (3, 3.0), "b": (9, 90.0), "c": (4, 7.0)}
    read = lambda path: {r["k"]: (r["o"], r["v"]) for r in J.latest_rows(spark, path, ["k"], "o").collect()}
    assert read(out) == wanted
    assert {r["k"] for r in J.latest_rows(spark, out, ["k"], "o", ["2024-03-01"]).collect()} == set(wanted)
    written = spark.read.parquet(out).count()
    assert written <= 6  # what changes nothing is not written
    again = f"file://{tmp_path}/again"
    J.run_to_revisions(stream(), again, f"{check}-again", "ts")  # a replay from nothing
    assert read(again) == wanted


def test_state_leaves_with_the_watermark(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    states = []
    for day in range(6):
        part = [(f"k{day}x{i}", T0 + dt.timedelta(days=day, minutes=i), 1, 0.0) for i in range(20)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = J.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema)
        p = J.run_to_revisions(J.latest_stream(stream, ["k"], "ts", "o", late="1 hour", keep_minutes=120), out, check, "ts")
        states.append(sum(s["numRowsTotal"] for s in p.get("stateOperators", [])))
    assert J.latest_rows(spark, out, ["k"], "o").count() == 120
    assert max(states) <= 40 and states[-1] <= 40  # two days of keys, never all of them


def test_keys_are_not_calls_of_python(spark, tmp_path):
    """State is Spark's own aggregation: 30,000 keys took a call of Python each, at about 10 ms."""
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    spark.sql("select string(id % 30000) as k, timestamp_seconds(1709251200 + id) as ts, id as o, double(id) as v from range(90000)").write.parquet(src)
    p = J.run_to_revisions(J.latest_stream(J.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema), ["k"], "ts", "o", late="1 day"), out, check, "ts")
    assert [s["operatorName"] for s in p["stateOperators"]] == ["stateStoreSave"]
    got = J.latest_rows(spark, out, ["k"], "o")
    assert got.count() == 30_000 and got.where("o <> 60000 + bigint(k) or v <> o").count() == 0


def test_files_of_a_date_are_few(spark, tmp_path):
    """Partitions of the state don't write a file a date each."""
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    spark.sql("select string(id) as k, timestamp_seconds(1709251200 + id * 60) as ts, id as o, double(id) as v from range(5000)").write.parquet(src)
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "24")
    J.run_to_revisions(J.latest_stream(J.read_events(session, src, spark.createDataFrame([], SCHEMA).schema), ["k"], "ts", "o", late="9 days"), out, check, "ts")
    files = spark.read.parquet(out).groupBy("_date").agg(F.countDistinct("_metadata.file_path").alias("files"), F.count("*").alias("n")).collect()
    assert sum(f["n"] for f in files) == 5000 and max(f["files"] for f in files) <= J.FILES_A_DATE


def test_spans_equals_and_rows_without_time(spark, tmp_path):
    """An older revision in a new span replaces nothing, the first of equals stays, and rows without a time count, late ones of open spans too."""
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    none = lambda k, o, v: (k, None, o, float(v))
    parts = [
        rows(("a", 0, 5, 5), ("b", 1, 1, 1), ("c", 2, 1, 1)) + [none("n", 1, 1), none("a", 2, 2)],
        rows(("a", 600, 3, 3), ("b", 600, 2, 2), ("c", 2, 1, 99)),  # spans of two hours: a new one; an equal
        rows(("d", 595, 1, 1), ("c", 3000, 4, 4)) + [none("n", 3, 3), none("m", 1, 1)],
        rows(("e", 2960, 1, 1)) + [none("n", 2, 2)],
    ]
    stream = lambda: J.latest_stream(J.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema), ["k"], "ts", "o", late="1 hour", keep_minutes=120)
    for p in parts:
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        J.run_to_revisions(stream(), out, check, "ts")
    got = {r["k"]: (r["o"], r["v"]) for r in J.latest_rows(spark, out, ["k"], "o").collect()}
    assert got == {"a": (5, 5.0), "b": (2, 2.0), "c": (4, 4.0), "d": (1, 1.0), "e": (1, 1.0), "m": (1, 1.0), "n": (3, 3.0)}
    assert spark.read.parquet(out).where("v = 99 or (k = 'n' and o = 2)").count() == 0  # what changes nothing is not written


@pytest.mark.parametrize("name", ["stream_bars", "stream_quotes", "stream_latest", "stream_dollar_bars"])
def test_replay_in_many_lots(spark, monkeypatch, name):
    """Bounded files in order of time give what one file gives: nothing is late, open bars go on from lot to lot."""
    import __spark_entry__ as E

    lots, replay = [], J.replay

    def small(rows, folder, order, run, files_a_run):
        def counted():
            lots.append(max(f["n"] for f in spark.read.parquet(folder).groupBy("_metadata.file_path").count().withColumnRenamed("count", "n").collect()))
            run()

        replay(rows, folder, order, counted, rows_a_file=1000, files_a_run=4)

    rows = lambda: sorted(map(str, E.queries()[name](spark, "/root/testdata/sf0.01").collect()))
    once = rows()
    monkeypatch.setattr(J, "replay", small)
    assert rows() == once
    assert len(lots) >= 3 and max(lots) < 2000
