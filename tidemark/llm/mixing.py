"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document stands in its source's shuffled queue (by MD5 of its id) and is served up to ``max_repeats`` times, pass after pass.
A copy's virtual finish time is the words its source has served with it, divided by the source's target. All copies are ordered by
finish time, and the mix is the head of that order that the total budget allows.

No running sum meets a whole source or the whole corpus in one task: a source's queue is cut into hash buckets of bounded size, whose
sums are added up first, in two levels; the cut through the global order is found in a histogram of finish times, refined while its
bucket is large, and settled in the last one. Rows alike in doc_id, source and size are entries of their own, spread over the queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions

BUCKET_ROWS = 1024
CELLS = 10_000
CHUNK = 1 << 16
MAX_BROADCAST_SOURCES = 10_000
MAX_CUT_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """``source, source_size, source_docs, place, target`` from a row a source.

    Water filling in closed form: with sources by cap / weight, the first k are at their caps, k being the first for which the level
    of the rest, (budget - caps) / weights, does not pass the next cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1).alias("place")
    s = sources.select("*", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.expr("cap / cast(weight as double)"), "place")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(share)
    s = s.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest).cast("double"))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("water", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    fill = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", "source_docs", "place", fill.alias("target"))


def _words() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _keys() -> list[Column]:
    return [F.col("doc_id").alias("m_doc"), F.col("source").alias("m_source"), _words().alias("m_size")]


def _entries(docs: DataFrame, work: Workspace) -> DataFrame:
    """``m_doc, m_source, m_size, rows, r``: an entry for each row; rows alike in the first three are numbered by ``r``."""
    alike = work.table(docs.select(*_keys()).groupBy("m_doc", "m_source", "m_size").agg(F.count("*").alias("rows")), "alike")
    chunks = lambda d: d.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))))
    dealt = chunks(alike.where(F.col("rows") <= CHUNK))
    large = alike.where(F.col("rows") > CHUNK)
    if not large.isEmpty():
        dealt = dealt.unionByName(chunks(large).repartition(partitions(docs.sparkSession), "m_doc", "m_source", "m_size", "chunk"))
    r = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("rows"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("r")
    return dealt.select("m_doc", "m_source", "m_size", "rows", r)


def schedule(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """``doc_id, source, size, rows, r, source_size, target, copies``: how often the mix takes each row.

    Size is the number of words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0). Sources stand by code point, null last, with ``weights``
    repeating; together they are due ``share`` of all words, each ``max_repeats`` times its own at most. Rows alike in doc_id, source and
    size (``rows`` of them, numbered ``r`` from 0) are queued apart; which of them is which does not matter. Sources without words get a
    target of 0; documents without words cost nothing; null doc_ids are one id; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    name = F.coalesce(F.col("m_doc").cast("string"), F.lit("null"))
    key = F.md5(F.when(F.col("r") == 0, name).otherwise(F.concat_ws("#", name, "r")).cast("binary"))
    sized = work.table(_entries(docs, work).withColumn("m_key", key), "sizes")
    due = work.table(targets(sized.groupBy(F.col("m_source").alias("source")).agg(F.sum("m_size").alias("source_size"), F.count("*").alias("source_docs")), weights, share, max_repeats), "targets")
    n_sources, n_docs, budget, largest = due.agg(F.count("*"), F.sum("source_docs"), F.sum("source_size") * F.lit(share), F.max("source_docs")).first()
    per_source = F.broadcast(due) if n_sources <= MAX_BROADCAST_SOURCES else due
    per_source = per_source.select(F.col("source").alias("t_source"), "source_size", "place", "target")
    digits = 0
    while (largest or 0) > BUCKET_ROWS * 16**digits:
        digits += 1
    queue = sized.join(per_source, F.col("m_source").eqNullSafe(F.col("t_source"))).withColumn("bucket", F.substring("m_key", 1, digits))
    sums = work.table(queue.groupBy("place", F.substring("bucket", 1, digits // 2).alias("top"), "bucket").agg(F.sum("m_size").alias("bucket_size")), "buckets")
    before = lambda w: F.coalesce(F.sum("bucket_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sums.groupBy("place", "top").agg(F.sum("bucket_size").alias("bucket_size")).select("place", "top", before(Window.partitionBy("place").orderBy("top")).alias("above"))
    base = sums.join(tops, ["place", "top"]).select("place", "bucket", (F.col("above") + before(Window.partitionBy("place", "top").orderBy("bucket"))).alias("base"))
    inside = Window.partitionBy("place", "bucket").orderBy("m_key", "m_doc", "m_size", "r").rowsBetween(Window.unboundedPreceding, 0)
    queue = queue.withColumn("served", F.sum("m_size").over(inside)).join(base, ["place", "bucket"])
    queue = work.table(queue.select("m_doc", "m_source", "m_size", "rows", "r", "m_key", "place", "source_size", "target", (F.col("base") + F.col("served")).alias("served")), "queue")

    def finish(copy: int) -> Column:
        return (F.col("served") + F.col("source_size") * copy) / F.when(F.col("target") > 0, F.col("target"))

    def turn(copy: int) -> Column:
        """The place of a copy in the global order."""
        return F.struct(finish(copy).alias("finish"), F.col("place").alias("place"), F.lit(copy).alias("copy"), F.col("m_key").alias("key"), F.col("m_doc").alias("doc"), F.col("m_size").alias("words"), F.col("r").alias("r"))

    copies = queue.select(F.explode(F.array(*map(turn, range(max_repeats)))).alias("t")).select("t", "t.words").where("t.finish is not null")
    # the cut: the cell of finish times where the budget ends, then cells of that cell, until few copies are left
    place, served, cells, cut_cells, left = F.col("t.finish"), 0, max(1, min(CELLS, (n_docs or 0) // BUCKET_ROWS)), [], copies
    while True:
        running = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cell = F.floor(place * cells)
        histogram = left.groupBy(cell.alias("cell")).agg(F.sum("words").alias("w"), F.count("*").alias("n")).withColumn("upto", F.sum("w").over(running) + F.lit(served))  # at most ``CELLS`` times the largest finish time
        full = histogram.where(F.col("upto") > F.lit(budget)).orderBy("cell").select("cell", F.col("upto") - F.col("w"), "n").first()
        if full is None:
            break
        cut_cells.append((cells, full[0]))
        left, place, served = left.where(cell == full[0]), place * cells - full[0], full[1]
        if full[2] <= MAX_CUT_ROWS or len(cut_cells) == 3:
            break
        cells = CELLS
    if not cut_cells:  # the budget takes everything
        taken = F.lit(max_repeats)
    else:
        order = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        last = left.withColumn("upto", F.sum("words").over(order) + served).where(F.col("upto") <= F.lit(budget)).agg(F.max("t")).first()[0]
        taken = F.lit(0)
        for c in range(max_repeats):
            at, inside_cut, level = finish(c), F.lit(False), F.lit(True)
            for n, full_cell in cut_cells:
                inside_cut = inside_cut | (level & (F.floor(at * n) < full_cell))
                level, at = level & (F.floor(at * n) == full_cell), at * n - full_cell
            if last is not None:
                cut = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in copies.schema["t"].dataType.fields])
                inside_cut = inside_cut | (turn(c) <= cut)
            taken = taken + F.when(inside_cut, 1).otherwise(0)
    return queue.select(F.col("m_doc").alias("doc_id"), F.col("m_source").alias("source"), F.col("m_size").alias("size"), "rows", "r", "source_size", "target", taken.alias("copies"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: a row for each row of ``docs``; taken counts words, repeats included. Cases as in ``schedule``."""
    return schedule(docs, weights, share, max_repeats).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns whatever their names, each as often as it is taken (not at all, up to ``max_repeats`` times).

    Cases as in ``schedule``. Rows are carried whole in a struct, so no column of theirs can clash. If some rows are alike in doc_id, source
    and size, the table is written once, so that they can be numbered: within each of its partitions, then over partitions.
    """
    found = schedule(docs, weights, share, max_repeats)
    alike = found.where("rows > 1 and r = 0").select(*(F.col(x).alias(f"a_{x}") for x in ("doc_id", "source", "size")))
    same = F.col("m_doc").eqNullSafe(F.col("a_doc_id")) & F.col("m_source").eqNullSafe(F.col("a_source")) & (F.col("m_size") == F.col("a_size"))
    if alike.isEmpty():
        rows = docs.select(*_keys(), F.lit(0).cast("long").alias("m_r"), F.struct("*").alias("body"))
    else:
        docs = Workspace(docs.sparkSession, "mixing").table(docs, "documents")
        keyed = docs.select(*_keys(), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
        keyed = keyed.join(alike, same, "left_semi")
        names = ["m_doc", "m_source", "m_size"]
        base = keyed.groupBy(*names, "part").count().withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        base = base.select(*(F.col(x).alias(f"b_{x}") for x in names), F.col("part").alias("b_part"), "base")
        to_base = (F.col("part") == F.col("b_part")) & F.col("m_doc").eqNullSafe(F.col("b_m_doc")) & F.col("m_source").eqNullSafe(F.col("b_m_source")) & (F.col("m_size") == F.col("b_m_size"))
        own = F.row_number().over(Window.partitionBy(*names, "part").orderBy("at")) - 1
        numbers = keyed.withColumn("own", own).join(base, to_base).select(F.col("at").alias("n_at"), (F.col("own") + F.col("base")).alias("n_r"))
        rows = docs.select(*_keys(), F.monotonically_increasing_id().alias("at"), F.struct("*").alias("body")).join(numbers, F.col("at") == F.col("n_at"), "left")
        rows = rows.select("m_doc", "m_source", "m_size", F.coalesce("n_r", F.lit(0)).cast("long").alias("m_r"), "body")
    found = found.where("copies > 0").select(*(F.col(x).alias(f"f_{x}") for x in ("doc_id", "source", "size", "r", "copies")))
    met = F.col("m_doc").eqNullSafe(F.col("f_doc_id")) & F.col("m_source").eqNullSafe(F.col("f_source")) & (F.col("m_size") == F.col("f_size")) & (F.col("m_r") == F.col("f_r"))
    return rows.join(found, met).select("body", F.explode(F.sequence(F.lit(1), F.col("f_copies")))).select("body.*")
