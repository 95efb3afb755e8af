"""Path-dependent labels: grid events, triple barriers, uniqueness weights, directional targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import us
from ..plans.shipping import shared_folder, written
from .asof import asof_join
from .windows import running_sum


def grid_events(df: DataFrame, step: int, start: int, pos: str = "pos") -> DataFrame:
    """Every ``step``-th row from position ``start`` on."""
    return df.where((F.col(pos) >= start) & ((F.col(pos) - start) % step == 0))


def triple_barrier(bars: DataFrame, events: DataFrame, horizon: int, up: float = 1.5, down: float = 1.5, timeout_label: int = 0, keys: tuple[str, ...] = ("symbol",), roll_close: str | None = None, degraded: str | None = None) -> DataFrame:
    """First touch of +up*sigma or -down*sigma of log return within ``horizon`` bars, else the vertical barrier.

    ``bars(keys, pos, ts, close)``; ``events(keys, pos, sigma)``. Ties of one bar go to the upper barrier; events whose horizon runs past the last
    bar without a touch are dropped. The path join is an equi-join on cells of ``horizon`` positions (a path touches two), so pairs are
    horizon rows an event. ``roll_close`` names a segment column: the path ends with the last bar of the event's segment.
    ``degraded`` names a flag that a label takes over if any bar of its span has it.
    """
    k = list(keys)
    extra = [c for c in (roll_close, degraded) if c]
    p = bars.select(*k, F.col("pos").alias("p"), F.col("ts").alias("p_ts"), F.col("close").alias("p_close"), *[F.col(c).alias(f"p_{c}") for c in extra], F.floor(F.col("pos") / horizon).alias("_c"))
    e = events.select(*k, F.col("pos").alias("e"), "ts", "close", "sigma", *extra).where("sigma > 0")
    e = e.withColumn("_c", F.explode(F.array(F.floor(F.col("e") / horizon), F.floor(F.col("e") / horizon) + 1)))
    path = e.join(p, [*k, "_c"]).where((F.col("p") > F.col("e")) & (F.col("p") <= F.col("e") + horizon))
    if roll_close:
        path = path.where(F.col(roll_close) == F.col(f"p_{roll_close}"))
    path = path.withColumn("r", F.ln(F.col("p_close") / F.col("close")))
    hit = F.when(F.col("r") >= up * F.col("sigma"), 1).when(F.col("r") <= -down * F.col("sigma"), -1)
    at = F.struct("p", "p_ts", "r", hit.alias("side"))
    g = path.groupBy(*k, "e", "ts", "sigma").agg(F.min(F.when(hit.isNotNull(), at)).alias("touch"), F.max(at).alias("last"))
    size = F.col("last.p") - F.col("e")
    whole = (size == horizon) if not roll_close else F.lit(True)
    g = g.where(F.col("touch").isNotNull() | whole).withColumn("end", F.coalesce("touch", "last"))
    barrier = F.when(F.col("touch").isNull(), "vertical").when(F.col("touch.side") == 1, "upper").otherwise("lower")
    out = g.select(*k, F.col("e").alias("pos0"), F.col("end.p").alias("pos1"), F.col("ts").alias("t0"), F.col("end.p_ts").alias("t1"), F.col("end.r").alias("ret"), F.coalesce("touch.side", F.lit(timeout_label)).alias("label"), barrier.alias("barrier"), "sigma", (F.col("end.p") - F.col("e")).alias("n_bars"))
    if degraded:
        spans = out.select(*k, "pos0", "pos1").withColumn("_c", F.explode(F.sequence(F.floor(F.col("pos0") / horizon), F.floor(F.col("pos1") / horizon))))
        bad = spans.join(p.where(F.col(f"p_{degraded}")), [*k, "_c"]).where("p between pos0 and pos1").select(*k, "pos0").distinct().withColumn("_bad", F.lit(True))
        out = out.join(bad, [*k, "pos0"], "left").withColumn("degraded", F.coalesce("_bad", F.lit(False))).drop("_bad")
    return out


def session_barrier(bars: DataFrame, events: DataFrame, minutes: int = 30, up: float = 1.5, down: float = 1.5, sign_timeouts: bool = False, keys: tuple[str, ...] = ("symbol", "session_date"), close_at: str | None = None) -> DataFrame:
    """Barriers inside a session block with a wall-clock vertical: the first bar at or after t0 + minutes, or the block's last bar where none is.

    ``bars(keys, ts, close)``; ``events(keys, ts, close, sigma)``; ``close_at`` names a column of events with the session's close (by default the
    block's last bar): events in the last ``minutes`` before it are left out. Ties of one bar go to the upper barrier; timeouts are 0 or the sign
    of their return. Bars before the vertical meet events in cells ``minutes`` long (a path touches two); the vertical bar comes by an as-of join.
    """
    k, width = list(keys), minutes * 60_000_000
    place = F.row_number().over(Window.partitionBy(*k).orderBy("ts"))
    b = bars.select(*k, "ts", "close").withColumn("_p", place)
    last = b.groupBy(*k).agg(F.max(F.struct("ts", "close", "_p")).alias("_last"))
    e = events.select(*k, "ts", "close", "sigma", *([F.col(close_at).alias("_close_at")] if close_at else [])).where("sigma > 0").join(last, k)
    e = e.join(b.select(*k, "ts", F.col("_p").alias("_e")), [*k, "ts"])
    e = e.where(us("ts") + width <= us("_close_at" if close_at else "_last.ts")).withColumn("_due", F.timestamp_micros(us("ts") + width))
    e = asof_join(e, b.select(*k, "ts", F.struct("ts", "close", "_p").alias("bar")), on="_due", right_on="ts", by=k, take=["bar"], forward=True, prefix="_v_")
    e = e.withColumns({"_end": F.coalesce("_v_bar", "_last"), "_capped": F.col("_v_bar").isNull()}).where("_end._p > _e")
    cells = e.withColumn("_c", F.explode(F.array(F.floor(us("ts") / width), F.floor(us("ts") / width) + 1)))
    bar = b.select(*k, F.struct("ts", "close", "_p").alias("_bar"), F.floor(us("ts") / width).alias("_c"))
    path = cells.join(bar, [*k, "_c"]).where("_bar._p > _e and _bar._p < _end._p").drop("_c").unionByName(e.withColumn("_bar", F.col("_end")))
    r = F.ln(F.col("_bar.close") / F.col("close"))
    side = F.when(r >= up * F.col("sigma"), 1).when(r <= -down * F.col("sigma"), -1)
    path = path.withColumn("_at", F.struct(F.col("_bar._p").alias("p"), F.col("_bar.ts").alias("ts"), r.alias("r"), side.alias("side")))
    g = path.groupBy(*k, "ts", "sigma", "_e", "_capped").agg(F.min(F.when(F.col("_at.side").isNotNull(), F.col("_at"))).alias("touch"), F.max("_at").alias("last"))
    end, none = F.coalesce("touch", "last"), F.col("touch").isNull()
    timeout = F.signum("last.r").cast("int") if sign_timeouts else F.lit(0)
    barrier = F.when(none & F.col("_capped"), "close").when(none, "vertical").when(F.col("touch.side") == 1, "upper").otherwise("lower")
    return g.select(*k, F.col("ts").alias("t0"), end["ts"].alias("t1"), end["r"].alias("ret"), F.coalesce("touch.side", timeout).alias("label"), barrier.alias("barrier"), "sigma", (end["p"] - F.col("_e")).alias("n_bars"), (none & F.col("_capped")).alias("resolved_at_close"))


def uniqueness(labels: DataFrame, keys: tuple[str, ...] = ("symbol",), decay_oldest: float = 1.0, block_rows: int = 1 << 16) -> DataFrame:
    """Adds ``avg_uniqueness`` (mean of 1 / concurrency over the span) and ``weight`` (with time decay, mean one by key).

    Concurrency is a running sum of +1 at starts and -1 after ends; its reciprocal's running sum gives each span's mean by two lookups,
    so no label meets the bars of its span. Running sums go over blocks of ``block_rows`` positions, and over the blocks: no task orders a key's whole history.
    """
    k, folder = list(keys), shared_folder(labels.sparkSession, "uniqueness")
    block = lambda x: F.floor(F.col(x) / block_rows)
    # written where several sums follow: each reads the table instead of all that came before
    labels = written(labels, folder, "labels")
    marks = labels.select(*k, F.col("pos0").alias("p"), F.lit(1).alias("d")).unionByName(labels.select(*k, (F.col("pos1") + 1).alias("p"), F.lit(-1).alias("d"))).groupBy(*k, "p").agg(F.sum("d").alias("d"))
    runs = written(running_sum(written(marks, folder, "marks"), k, "p", "d", "c", block("p")).withColumn("_b", block("p")), folder, "runs")
    after = Window.partitionBy(*k).orderBy("_b")  # a row a block
    follow = runs.groupBy(*k, "_b").agg(F.min("p").alias("_first")).select(*k, "_b", F.lead("_first").over(after).alias("_follow"))
    runs = runs.withColumn("_next", F.lead("p").over(Window.partitionBy(*k, "_b").orderBy("p"))).join(follow, [*k, "_b"])
    area = F.when(F.col("c") > 0, (F.coalesce("_next", "_follow", "p") - F.col("p")) / F.col("c")).otherwise(0.0)
    areas = written(runs.select(*k, "p", area.alias("_area")), folder, "areas")
    at = running_sum(areas, k, "p", "_area", "_through", block("p"))
    at = written(at.select(*k, "p", (F.col("_through") - F.col("_area")).alias("upto")), folder, "upto")
    j = labels.join(at.select(*k, F.col("p").alias("pos0"), F.col("upto").alias("_a")), [*k, "pos0"]).withColumn("_e", F.col("pos1") + 1).join(at.select(*k, F.col("p").alias("_e"), F.col("upto").alias("_z")), [*k, "_e"])
    j = written(j.withColumn("avg_uniqueness", (F.col("_z") - F.col("_a")) / (F.col("_e") - F.col("pos0"))).drop("_a", "_z", "_e"), folder, "averages")
    total = j.groupBy(*k).agg(F.sum("avg_uniqueness").alias("_t"))
    j = running_sum(j, k, "pos0", "avg_uniqueness", "_u", block("pos0")).join(total, k)
    j = written(j.withColumn("_w", F.col("avg_uniqueness") * (F.lit(decay_oldest) + (1 - decay_oldest) * F.col("_u") / F.col("_t"))).drop("_u", "_t"), folder, "weights")
    mean = j.groupBy(*k).agg(F.avg("_w").alias("_m"))
    return j.join(mean, k).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")


def direction(df: DataFrame, timeouts: str = "sign_return") -> DataFrame:
    """Adds ``direction``: the label's sign; timeouts take the sign of the return (0 counts as -1) or are dropped."""
    if timeouts == "drop":
        return df.where("label <> 0").withColumn("direction", F.signum("label").cast("int"))
    return df.withColumn("direction", F.when(F.col("label") != 0, F.signum("label")).otherwise(F.when(F.col("ret") > 0, 1).otherwise(-1)).cast("int"))


def meta_label(df: DataFrame, signal: str, ret: str) -> DataFrame:
    """Primary side = sign of the signal (not finite: 0); meta label = does the side's return pay; only where a side is taken."""
    side = F.coalesce(F.when(~F.isnan(F.col(signal).cast("double")), F.signum(signal)), F.lit(0.0)).cast("int")
    return df.withColumn("side", side).withColumn("meta_label", F.when(F.col("side") != 0, (F.col("side") * F.col(ret) > 0).cast("int")))
