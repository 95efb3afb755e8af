"""As-of joins: each left row meets the latest right row at or before it (or the next one after it).

Spark has no as-of join. Both sides are stacked, and the last right row before each left row is carried along a window. The window
does not run over a whole key but over (key, time bucket); what a bucket inherits from earlier ones comes from the right side alone: its last
row a bucket, handed on to the buckets up to the next one that has rows. So a key with a third of all rows is still spread over its buckets,
and the left side is read once, however many as-of joins follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import us

DAY_US = 86_400_000_000


def asof_join(left: DataFrame, right: DataFrame, on: str = "ts", right_on: str | None = None, by: list[str] | None = None, take: list[str] | None = None, forward: bool = False, strict: bool = False, prefix: str = "r_", bucket_us: int = DAY_US) -> DataFrame:
    """All columns of ``left`` and, prefixed, the columns ``take`` of the right row that is as-of it; nulls where there is none.

    Backward: the latest right row with time <= left time (``strict``: <). Forward: the earliest with time >= (``strict``: >). ``by`` columns
    must be equal. Of right rows with one key and time any single one counts: dedupe first. Left rows of null time match nothing.
    """
    by, right_on = by or [], right_on or on
    take = take or [c for c in right.columns if c not in by]
    sign = -1 if forward else 1
    time, first = F.col("_t"), Window.partitionBy(*by, "_b")
    own = left.select(F.struct(*left.columns).alias("_left"), *by, (us(on) * sign).alias("_t"), F.lit(None).cast(right.select(F.struct(*take).alias("s")).schema["s"].dataType).alias("_right"), F.lit(0 if strict else 1).alias("_side"))
    other = right.select(F.lit(None).cast(own.schema["_left"].dataType).alias("_left"), *by, (us(right_on) * sign).alias("_t"), F.struct(*take).alias("_right"), F.lit(1 if strict else 0).alias("_side")).where("_t is not null")
    both = own.unionByName(other).withColumn("_b", F.floor(F.coalesce(time, F.lit(-(2**62))) / bucket_us))
    latest = F.last("_right", ignorenulls=True).over(first.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    within = both.withColumn("_near", latest)
    last = other.withColumn("_b", F.floor(time / bucket_us)).groupBy(*by, "_b").agg(F.max_by("_right", "_t").alias("_right"))
    chain = last.withColumn("_next", F.lead("_b").over(Window.partitionBy(*by).orderBy("_b")))  # a row a bucket
    names = [F.col(c).alias(f"_k_{c}") for c in by]
    handed = chain.where("_next is not null").select(*names, F.explode(F.sequence(F.col("_b") + 1, F.col("_next"))).alias("_kb"), F.col("_right").alias("_carry"))
    final = chain.where("_next is null").select(*[F.col(c).alias(f"_f_{c}") for c in by], F.col("_b").alias("_fb"), F.col("_right").alias("_final"))  # a row a key
    match, after = F.col("_b") == F.col("_kb"), F.col("_b") > F.col("_fb")
    for c in by:
        match, after = match & (F.col(c) == F.col(f"_k_{c}")), after & (F.col(c) == F.col(f"_f_{c}"))
    out = within.where("_left is not null").join(handed, match, "left").join(final if by else F.broadcast(final), after, "left")
    out = out.withColumn("_hit", F.when(F.col("_t").isNotNull(), F.coalesce("_near", "_carry", "_final")))
    return out.select("_left.*", *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in take])


def asof_attach(left: DataFrame, right: DataFrame, key: list[str], on: str, right_on: str, by: list[str], take: list[str], prefix: str = "", bucket_us: int = DAY_US, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``asof_join`` for a wide right side and a left one of few rows with a unique ``key``: the as-of lookup moves times only, and the columns of the
    right rows that were found come by an equality join (their times are broadcast if the left side has at most ``broadcast_rows``, which is counted).

    Of right rows with one key and time one counts.
    """
    narrow = left.select(*dict.fromkeys([*key, *by]), F.col(on).alias("_on"))
    times = asof_join(narrow, right.select(*by, F.col(right_on).alias("_hit")), on="_on", right_on="_hit", by=by, take=["_hit"], prefix="", bucket_us=bucket_us).drop("_on")
    wanted = times.where("_hit is not null").select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_hit").alias("_w")).distinct()
    few = left.count() <= broadcast_rows
    same = F.col("_w") == F.col(right_on).cast("timestamp")
    for k in by:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    found = right.join(F.broadcast(wanted) if few else wanted, same).groupBy(*[f"_k_{k}" for k in by], "_w").agg(F.first(F.struct(*take)).alias("_row"))
    match = F.col("_hit").cast("timestamp") == F.col("_w")
    for k in by:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    picked = times.join(F.broadcast(found) if few else found, match, "left").select(*[F.col(k).alias(f"_i_{k}") for k in key], "_row")
    back = F.lit(True)
    for k in key:
        back = back & F.col(k).eqNullSafe(F.col(f"_i_{k}"))
    return left.join(picked, back, "left").select(*left.columns, *[F.col(f"_row.{c}").alias(f"{prefix}{c}") for c in take])


def fresh_only(df: DataFrame, same: str, columns: list[str]) -> DataFrame:
    """Nulls the columns where the boolean expression ``same`` does not hold; rows stay."""
    return df.withColumns({c: F.when(F.expr(same), F.col(c)) for c in columns})


def window_aggregate(events: DataFrame, targets: DataFrame, width_us: int, aggs: dict, event_time: str = "ts", target_time: str = "ts", target_key: str = "id") -> DataFrame:
    """For each target t, aggregates of the events in (t - width, t]: an equi-join on time cells of that width, then the exact bound.

    A window touches two cells, so a target meets two cells' events, and pairs stay linear in the rows of a window.
    """
    e = events.withColumn("_e", us(event_time)).withColumn("_c", F.floor(F.col("_e") / width_us))
    t = targets.select(F.col(target_key).alias("_key"), us(target_time).alias("_t")).withColumn("_c", F.explode(F.array(F.floor(F.col("_t") / width_us), F.floor(F.col("_t") / width_us) - 1)))
    pairs = t.join(e, "_c").where((F.col("_e") <= F.col("_t")) & (F.col("_e") > F.col("_t") - width_us))
    found = pairs.groupBy("_key").agg(*[a.alias(k) for k, a in aggs.items()])
    return targets.join(found, targets[target_key] == F.col("_key"), "left").drop("_key")


def window_totals(events: DataFrame, targets: DataFrame, widths_us: list[int], sums: dict[str, Column], maxes: dict[str, Column] | None = None, event_time: str = "ts", target_time: str = "ts", by: list[str] | None = None) -> DataFrame:
    """All columns of ``targets`` and, for the i-th width, of the events in (t - width, t] with equal ``by`` columns: ``n_i``, the ``sums`` and ``maxes`` as
    ``<name>_i``.

    Counts and sums are differences of running totals (exact decimals of 18 places, that is sums below 1e20): that up to t, and that before the first event after t - width.
    A maximum is that of a running maximum since the cell of a width began, up to t, and of one to the end of the cell before, from that first event
    on. So it takes one as-of lookup and one more a width, and no event meets a target, however many lie in a window. Nulls are left out; an empty
    window has n 0 and nulls.
    """
    by, maxes, exact = by or [], maxes or {}, "decimal(38,18)"
    e = events.select(*by, us(event_time).alias("_e"), *[c.cast(exact).alias(f"_s_{k}") for k, c in sums.items()], *[c.alias(f"_m_{k}") for k, c in maxes.items()])
    totals, width = ["_n", *(f"_s_{k}" for k in sums)], list(enumerate(widths_us))
    e = e.groupBy(*by, "_e").agg(F.count("*").cast(exact).alias("_n"), *[F.coalesce(F.sum(f"_s_{k}"), F.lit(0)).cast(exact).alias(f"_s_{k}") for k in sums], *[F.max(f"_m_{k}").alias(f"_m_{k}") for k in maxes])
    e = e.withColumns({"_day": F.floor(F.col("_e") / DAY_US)} | {f"_cell{i}": F.floor(F.col("_e") / w) for i, w in width})
    days = e.groupBy(*by, "_day").agg(*[F.sum(t).cast(exact).alias(t) for t in totals])
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    base = days.select(*[F.col(k).alias(f"_b_{k}") for k in by], F.col("_day").alias("_b_day"), *[F.coalesce(F.sum(t).over(before), F.lit(0)).cast(exact).alias(f"_b{t}") for t in totals])
    same = F.col("_day") == F.col("_b_day")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    inside = Window.partitionBy(*by, "_day").orderBy("_e").rowsBetween(Window.unboundedPreceding, 0)
    running = e.withColumns({f"_in{t}": F.sum(t).over(inside) for t in totals}).join(base, same)
    running = running.withColumns({f"_upto{t}": (F.col(f"_in{t}") + F.col(f"_b{t}")).cast(exact) for t in totals})
    for i, _ in width:
        cell = Window.partitionBy(*by, f"_cell{i}")
        for k in maxes:
            ahead, back = (cell.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_e"), F.desc("_e")))
            running = running.withColumns({f"_up{i}_{k}": F.max(f"_m_{k}").over(ahead), f"_down{i}_{k}": F.max(f"_m_{k}").over(back)})
    right = running.withColumns({"_at": F.timestamp_micros("_e")} | {f"_till{t}": (F.col(f"_upto{t}") - F.col(t)).cast(exact) for t in totals})
    out = targets.withColumns({"_t": us(target_time), "_to": F.timestamp_micros(us(target_time))} | {f"_from{i}": F.timestamp_micros(us(target_time) - w) for i, w in width})
    cells = [f"_cell{i}" for i, _ in width]
    out = asof_join(out, right.select(*by, "_at", *cells, *(f"_upto{t}" for t in totals), *(f"_up{i}_{k}" for i, _ in width for k in maxes)), on="_to", right_on="_at", by=by, take=[*cells, *(f"_upto{t}" for t in totals), *(f"_up{i}_{k}" for i, _ in width for k in maxes)], prefix="_a")
    found = {}
    for i, w in width:
        take = [f"_cell{i}", *(f"_till{t}" for t in totals), *(f"_down{i}_{k}" for k in maxes)]
        out = asof_join(out, right.select(*by, "_at", *take), on=f"_from{i}", right_on="_at", by=by, take=take, forward=True, strict=True, prefix=f"_f{i}")
        own = F.floor(F.col("_t") / w)
        since = lambda t: F.when(F.col(f"_f{i}_till_n").isNotNull() & F.col("_a_upto_n").isNotNull(), F.col(f"_a_upto{t}") - F.col(f"_f{i}_till{t}")).otherwise(0)  # noqa: E731, B023
        n = since("_n").cast("long")
        found |= {f"n_{i}": n} | {f"{k}_{i}": F.when(n > 0, since(f"_s_{k}").cast("double")) for k in sums}
        found |= {f"{k}_{i}": F.when(n > 0, F.greatest(F.when(F.col(f"_a_cell{i}") == own, F.col(f"_a_up{i}_{k}")), F.when(F.col(f"_f{i}_cell{i}") == own - 1, F.col(f"_f{i}_down{i}_{k}")))) for k in maxes}
    return out.select(*targets.columns, *[c.alias(k) for k, c in found.items()])
