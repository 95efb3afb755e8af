"""Daily realised variance, HAR predictors and forecasts, loss functions, economic overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, pos_ln, sdiv, us


def daily_variance(bars: DataFrame, day: str, grid_us: int, grids: int, least: int, keys: list[str]) -> DataFrame:
    """Realised variance a day: the mean over ``grids`` shifted grids of summed squared log returns between each grid cell's last closes.

    A day needs ``least`` returns on its first grid. Each bar goes to one cell of each grid; nothing but cells is shuffled twice.
    """
    shifts = F.explode(F.array(*[F.lit(i) for i in range(grids)])).alias("grid")
    b = bars.select(*keys, day, "ts", "close", shifts)
    cell = F.floor((us("ts") - F.col("grid").cast("long") * F.lit(grid_us // grids).cast("long")) / F.lit(grid_us).cast("long"))
    c = b.groupBy(*keys, day, "grid", cell.alias("cell")).agg(F.max_by("close", "ts").alias("close"))
    w = Window.partitionBy(*keys, day, "grid").orderBy("cell")
    r = c.withColumn("r", pos_ln("close") - F.lag(pos_ln("close")).over(w))
    rv = r.groupBy(*keys, day, "grid").agg(F.sum(F.col("r") * F.col("r")).alias("rv"), F.count("r").alias("n"))
    out = rv.groupBy(*keys, day).agg(F.avg("rv").alias("rv"), F.max(F.when(F.col("grid") == 0, F.col("n"))).alias("n_returns"))
    return out.where((F.col("n_returns") >= least) & (F.col("rv") > 0))


def day_return(bars: DataFrame, day: str, keys: list[str]) -> DataFrame:
    """Open-to-close log return a day."""
    g = bars.groupBy(*keys, day).agg(F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("c"))
    return g.select(*keys, day, (pos_ln("c") - pos_ln("o")).alias("day_ret"))


def har_predictors(df: DataFrame, keys: list[str], order: str, rv: str = "rv", lags: tuple[int, ...] = (1, 5, 22)) -> DataFrame:
    """Logs of trailing means up to and with the day, null before enough days."""
    out = {}
    for n in lags:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
        out[f"har_{n}"] = F.when(F.count(rv).over(w) >= n, pos_ln(F.avg(rv).over(w)))
    return df.withColumns(out)


def forward_log_variance(df: DataFrame, keys: list[str], order: str, h: int, rv: str = "rv") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, h)
    return df.withColumn(f"fwd_{h}", F.when(F.count(rv).over(w) == h, pos_ln(F.avg(rv).over(w))))


def regime(df: DataFrame, keys: list[str], order: str, n: int, rv: str = "rv") -> DataFrame:
    """Is the trailing mean above the median of all trailing means up to the day?"""
    w = Window.partitionBy(*keys).orderBy(order)
    frame = w.rowsBetween(1 - n, 0)
    df = df.withColumn("_m", F.when(F.count(rv).over(frame) >= n, F.avg(rv).over(frame)))
    high = F.col("_m") > F.percentile("_m", 0.5).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("regime", F.when(F.col("_m").isNotNull(), F.when(high, "high").otherwise("low"))).drop("_m")


def qlike(log_rv: Column | str, log_forecast: Column | str) -> Column:
    """QLIKE from logs: exp(d) - d - 1 with d clipped to +-30."""
    d = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), col(log_rv) - col(log_forecast)))
    return F.exp(d) - d - 1


def ols(df: DataFrame, y: str, xs: list[str], keys: list[str]) -> DataFrame:
    """Least squares with intercept by key for one to three regressors: moments in one aggregation, coefficients by Cramer's rule."""
    both = [F.col(c).isNotNull() for c in (y, *xs)]
    ok = both[0]
    for b in both[1:]:
        ok = ok & b
    names = [y, *xs]
    sums = {f"s_{a}": F.avg(a) for a in names} | {f"s_{a}_{b}": F.avg(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]}
    m = df.where(ok).groupBy(*keys).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])

    def cov(a: str, b: str) -> Column:
        k = f"s_{a}_{b}" if f"s_{a}_{b}" in sums else f"s_{b}_{a}"
        return F.col(k) - F.col(f"s_{a}") * F.col(f"s_{b}")

    def det(rows: list[list[Column]]) -> Column:
        if len(rows) == 1:
            return rows[0][0]
        total = None
        for j, x in enumerate(rows[0]):
            minor = det([[v for k, v in enumerate(r) if k != j] for r in rows[1:]])
            term = x * minor if j % 2 == 0 else -(x * minor)
            total = term if total is None else total + term
        return total

    matrix = [[cov(a, b) for b in xs] for a in xs]
    out, rest = {}, F.col(f"s_{y}")
    for i, x in enumerate(xs):
        swapped = [[cov(a, y) if j == i else matrix[r][j] for j in range(len(xs))] for r, a in enumerate(xs)]
        out[f"b_{x}"] = sdiv(det(swapped), det(matrix))
        rest = rest - out[f"b_{x}"] * F.col(f"s_{x}")
    return m.select(*keys, "n", rest.alias("b_0"), *[c.alias(k) for k, c in out.items()])


def overlay(df: DataFrame, variance: str, mean: float, gamma: float = 5.0, cap: float = 1.5, floor: float = 0.1, target: float = 0.10, days: int = 252) -> DataFrame:
    """Mean-variance weight mu / (gamma * var) and volatility-target weight, both clipped."""
    mv = F.greatest(F.lit(0.0), F.least(F.lit(cap), sdiv(F.lit(mean), F.lit(gamma) * F.col(variance))))
    vt = F.greatest(F.lit(floor), F.least(F.lit(cap), sdiv(F.lit(target), F.sqrt(F.col(variance) * days))))
    return df.withColumns({"w_mv": mv, "w_vt": vt})


def net_returns(df: DataFrame, keys: list[str], order: str, weight: str, ret: str, cost: float, stress: float = 1.0) -> DataFrame:
    """Return of the held weight less the cost of its change; quadratic utility beside it."""
    w = Window.partitionBy(*keys).orderBy(order)
    turn = F.abs(F.col(weight) - F.coalesce(F.lag(weight).over(w), F.lit(0.0)))
    return df.withColumns({"turnover": turn, "net_ret": F.col(weight) * F.col(ret) - turn * cost * stress})


def moments(df: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """n, Sharpe (sample deviation), skew and raw kurtosis (population moments)."""
    m = df.where(F.col(ret).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(ret).alias("m1"), F.avg(F.pow(ret, F.lit(2))).alias("m2"), F.avg(F.pow(ret, F.lit(3))).alias("m3"), F.avg(F.pow(ret, F.lit(4))).alias("m4"))
    var = F.col("m2") - F.col("m1") * F.col("m1")
    c3 = F.col("m3") - 3 * F.col("m1") * F.col("m2") + 2 * F.pow("m1", F.lit(3))
    c4 = F.col("m4") - 4 * F.col("m1") * F.col("m3") + 6 * F.pow("m1", F.lit(2)) * F.col("m2") - 3 * F.pow("m1", F.lit(4))
    sd = F.sqrt(F.greatest(var, F.lit(0.0)) * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0)))
    return m.select(*keys, "n", sdiv("m1", sd).alias("sharpe"), sdiv(c3, F.pow(var, F.lit(1.5))).alias("skew"), sdiv(c4, var * var).alias("kurt"))
