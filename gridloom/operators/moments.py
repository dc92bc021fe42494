"""Second moments as the sufficient statistics of everything after cleaning.

A session's moments are sums; a window's are sums of sessions'.  Minutes are scanned once, whatever
the number of windows, and covariances, regressions and principal components start from these sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(panel: DataFrame, rows: list[str], members: list[str], value: str) -> DataFrame:
    """One row with all members' values, complete rows only; the member list is the matrix order."""
    w = panel.groupBy(*rows).pivot("symbol", members).agg(F.first(value, True))
    return w.dropna(subset=members)


def gram(complete: DataFrame, by: list[str], members: list[str]) -> DataFrame:
    """n, s (sums) and g (cross products, row by row) of complete rows by group."""
    p = len(members)
    sums = [F.sum(m).alias(f"s{i}") for i, m in enumerate(members)]
    cross = [F.sum(F.col(members[i]) * F.col(members[j])).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    agg = complete.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *cross)
    g = F.array(*(F.array(*(F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(p))) for i in range(p)))
    return agg.select(*by, "n", F.array(*(F.col(f"s{i}") for i in range(p))).alias("s"), g.alias("g"))


def covariance(moments: DataFrame, members: list[str], by: list[str] = ()) -> DataFrame:
    """Tidy covariance and correlation, ddof 1, from moments."""
    a, b = F.col("i"), F.col("j")
    names = F.array(*map(F.lit, members))
    index = F.sequence(F.lit(0), F.lit(len(members) - 1))
    cells = moments.withColumn("i", F.explode(index)).withColumn("j", F.explode(index))
    cov = lambda x, y: (F.col("g")[x][y] - F.col("s")[x] * F.col("s")[y] / F.col("n")) / (F.col("n") - 1)
    return cells.filter("n > 1").select(*by, names[a].alias("row"), names[b].alias("col"), "n", F.round(cov(a, b), 8).alias("cov"), F.round(cov(a, b) / F.sqrt(cov(a, a) * cov(b, b)), 8).alias("corr"))


def betas(complete: DataFrame, stocks: list[str], benchmarks: list[str]) -> DataFrame:
    """alpha and both betas of every stock on two benchmarks jointly, in closed form from one aggregate."""
    x1, x2 = benchmarks
    tidy = complete.select(x1, x2, F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), F.col(s).alias("y")) for s in stocks))).alias("t")).select(F.col(x1).alias("x1"), F.col(x2).alias("x2"), "t.symbol", "t.y")
    v = lambda a, b: F.covar_samp(a, b)
    g = tidy.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), v("x1", "x1").alias("v11"), v("x2", "x2").alias("v22"), v("x1", "x2").alias("v12"), v("x1", "y").alias("c1"), v("x2", "y").alias("c2"), v("y", "y").alias("vy"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"), F.avg("y").alias("my"))
    det = F.col("v11") * F.col("v22") - F.col("v12") * F.col("v12")
    b1, b2 = (F.col("c1") * F.col("v22") - F.col("c2") * F.col("v12")) / det, (F.col("c2") * F.col("v11") - F.col("c1") * F.col("v12")) / det
    fit = g.filter(det > 0).withColumn("beta1", b1).withColumn("beta2", b2).withColumn("alpha", F.col("my") - b1 * F.col("m1") - b2 * F.col("m2"))
    explained = (F.col("beta1") * F.col("c1") + F.col("beta2") * F.col("c2")) / F.col("vy")
    return fit.withColumn("r2", explained)


def residuals(complete: DataFrame, fits: DataFrame, stocks: list[str], benchmarks: list[str], rows: list[str]) -> DataFrame:
    """Residuals of frozen betas; they are a row a stock and are broadcast."""
    x1, x2 = benchmarks
    tidy = complete.select(*rows, F.col(x1).alias("x1"), F.col(x2).alias("x2"), F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), F.col(s).alias("y")) for s in stocks))).alias("t")).select(*rows, "x1", "x2", "t.symbol", "t.y")
    e = F.col("y") - F.col("alpha") - F.col("beta1") * F.col("x1") - F.col("beta2") * F.col("x2")
    return tidy.join(F.broadcast(fits.select("symbol", "alpha", "beta1", "beta2")), "symbol").select(*rows, "symbol", "y", "x1", "x2", e.alias("residual"))


def residual_diagnostics(rows: DataFrame) -> DataFrame:
    """Raw and residual deviation, residual mean, correlation with the benchmarks, share removed."""
    g = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("raw"), F.stddev_samp("residual").alias("rest"), F.avg("residual").alias("mean"), F.corr("residual", "x1").alias("c1"), F.corr("residual", "x2").alias("c2"))
    zero = lambda c: F.round(F.abs(c), 6)
    r2 = 1 - F.pow(F.col("rest") / F.col("raw"), 2)
    return g.select("symbol", "n", F.round("raw", 6).alias("raw_std"), F.round("rest", 6).alias("residual_std"), zero("mean").alias("abs_residual_mean"), zero("c1").alias("abs_corr_x1"), zero("c2").alias("abs_corr_x2"), F.round(r2, 6).alias("r2"), F.round(100 * r2, 4).alias("pct_removed"))


def share(part: Column, whole: Column) -> Column:
    return F.round(100 * part / whole, 4)


def variance_ledger(rows: DataFrame) -> DataFrame:
    """Variance of a stock split into the benchmarks' part and the rest, with the identity's error."""
    g = rows.groupBy("symbol").agg(F.var_samp("y").alias("raw"), F.var_samp(F.col("y") - F.col("residual")).alias("bench"), F.var_samp("residual").alias("rest"))
    return g.select("symbol", F.round("raw", 8).alias("raw_variance"), share(F.col("bench"), F.col("raw")).alias("benchmark_pct"), share(F.col("rest"), F.col("raw")).alias("residual_pct"), F.round(F.abs(F.col("raw") - F.col("bench") - F.col("rest")) / F.col("raw"), 6).alias("identity_error"))
