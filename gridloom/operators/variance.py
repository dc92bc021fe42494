"""Realized variance from valid intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INTERVAL = 4
FLOOR = 1e-16
MATERIAL = 100.0
ELIGIBLE = 0.90


def complete_bars(panel: DataFrame, value: str, width: int) -> DataFrame:
    """(session, bar, symbol, value) of the bars where all `width` symbols have a value, so that controls share observations."""
    n = F.count(value).over(Window.partitionBy("session", "bar"))
    return panel.withColumn("n_here", n).filter(F.col("n_here") == width).drop("n_here")


def intervals(bars: DataFrame, calendar: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """session, bin, valid: intervals anchored at the open; valid if every bar of it is there exactly once and it ends by the close."""
    at = bars.select("session", "bar").join(calendar, "session").filter((F.col("bar") >= F.col("open_bar")) & (F.col("bar") < F.col("close_bar")))
    binned = at.withColumn("bin", F.floor((F.col("bar") - F.col("open_bar")) / interval).cast("int"))
    seen = binned.groupBy("session", "bin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bar").alias("bars"))
    grid = calendar.select("session", "open_bar", "close_bar", F.explode(F.sequence(F.lit(0), F.ceil((F.col("close_bar") - F.col("open_bar")) / interval).cast("int") - 1)).alias("bin"))
    ends = F.col("open_bar") + (F.col("bin") + 1) * interval
    valid = (F.coalesce("n", F.lit(0)) == interval) & (F.coalesce("bars", F.lit(0)) == interval) & (ends <= F.col("close_bar"))
    return grid.join(seen, ["session", "bin"], "left").select("session", "bin", F.coalesce("n", F.lit(0)).alias("n_bars"), valid.alias("valid"))


def diagnostics(bins: DataFrame, calendar: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """Counts of intervals by session and the fraction of bars in valid ones."""
    valid = F.sum(F.col("valid").cast("long"))
    g = bins.groupBy("session").agg(F.sum("n_bars").alias("observed_bars"), F.count(F.lit(1)).alias("n_candidate"), valid.alias("n_valid"))
    return g.join(calendar.select("session", "expected_bars"), "session").select("session", F.col("expected_bars").cast("long").alias("expected_bars"), "observed_bars", "n_candidate", "n_valid", (F.col("n_candidate") - F.col("n_valid")).alias("n_invalid"), F.round(F.col("n_valid") * interval / F.col("expected_bars"), 8).alias("valid_bar_fraction"))


def realized(bars: DataFrame, bins: DataFrame, calendar: DataFrame, value: str, interval: int = INTERVAL) -> DataFrame:
    """session, symbol, rv: squared sums of the valid intervals, added up."""
    at = bars.join(calendar.select("session", "open_bar"), "session").withColumn("bin", F.floor((F.col("bar") - F.col("open_bar")) / interval).cast("int"))
    sums = at.join(bins.filter("valid").select("session", "bin"), ["session", "bin"], "left_semi").groupBy("session", "symbol", "bin").agg(F.sum(value).alias("r"))
    return sums.groupBy("session", "symbol").agg(F.sum(F.col("r") * F.col("r")).alias("rv"))


def log_rv(rv: str = "rv", floor: float = FLOOR):
    return F.ln(F.greatest(F.col(rv), F.lit(floor)))


def floor_diagnostics(rv: DataFrame, floor: float = FLOOR) -> DataFrame:
    """How often the floor binds, by symbol."""
    few = lambda limit: F.sum((F.col("rv") <= limit).cast("long"))
    return rv.groupBy("symbol").agg(F.count("rv").alias("n_days"), few(floor).alias("n_floor"), few(floor * MATERIAL).alias("n_material"), F.round(F.min("rv"), 8).alias("min_rv"), F.round(F.median("rv"), 8).alias("median_rv"), F.round(F.max("rv"), 8).alias("max_rv"))


def eligibility(calendar: DataFrame, diag: DataFrame, rv: DataFrame, floor: float = FLOOR) -> DataFrame:
    """One row a session: whether its variance may be scored, and why not."""
    floored = rv.groupBy("session").agg(F.max((F.col("rv") <= floor).cast("int")).alias("floored"))
    j = calendar.select("session").join(diag, "session", "left").join(floored, "session", "left")
    n, fraction = F.coalesce("n_valid", F.lit(0)), F.coalesce("valid_bar_fraction", F.lit(0.0))
    reason = F.when(F.col("n_valid").isNull(), "session_missing").when(n < 1, "no_valid_intervals").when(fraction < ELIGIBLE, "insufficient_valid_bars").otherwise("eligible")
    return j.select("session", n.cast("long").alias("n_valid"), fraction.alias("valid_bar_fraction"), reason.alias("reason"), (reason == "eligible").alias("eligible"), (F.coalesce("floored", F.lit(0)) > 0).alias("floor_applied"))
