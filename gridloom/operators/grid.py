"""Calendar grids, session filters and missing data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid(calendar: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every (session, bar, symbol) the calendar expects; bars come from the calendar, never from a symbol's rows.

    Symbols are a dimension of a panel's width, a handful; the product is the grid itself.
    """
    bars = calendar.select("session", F.explode(F.sequence(F.col("open_bar"), F.col("close_bar") - 1)).alias("bar"))
    return bars.join(F.broadcast(symbols.select("symbol").distinct()))


def on_grid(bars: DataFrame, calendar: DataFrame, symbols: DataFrame) -> DataFrame:
    """The grid with close and volume where a bar was observed, and `missing`."""
    return grid(calendar, symbols).join(bars, ["session", "bar", "symbol"], "left").withColumn("missing", F.col("close").isNull())


def in_session(ticks: DataFrame, calendar: DataFrame, minute: str = "minute") -> DataFrame:
    """Rows whose minute is in [open_minute, close_minute) of their session; the calendar is one row a day."""
    hours = calendar.select("session", "open_minute", "close_minute")
    return ticks.join(hours, "session").filter((F.col(minute) >= F.col("open_minute")) & (F.col(minute) < F.col("close_minute"))).drop("open_minute", "close_minute")


def consolidate(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the first by `order`: overlapping parts of a download become one series."""
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("rank = 1").drop("rank")


def without_gap(bars: DataFrame, session: str, first: int, last: int) -> DataFrame:
    """Bars outside a known systemic gap, which is dropped, not nulled."""
    return bars.filter(~((F.col("session") == F.lit(session).cast("date")) & F.col("bar").between(first, last)))


def missing_matrix(panel: DataFrame, symbols: list[str]) -> DataFrame:
    """One row a (session, bar): a flag a symbol, n_missing and missing_pct."""
    flags = [F.max(F.when(F.col("symbol") == s, F.col("missing"))).alias(f"missing_{s}") for s in symbols]
    n = F.sum(F.col("missing").cast("long"))
    return panel.groupBy("session", "bar").agg(*flags, n.alias("n_missing"), F.round(100.0 * n / F.count(F.lit(1)), 6).alias("missing_pct"))


def common_gaps(panel: DataFrame, least: int) -> DataFrame:
    """Bars that at least `least` symbols miss, and which."""
    g = panel.groupBy("session", "bar").agg(F.sum(F.col("missing").cast("long")).alias("n_missing"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("missing"), F.col("symbol")))), ",").alias("affected"))
    return g.filter(F.col("n_missing") >= least)


def daily_missing(panel: DataFrame, worst: int = 30) -> DataFrame:
    """Sessions with the most missing cells: the largest number in one bar, and the sum."""
    bars = panel.groupBy("session", "bar").agg(F.sum(F.col("missing").cast("long")).alias("n"))
    days = bars.groupBy("session").agg(F.max("n").alias("max_missing"), F.sum("n").alias("total_missing"))
    return days.orderBy(F.desc("total_missing"), "session").limit(worst)


def daily_quality(panel: DataFrame) -> DataFrame:
    """Coverage of a symbol in a session."""
    g = panel.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("expected_bars"), F.sum((~F.col("missing")).cast("long")).alias("observed_bars"))
    return g.select("symbol", "session", "expected_bars", "observed_bars", (F.col("expected_bars") - F.col("observed_bars")).alias("missing_bars"), F.round(F.col("observed_bars") / F.col("expected_bars"), 8).alias("coverage"))


def quality_summary(daily: DataFrame, bars: DataFrame) -> DataFrame:
    """Coverage of a symbol over all sessions, with its liquidity."""
    q = daily.groupBy("symbol").agg(
        F.countDistinct("session").alias("trading_days"), F.sum("expected_bars").alias("expected_bars"), F.sum("observed_bars").alias("observed_bars"), F.sum("missing_bars").alias("missing_bars"),
        F.round(F.avg("coverage"), 6).alias("avg_daily_coverage"), F.round(F.min("coverage"), 6).alias("worst_daily_coverage"),
    )
    q = q.withColumn("total_coverage", F.round(F.col("observed_bars") / F.col("expected_bars"), 6))
    liquidity = bars.groupBy("symbol").agg(F.median("volume").alias("median_volume"), F.round(F.avg("volume"), 6).alias("mean_volume"))
    return q.join(liquidity, "symbol", "left")


def months(first: str, last: str):
    """Half-open months [start, end) that cover [first, last), the outer ones cut; for `spark.range(1).select(...)`."""
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    month = F.explode(F.sequence(F.trunc(lo, "MM"), F.date_sub(hi, 1), F.expr("interval 1 month")))
    return month, lo, hi


def month_partitions(spark, first: str, last: str) -> DataFrame:
    """label, start, end of the months of a download."""
    month, lo, hi = months(first, last)
    return spark.range(1).select(month.alias("m")).select(F.date_format("m", "yyyy-MM").alias("label"), F.greatest("m", lo).alias("start"), F.least(F.add_months("m", 1), hi).alias("end"))
