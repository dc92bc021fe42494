"""Long panels from tables: one row a (session, bar, symbol) or a (day, symbol).

Every adapter is one scan and one aggregate, so column pruning reaches the Parquet reader and the
shuffle carries partial sums only.  A query settles the panel, which is small, and scans the table
once, however often the panel is used.  Panels stay long; wide rows exist only inside grouped kernels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.shared import once

#: Bars of the hourly panel: sessions are calendar days of 24 bars.
OPEN_BAR, CLOSE_BAR, BARS = 0, 24, 24
SYMBOLS = ("click", "error", "purchase", "signup", "view")
#: Columns of the daily panel: two benchmarks, then stocks in matrix order.
BENCHMARKS = ("AF", "AO")
STOCKS = ("NF", "NO", "RF", "RO")


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table `name`, pruned to `columns` in that order; a missing column is an error before anything runs."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return require(df, *columns) if columns else df


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Ordered projection with an existence check."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column: missing values are nulls from here on."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


@once
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, bar, symbol, close (mean value), volume (events), from `events` by the hour."""
    e = no_nan(scan(spark, sf_dir, "events", "ts", "event_type", "value"))
    keyed = e.select(F.to_date("ts").alias("session"), F.hour("ts").alias("bar"), F.col("event_type").alias("symbol"), "value")
    return keyed.groupBy("session", "bar", "symbol").agg(F.avg("value").alias("close"), F.count(F.lit(1)).alias("volume"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, open_bar, close_bar, expected_bars: one row an observed day."""
    days = bars(spark, sf_dir).select("session").distinct()
    return days.select("session", F.lit(OPEN_BAR).alias("open_bar"), F.lit(CLOSE_BAR).alias("close_bar"), F.lit(BARS).alias("expected_bars"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol").distinct()


@once
def daily_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, symbol (return flag and line status), level (mean extended price), from `lineitem`."""
    rows = scan(spark, sf_dir, "lineitem", "l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice")
    keyed = rows.select(F.to_date("l_shipdate").alias("day"), F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_extendedprice").cast("double").alias("x"))
    return keyed.groupBy("day", "symbol").agg(F.avg("x").alias("level"))


@once
def daily_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, symbol (order priority), level (mean total price), from `orders`."""
    rows = scan(spark, sf_dir, "orders", "o_orderdate", "o_orderpriority", "o_totalprice")
    return rows.groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("symbol")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("level"))


def numbered(days: DataFrame, day: str = "day") -> DataFrame:
    """Distinct days with session_no from 1.  The days of a calendar are few, whatever the rows behind them."""
    from pyspark.sql import Window

    return days.select(day).distinct().withColumn("session_no", F.row_number().over(Window.orderBy(day)))
