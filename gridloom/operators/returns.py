"""Previous-tick fill, strict returns, contamination and cleaning.

All windows are within (symbol, session): they shuffle once, on keys that spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_session() -> WindowSpec:
    return Window.partitionBy("symbol", "session").orderBy("bar")


def forward_fill(panel: DataFrame) -> DataFrame:
    """`filled`: the last close so far in the session; leading nulls stay null.  `missing` is from before the fill."""
    so_far = by_session().rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn("filled", F.last("close", ignorenulls=True).over(so_far))


def log_returns(panel: DataFrame, price: str = "filled", strict: bool = True) -> DataFrame:
    """`ret`: log change from the previous row of the session; strict: only if that row is one bar earlier.

    Prices must be positive; others give no return here and are found by `bad_prices`.
    """
    p = F.when(F.col(price) > 0, F.ln(price))
    change = p - F.lag(p).over(by_session())
    if strict:
        change = F.when(F.col("bar") - F.lag("bar").over(by_session()) == 1, change)
    return panel.withColumn("ret", change)


def bad_prices(panel: DataFrame, price: str = "filled") -> DataFrame:
    return panel.filter(F.col(price) <= 0)


def contaminated(panel: DataFrame) -> DataFrame:
    """`contaminated`: missing here or in the previous row of the session."""
    return panel.withColumn("contaminated", F.col("missing") | F.coalesce(F.lag("missing").over(by_session()), F.lit(False)))


def clean(panel: DataFrame, bad_sessions: list[str]) -> DataFrame:
    """`clean`: the return, null in bad sessions and contaminated cells."""
    bad = F.col("session").cast("string").isin(bad_sessions)
    return panel.withColumn("clean", F.when(~bad & ~F.col("contaminated"), F.col("ret")))


def complete(panel: DataFrame, rows: list[str], value: str, members: list[str]) -> DataFrame:
    """Rows of which every member has a value; members are chosen before rows are dropped."""
    chosen = panel.filter(F.col("symbol").isin(members))
    whole = chosen.groupBy(*rows).agg(F.count(value).alias("n")).filter(F.col("n") == len(members)).select(*rows)
    return chosen.join(whole, rows, "left_semi")


def distribution(panel: DataFrame, value: str) -> DataFrame:
    """Mean, deviation, extremes and the 0.1 % and 99.9 % quantiles by symbol."""
    q = F.percentile(value, F.array(F.lit(0.001), F.lit(0.999)))
    g = panel.groupBy("symbol").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("q"))
    return g.select("symbol", "n", *(F.round(c, 8).alias(c) for c in ("mean", "std", "min", "max")), F.round(F.col("q")[0], 8).alias("q001"), F.round(F.col("q")[1], 8).alias("q999"))


def largest(panel: DataFrame, value: str, k: int = 50) -> DataFrame:
    """The k cells of largest absolute value, nulls left out, ties by key."""
    rows = panel.filter(F.col(value).isNotNull()).select("session", "bar", "symbol", F.round(value, 8).alias(value), F.round(F.abs(value), 8).alias("absolute"))
    return rows.orderBy(F.desc("absolute"), "session", "bar", "symbol").limit(k)


def bar_profile(panel: DataFrame, value: str) -> DataFrame:
    """Volatility of a bar of the day: deviation and count of every symbol."""
    return panel.groupBy("bar", "symbol").agg(F.count(value).alias("n"), F.stddev_samp(value).alias("scale"))


def cross_profile(profile: DataFrame) -> DataFrame:
    """Mean, least and greatest scale over the symbols of a bar."""
    return profile.groupBy("bar").agg(F.round(F.avg("scale"), 8).alias("mean_scale"), F.round(F.min("scale"), 8).alias("min_scale"), F.round(F.max("scale"), 8).alias("max_scale"))


def normalized(panel: DataFrame, value: str) -> DataFrame:
    """The value over its full-sample deviation in that bar; descriptive, as it looks ahead."""
    scale = F.stddev_samp(value).over(Window.partitionBy("symbol", "bar"))
    return panel.withColumn("normalized", F.when(scale > 0, F.col(value) / scale))
