"""HAR designs, training bounds and issuance of forecasts that SQL windows can make.

A missing session stays on the calendar as null and voids every mean that crosses it.  Windows are
within a symbol; a panel has one row a session and symbol, so these partitions hold days, not ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

HORIZONS = {"d": 1, "w": 5, "m": 22}
RETUNE = 20
LEAST_TRAINING = 30


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("session_no")


def on_calendar(levels: DataFrame, days: DataFrame, symbols: list[str]) -> DataFrame:
    """session_no, day, symbol, level, y for every session and symbol; y is null where nothing was observed."""
    names = F.explode(F.array(*map(F.lit, symbols)))
    full = days.select("session_no", "day", names.alias("symbol")).join(levels, ["day", "symbol"], "left")
    return full.withColumn("y", F.when(F.col("level") > 0, F.ln("level")))


def strict_mean(value: str, n: int, over: WindowSpec | None = None) -> Column:
    """Mean of the last n rows, null unless all are there and none is null."""
    w = (over or by_symbol()).rowsBetween(-n + 1, 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def features(panel: DataFrame) -> DataFrame:
    """d, w, m and the next session's y as `response`; rows from the first full month on."""
    f = panel.select("symbol", "session_no", "day", "y", *(strict_mean("y", n).alias(k) for k, n in HORIZONS.items()), F.lead("y").over(by_symbol()).alias("response"), F.lead("session_no").over(by_symbol()).alias("target_no"), F.lead("day").over(by_symbol()).alias("target_day"))
    return f.filter(F.col("session_no") >= HORIZONS["m"])


def legacy_features(panel: DataFrame) -> DataFrame:
    """The same on observed rows only: no calendar, so means step over missing sessions."""
    seen = panel.filter(F.col("y").isNotNull()).withColumn("row_no", F.row_number().over(by_symbol()))
    by_row = Window.partitionBy("symbol").orderBy("row_no")
    f = seen.select("symbol", "row_no", "day", *(strict_mean("y", n, by_row).alias(k) for k, n in HORIZONS.items()), F.lead("y").over(by_row).alias("response"))
    return f.filter(F.col("row_no") >= HORIZONS["m"])


def finite(*columns: str) -> Column:
    """The training mask: every column is there."""
    return ~F.exists(F.array(*columns), lambda x: x.isNull())


def training_counts(design: DataFrame, rolling: int = 252) -> DataFrame:
    """Rows that an origin may train on: all before it, and the last `rolling` before it, that are finite.

    The row of an origin itself is not known at its close, as its response is the next session's.
    """
    ok = F.when(finite("d", "w", "m", "response"), 1).otherwise(0)
    rows = design.withColumn("ok", ok)
    before = lambda lo: F.coalesce(F.sum("ok").over(by_symbol().rowsBetween(lo, -1)), F.lit(0)).cast("long")
    return rows.select("symbol", "session_no", "day", before(Window.unboundedPreceding).alias("n_expanding"), before(-rolling).alias("n_rolling"), F.when(finite("d", "w", "m"), F.lit(True)).otherwise(F.lit(False)).alias("has_features"))


def statuses(counts: DataFrame, least: int = LEAST_TRAINING) -> DataFrame:
    """Why an origin is or is not issued."""
    s = F.when(~F.col("has_features"), "not_issued_missing_origin_features").when(F.col("n_expanding") < least, "not_issued_insufficient_training_history").otherwise("issued")
    return counts.withColumn("status", s)


def tuning_blocks(issued: DataFrame, every: int = RETUNE) -> DataFrame:
    """Issued origins numbered by symbol; a model is tuned again at the first of every `every`."""
    n = F.row_number().over(by_symbol())
    return issued.filter("status = 'issued'").select("symbol", "session_no", n.cast("long").alias("issued_no"), F.floor((n - 1) / every).cast("long").alias("tuning_block"), ((n - 1) % every == 0).alias("retuned"))


def ledger(design: DataFrame, least: int = LEAST_TRAINING) -> DataFrame:
    """Target-free forecasts of three models: persistence, the monthly mean, and a regression on d over all earlier rows."""
    before = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    pair = F.col("d").isNotNull() & F.col("response").isNotNull()
    x, y = F.when(pair, F.col("d")), F.when(pair, F.col("response"))
    n, sx, sy, sxx, sxy = (F.sum(v).over(before) for v in (F.when(pair, 1.0), x, y, x * x, x * y))
    spread = n * sxx - sx * sx
    slope = F.when((n >= least) & (spread > 0), (n * sxy - sx * sy) / spread)
    fitted = design.withColumn("n_train", F.coalesce(n, F.lit(0.0))).withColumn("slope", slope).withColumn("intercept", (sy - slope * sx) / n)
    issued = fitted.filter((F.col("n_train") >= least) & F.col("d").isNotNull() & F.col("m").isNotNull() & F.col("slope").isNotNull() & F.col("target_no").isNotNull())
    clip = lambda c: F.exp(F.least(F.greatest(c, F.lit(-40.0)), F.lit(40.0)))
    models = F.explode(F.array(
        F.struct(F.lit("persistence").alias("model"), clip(F.col("d")).alias("forecast")),
        F.struct(F.lit("month_mean").alias("model"), clip(F.col("m")).alias("forecast")),
        F.struct(F.lit("own_har").alias("model"), clip(F.col("intercept") + F.col("slope") * F.col("d")).alias("forecast")),
    ))
    return issued.select("symbol", F.col("session_no").alias("origin_no"), "target_no", "target_day", F.exp("d").alias("origin_level"), models.alias("f")).select("symbol", "origin_no", "target_no", "target_day", "origin_level", "f.model", "f.forecast")


def regression(design: DataFrame) -> DataFrame:
    """One-regressor HAR by symbol over the whole sample."""
    ok = design.filter(finite("d", "response"))
    return ok.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("response", "d"), 6).alias("slope"), F.round(F.regr_intercept("response", "d"), 6).alias("intercept"), F.round(F.regr_r2("response", "d"), 6).alias("r2"))


def prospective(issued: DataFrame, frozen: int, opened: int) -> DataFrame:
    """Gates of a prospective run, in sessions: targets after the freeze that have not opened yet."""
    gate = F.when(F.col("target_no") <= frozen, "not_issued_before_protocol_freeze").when(F.col("target_no") <= opened, "not_issued_target_already_opened").otherwise("issued")
    return issued.withColumn("gate", gate)
