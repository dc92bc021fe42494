"""Delayed scoring, comparisons and inference on losses."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import linalg

LOSSES = ("qlike", "log_mse", "log_mae")


def qlike(outcome: str = "outcome", forecast: str = "forecast") -> Column:
    r = F.col(outcome) / F.col(forecast)
    return F.when((F.col(outcome) > 0) & (F.col(forecast) > 0), r - F.ln(r) - 1)


def score(ledger: DataFrame, outcomes: DataFrame, quality: DataFrame) -> DataFrame:
    """The ledger with outcomes, losses, a status, and whether all models of the key were scored.

    outcomes: target_no, symbol, outcome, one row a key.  quality: target_no, eligible, reason.
    """
    j = ledger.join(outcomes, ["target_no", "symbol"], "left").join(quality, "target_no", "left")
    good = F.coalesce("eligible", F.lit(False))
    status = F.when(F.col("outcome").isNull(), "outcome_unavailable").when(~good, F.coalesce("reason", F.lit("no_quality_metadata"))).when(F.col("outcome") <= 0, "nonpositive_target").otherwise("scored")
    e = F.when(F.col("outcome") > 0, F.ln("outcome") - F.ln("forecast"))
    s = j.withColumn("status", status).withColumn("qlike", F.when(status == "scored", qlike())).withColumn("log_mse", e * e).withColumn("log_mae", F.abs(e))
    key = Window.partitionBy("symbol", "target_no")
    whole = F.sum((F.col("status") == "scored").cast("int")).over(key) == F.count(F.lit(1)).over(key)
    return s.withColumn("comparison_eligible", whole).drop("eligible", "reason")


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """Mean losses of scored rows."""
    means = [F.round(F.avg(x), 6).alias(x) for x in LOSSES]
    return scored.filter("status = 'scored'").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *means, F.round(F.median("qlike"), 6).alias("median_qlike"), F.min("target_no").alias("first_target"), F.max("target_no").alias("last_target"))


def period(scored: DataFrame, name: str, first: str, last: str) -> DataFrame:
    """Summaries of the targets from `first` to `last`, inclusive; where there are none, one row that isn't available."""
    found = summary(scored.filter(F.col("target_day").between(first, last)), "model")
    frame = scored.sparkSession.range(1).select(F.lit(name).alias("period"))
    return frame.join(found, F.lit(True), "left").withColumn("available", F.col("model").isNotNull())


def quarter(day: str) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def paired(scored: DataFrame, model: str, bench: str) -> DataFrame:
    """Loss differences model - bench on keys where all models are scored."""
    values = [F.first(x, True).alias(x) for x in LOSSES]
    rows = scored.filter("comparison_eligible").select("symbol", "target_no", "target_day", "model", *LOSSES)
    wide = rows.groupBy("symbol", "target_no", "target_day").pivot("model", [model, bench]).agg(*values)
    return wide.select("symbol", "target_no", "target_day", *((F.col(f"{model}_{x}") - F.col(f"{bench}_{x}")).alias(f"d_{x}") for x in LOSSES), F.col(f"{bench}_qlike").alias("bench_qlike"), F.col(f"{model}_qlike").alias("model_qlike"))


def matched(pairs: DataFrame) -> DataFrame:
    """Pooled and by symbol: mean difference, improvement in per cent of the benchmark's loss, win rate."""
    both = pairs.withColumn("level", F.explode(F.array(F.lit("ALL"), F.col("symbol"))))
    g = both.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("d_qlike").alias("d"), F.avg("bench_qlike").alias("b"), F.avg((F.col("d_qlike") < 0).cast("double")).alias("win"))
    return g.select("level", "n", F.round("d", 6).alias("mean_difference"), F.round(-100 * F.col("d") / F.greatest("b", F.lit(1e-16)), 4).alias("improvement_pct"), F.round("win", 6).alias("win_rate"))


def by_date(pairs: DataFrame) -> DataFrame:
    """The mean difference over symbols of every target date."""
    return pairs.groupBy("target_no").agg(F.avg("d_qlike").alias("x"))


def cumulative(dates: DataFrame) -> DataFrame:
    """Running sum of the daily difference; one row a date."""
    w = Window.orderBy("target_no").rowsBetween(Window.unboundedPreceding, 0)
    return dates.select("target_no", F.round(F.sum("x").over(w), 6).alias("cumulative"))


def two_sided(z: str) -> Column:
    """The two-sided normal p-value of column `z`, null where it is null; Arrow batches."""

    def p(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for z in batches:
            yield z.map(linalg.two_sided, na_action="ignore").astype("float64")

    return F.pandas_udf(p, "double")(z)


def hac(values: DataFrame, lags: list[int], by: list[str]) -> DataFrame:
    """Bartlett HAC test of a zero mean of x by group, in order of target_no: n, mean, se, z for every lag.

    Autocovariances are sums of products with lagged values, all lags in one window pass and one aggregate.
    """
    group = Window.partitionBy(*by)
    c = values.filter(F.col("x").isNotNull()).withColumn("c", F.col("x") - F.avg("x").over(group))
    top = max(lags)
    lagged = c.select(*by, "x", "c", *(F.lag("c", ell).over(group.orderBy("target_no")).alias(f"l{ell}") for ell in range(1, top + 1)))
    g = lagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.sum(F.col("c") * F.col("c")).alias("g0"), *(F.coalesce(F.sum(F.col("c") * F.col(f"l{ell}")), F.lit(0.0)).alias(f"g{ell}") for ell in range(1, top + 1)))
    out = []
    for lag in lags:
        # Beyond n - 1 the autocovariances are empty sums; the weights follow the capped lag.
        capped = F.least(F.lit(lag), F.col("n") - 1)
        terms = [2 * F.greatest(1 - ell / (capped + 1.0), F.lit(0.0)) * F.col(f"g{ell}") for ell in range(1, lag + 1)]
        long_run = (F.col("g0") + reduce(lambda a, b: a + b, terms)) / F.col("n")
        out.append(g.select(*by, F.lit(lag).alias("lag"), "n", "mean", F.when(F.col("n") >= 2, F.sqrt(F.greatest(long_run / F.col("n"), F.lit(0.0)))).alias("se")))
    whole = reduce(DataFrame.unionByName, out)
    return whole.withColumn("z", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))


def holm(tests: DataFrame, by: str, p: str = "p") -> DataFrame:
    """Holm's step-down adjustment within a group; null stays null."""
    known = Window.partitionBy(by, F.col(p).isNull())
    rank = F.row_number().over(known.orderBy(p, "id"))
    raw = tests.withColumn("raw", F.when(F.col(p).isNotNull(), (F.count(p).over(known) - rank + 1) * F.col(p))).withColumn("rank", rank)
    so_far = Window.partitionBy(by, F.col(p).isNull()).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("raw").over(so_far)))).drop("raw", "rank")


def benjamini_hochberg(tests: DataFrame, by: str, p: str = "p") -> DataFrame:
    """Step-up adjustment within a group; null stays null."""
    known = Window.partitionBy(by, F.col(p).isNull())
    rank = F.row_number().over(known.orderBy(p, "id"))
    raw = tests.withColumn("rank", rank).withColumn("raw", F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(known) / F.col("rank")))
    onward = Window.partitionBy(by, F.col(p).isNull()).orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    return raw.withColumn("bh", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("raw").over(onward)))).drop("raw", "rank")


def directional(scored: DataFrame) -> DataFrame:
    """Share of scored forecasts whose change has the outcome's sign; no change on either side doesn't count."""
    change, want = F.signum(F.col("forecast") - F.col("origin_level")), F.signum(F.col("outcome") - F.col("origin_level"))
    hit = F.when((change != 0) & (want != 0), (change == want).cast("double"))
    return scored.filter("status = 'scored'").groupBy("model").agg(F.count(hit).alias("n"), F.round(F.avg(hit), 6).alias("directional_accuracy"))


def model_keys(ledger: DataFrame, models: int) -> DataFrame:
    """Keys by their number of distinct models, and whether that is as declared."""
    g = ledger.groupBy("symbol", "target_no").agg(F.countDistinct("model").alias("n_models"), F.count(F.lit(1)).alias("n_rows"))
    return g.groupBy("n_models").agg(F.count(F.lit(1)).alias("n_keys"), F.max("n_rows").alias("max_rows")).withColumn("complete", (F.col("n_models") == models) & (F.col("max_rows") == models))
