"""Queries over rolling windows: components by width and view, alignment, networks by control, resumed issuance."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import factors, har, issuance, moments, rolling, summaries, windows
from gridloom.plans import model_queries as models
from gridloom.plans.ctes import WIDE
from gridloom.plans.panel_queries import MEMBERS, STOCKS, daily, days, wide
from gridloom.plans.registry import query
from gridloom.sources.shared import folder, settle

WIDTHS, STEP = (20, 60), 5
BOTH = [*MEMBERS, *(f"n_{m}" for m in MEMBERS)]


def every_window(spark, sf):
    d = days(spark, sf)
    return reduce(DataFrame.unionByName, [windows.rolling(d, w, STEP).withColumn("width", F.lit(w)) for w in WIDTHS])


def both_panels(spark, sf):
    """Complete sessions, raw and over each weekday's deviation, which stands for a minute's of the day."""
    panel = daily(spark, sf)
    raw = settle(wide(spark, sf), "raw")
    normalized = moments.wide(rolling.by_weekday(panel), ["session_no"], MEMBERS, "y")
    return rolling.paired(raw, normalized, MEMBERS)


def by_window(spark, sf):
    return rolling.window_moments(both_panels(spark, sf), every_window(spark, sf), BOTH)


@query("rolling_pca")
def rolling_pca(spark, sf):
    return rolling.components(by_window(spark, sf), MEMBERS)


@query("rolling_pca_loadings")
def rolling_pca_loadings(spark, sf):
    return rolling.loadings(rolling_pca(spark, sf), STOCKS)


@query("rolling_pca_summary")
def rolling_pca_summary(spark, sf):
    return summaries.rolling_summary(rolling_pca(spark, sf))


@query("rolling_benchmark_diagnostics")
def rolling_benchmark_diagnostics(spark, sf):
    return rolling.benchmark_diagnostics(by_window(spark, sf), MEMBERS)


COVERAGE = """
top AS (SELECT max(session_no) AS n FROM days),
starts AS (SELECT width, unnest(list_distinct(list_append(range(1, n - width + 2, 5), n - width + 1))) AS start_no FROM top, (VALUES (20), (60)) v(width) WHERE n >= width),
win AS (SELECT width, row_number() OVER (PARTITION BY width ORDER BY start_no) - 1 AS window_no, start_no, start_no + width - 1 AS end_no FROM starts)"""


@query("rolling_coverage", f"WITH {WIDE}, {COVERAGE} SELECT w.width::INT AS width, w.window_no::BIGINT AS window_no, w.start_no::BIGINT AS start_no, w.end_no::BIGINT AS end_no, count(c.session_no)::BIGINT AS n_rows, count(c.session_no) > 7 AS enough FROM win w LEFT JOIN complete c ON c.session_no BETWEEN w.start_no AND w.end_no GROUP BY 1, 2, 3, 4")
def rolling_coverage(spark, sf):
    """Complete sessions of every window of rolling components, those without any included."""
    n = F.coalesce("n", F.lit(0).cast("long"))
    return rolling.window_moments(wide(spark, sf), every_window(spark, sf), MEMBERS).select("width", "window_no", "start_no", "end_no", n.alias("n_rows"), (n > len(MEMBERS) + 1).alias("enough"))


def reference(spark, sf):
    return settle(rolling.whole_sample(models.whole_moments(spark, sf), 2), "reference")


@query("rolling_l1_whole_sample")
def rolling_l1_whole_sample(spark, sf):
    """Every window's sparse factors against those of the whole sample, which looks ahead."""
    fits = factors.rolling_rotations(models.by_window(spark, sf), 2, models.STARTS)
    return rolling.against_whole_sample(fits, reference(spark, sf))


@query("kalman_stability")
def kalman_stability(spark, sf):
    return rolling.kalman_stability(models.kalman_windows(spark, sf), reference(spark, sf))


@query("causal_factor_stability")
def causal_factor_stability(spark, sf):
    """Sparse factors of the causal fits, each against the block before; the last window scores nothing and is left out."""
    fits = factors.rolling_rotations(models.by_window(spark, sf, 120, 5), 2, models.STARTS, "causal120")
    return rolling.causal_stability(fits, windows.score_blocks(windows.rolling(days(spark, sf), 120, 5), days(spark, sf)))


CONTROLS = ("raw", "benchmark_residual", "factor_adjusted")


@query("descriptive_networks")
def descriptive_networks(spark, sf):
    """Networks at checkpoints for three controls, by frozen fits of 60 and of 120 sessions; sessions that no fit scores are missing."""
    d = days(spark, sf)
    levels = wide(spark, sf).unpivot(["session_no"], STOCKS, "symbol", "raw")
    calendar = d.select("session_no", "day", F.explode(F.array(*map(F.lit, STOCKS))).alias("symbol"))
    parts = []
    for width in (60, 120):
        scored = models.causal(spark, sf, width).select("session_no", "symbol", F.col("residual").alias("benchmark_residual"), F.col("adjusted").alias("factor_adjusted"))
        series = settle(calendar.join(scored.join(levels, ["session_no", "symbol"]), ["session_no", "symbol"], "left"), f"controls{width}")
        for control in CONTROLS:
            rows = issuance.blocks(har.features(series.withColumn("y", F.col(control))), STOCKS, har.RETUNE)
            parts.append(rows.withColumns({"control": F.lit(control), "factor_window": F.lit(str(width))}))
    return summaries.checkpoint_edges(reduce(DataFrame.unionByName, parts), STOCKS, by=("control", "factor_window"), networks=len(parts))


@query("resumed_forecasts")
def resumed_forecasts(spark, sf):
    """Forecasts issued while half of the calendar was known, then resumed with all of it: the ledger of an uninterrupted run."""
    panel = settle(daily(spark, sf), "daily")
    half = panel.agg((F.max("session_no") / 2).cast("int")).first()[0] or 0
    path = f"{folder(spark)}/gridloom/{spark.sparkContext.applicationId}/resumed-{uuid.uuid4().hex}"
    for known in (panel.filter(F.col("session_no") <= half), panel):
        out = issuance.resumed(settle(issuance.blocks(har.features(known), MEMBERS, har.RETUNE), "blocks"), MEMBERS, har.RETUNE, path)
    return out
