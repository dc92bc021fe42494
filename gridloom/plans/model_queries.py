"""Queries over fitted models: iterative numerics that SQL can't check; tests hold them to invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import factors, har, issuance, moments, scoring, windows
from gridloom.plans.ctes import PAIRS
from gridloom.plans.panel_queries import BENCH, HAC, MEMBERS, STOCKS, daily, days, pairs, wide
from gridloom.plans.registry import query
from gridloom.sources import panels

STARTS = 200


def whole_moments(spark, sf):
    return moments.gram(wide(spark, sf), [], MEMBERS)


def by_window(spark, sf, width=60, step=5):
    d = days(spark, sf)
    inside = windows.sessions_of(windows.rolling(d, width, step), d).select("window_no", "session_no").join(wide(spark, sf), "session_no")
    return moments.gram(inside, ["window_no"], MEMBERS).filter(F.col("n") > 3 * len(MEMBERS))


def tidy_stats(spark, sf):
    tidy = wide(spark, sf).unpivot(["session_no"], MEMBERS, "symbol", "y")
    return tidy, tidy.groupBy("symbol").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"))


@query("pca_summary")
def pca_summary(spark, sf):
    return factors.summary(factors.components(whole_moments(spark, sf), MEMBERS))


@query("pca_loadings")
def pca_loadings(spark, sf):
    return factors.components(whole_moments(spark, sf), MEMBERS).select("view", "method", "component", "symbol", "weight", "loading")


@query("pca_scores")
def pca_scores(spark, sf):
    tidy, stats = tidy_stats(spark, sf)
    weights = factors.components(whole_moments(spark, sf), MEMBERS).filter("view = 'raw' and method = 'correlation'")
    return factors.scores(tidy, stats, weights)


@query("pca_reconstruction")
def pca_reconstruction(spark, sf):
    return factors.reconstruction(whole_moments(spark, sf), MEMBERS)


@query("factor_count")
def factor_count(spark, sf):
    return factors.factor_count(whole_moments(spark, sf))


@query("varimax")
def varimax(spark, sf):
    return factors.varimax(whole_moments(spark, sf), MEMBERS, 3)


@query("sparse_pca_path")
def sparse_pca_path(spark, sf):
    return factors.sparse_path(whole_moments(spark, sf), MEMBERS, 3)


@query("l1_rotation")
def l1_rotation(spark, sf):
    return factors.l1_rotation(whole_moments(spark, sf), MEMBERS, (2, 3, 4), 200)


@query("local_factor_test")
def local_factor_test(spark, sf):
    return factors.l1_rotation(whole_moments(spark, sf), MEMBERS, (3,), 200).select("factor", "n_small", "critical", "local", "source").distinct()


@query("session_bootstrap")
def session_bootstrap(spark, sf):
    months = wide(spark, sf).join(days(spark, sf), "session_no").withColumn("session", F.date_format("day", "yyyy-MM"))
    return factors.session_bootstrap(moments.gram(months, ["session"], MEMBERS), 100, 3, 100, 916, spark)


@query("rolling_l1_stability")
def rolling_l1_stability(spark, sf):
    return factors.stability(factors.rolling_rotations(by_window(spark, sf), 2, STARTS))


@query("kalman_windows")
def kalman_windows(spark, sf):
    return factors.kalman(wide(spark, sf), windows.rolling(days(spark, sf), 60, 20), MEMBERS, 2, 48, STARTS)


def causal(spark, sf, width=120):
    d = days(spark, sf)
    w = windows.rolling(d, width, 5)
    fits = factors.causal_fits(by_window(spark, sf, width, 5), MEMBERS, 1)
    return factors.apply_causal(wide(spark, sf), windows.assignment(windows.score_blocks(w, d), d), fits, BENCH, STOCKS)


@query("causal_factor_vintages")
def causal_factor_vintages(spark, sf):
    return causal(spark, sf)


@query("lasso_har_forecasts")
def lasso_har_forecasts(spark, sf):
    rows = issuance.blocks(har.features(daily(spark, sf)), MEMBERS, har.RETUNE)
    return issuance.forecasts(rows, MEMBERS, har.RETUNE)


def factor_rows(spark, sf):
    """Blocks with the terms of three causal series: the common part, and the adjusted levels of the N and R stocks."""
    mean = lambda c, *of: F.avg(F.when(F.col("symbol").isin(*of), F.col(c)) if of else F.col(c))
    wide_series = causal(spark, sf).groupBy("session_no").agg(mean("common").alias("common"), mean("adjusted", "NF", "NO").alias("local_n"), mean("adjusted", "RF", "RO").alias("local_r"))
    names = ["common", "local_n", "local_r"]
    terms = issuance.factor_terms(wide_series.unpivot(["session_no"], names, "symbol", "y"), days(spark, sf), names)
    return issuance.blocks(har.features(daily(spark, sf)), MEMBERS, har.RETUNE, terms.dropna())


@query("factor_har_forecasts")
def factor_har_forecasts(spark, sf):
    named = lambda *series: [f"{s}_{t}" for s in series for t in issuance.TERMS]
    return issuance.forecasts(factor_rows(spark, sf), MEMBERS, har.RETUNE, named("common"), named("local_n", "local_r"))


@query("loss_bootstrap")
def loss_bootstrap(spark, sf):
    dates = scoring.by_date(pairs(spark, sf))
    return issuance.bootstrap_interval(issuance.loss_bootstrap(dates, 2000, 20, 16), dates)


@query("edge_bootstrap")
def edge_bootstrap(spark, sf):
    rows = issuance.blocks(har.features(daily(spark, sf)), MEMBERS, har.RETUNE)
    return issuance.sign_consistency(issuance.edge_bootstrap(rows, MEMBERS, 200, (20, 5), 16, True, None))


@query("edge_bootstrap_noncircular")
def edge_bootstrap_noncircular(spark, sf):
    rows = issuance.blocks(har.features(daily(spark, sf)), MEMBERS, har.RETUNE)
    return issuance.sign_consistency(issuance.edge_bootstrap(rows, MEMBERS, 200, (5, 20), 15, False, None))


ERF = "2 / sqrt(pi()) * exp(-x * x) * x * list_sum(list_transform(range(0, 400), lambda k: exp(k * ln(2 * x * x) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"


@query("hac_p_values", f"WITH {PAIRS}, {HAC} SELECT 'ALL' AS level, lag, n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / se, 3) AS z, round(greatest(1 - {ERF}, 0), 8) AS p_value FROM (SELECT *, greatest(abs(mean / se) / sqrt(2), 1e-150) AS x FROM t WHERE n >= 2 AND se > 0)")
def hac_p_values(spark, sf):
    """Two-sided p-values of the HAC tests, by erfc in Arrow batches; SQL has them from the series of erf."""
    dates = scoring.by_date(pairs(spark, sf)).withColumn("level", F.lit("ALL"))
    tests = scoring.hac(dates, [5, 20], ["level"]).filter("se > 0").withColumn("p", scoring.two_sided("z"))
    return tests.select("level", "lag", "n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("z", 3).alias("z"), F.round("p", 8).alias("p_value"))


PRIORITY = """
levels AS (SELECT o_orderdate::DATE AS day, o_orderpriority AS symbol, avg(o_totalprice) AS level FROM orders GROUP BY 1, 2),
days AS (SELECT day, row_number() OVER (ORDER BY day) AS session_no FROM (SELECT DISTINCT day FROM levels)),
names AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS symbol),
panel AS (SELECT d.session_no, n.symbol, CASE WHEN l.level > 0 THEN ln(l.level) END AS y FROM days d CROSS JOIN names n LEFT JOIN levels l ON l.day = d.day AND l.symbol = n.symbol),
framed AS (SELECT symbol, session_no, count(y) OVER (PARTITION BY symbol ORDER BY session_no ROWS 4 PRECEDING) = 5 AS w, count(y) OVER (PARTITION BY symbol ORDER BY session_no ROWS 21 PRECEDING) = 22 AS m FROM panel)"""


@query("priority_panel_quality", f"WITH {PRIORITY} SELECT symbol, count(*) AS n, count(*) FILTER (w) AS n_w, count(*) FILTER (m) AS n_m FROM framed WHERE session_no >= 22 GROUP BY 1")
def priority_panel_quality(spark, sf):
    """Strict 5- and 22-session means on the sparse priority panel: how many are null."""
    levels = panels.daily_priority(spark, sf)
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    panel = har.on_calendar(levels, panels.numbered(levels), names)
    return har.features(panel).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("w").alias("n_w"), F.count("m").alias("n_m"))
