"""Rollups over the fitted models; rows only, as their inputs are iterative fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import factors, har, issuance, moments, network, scoring, summaries, variance, windows
from gridloom.plans import model_queries as models
from gridloom.plans.ctes import LEDGER
from gridloom.plans.panel_queries import MEMBERS, SORTED, daily, days, design, hourly_returns, intervals, scored
from gridloom.plans.registry import query
from gridloom.sources import panels
from gridloom.sources.shared import settle

GROUPS = {"open": ["NO", "RO"], "final": ["NF", "RF"], "returned": ["RF", "RO"]}


@query("variance_ledger_components")
def variance_ledger_components(spark, sf):
    return summaries.component_ledger(models.whole_moments(spark, sf), MEMBERS)


@query("global_variance_shares")
def global_variance_shares(spark, sf):
    return summaries.global_shares(variance_ledger_components(spark, sf))


@query("sparse_path_rollup")
def sparse_path_rollup(spark, sf):
    return summaries.sparse_rollup(models.sparse_pca_path(spark, sf))


@query("session_bootstrap_summary")
def session_bootstrap_summary(spark, sf):
    return summaries.bootstrap_summary(models.session_bootstrap(spark, sf))


def labelled(spark, sf):
    d = days(spark, sf)
    w = windows.rolling(d, 60, 5)
    return w, windows.regimes(windows.sessions_of(w, d).withColumn("regime", F.year("day").cast("string")))


@query("window_diagnostics")
def window_diagnostics(spark, sf):
    w, labels = labelled(spark, sf)
    return summaries.window_diagnostics(models.rolling_l1_stability(spark, sf), w.join(labels, "window_no"))


@query("regime_summary")
def regime_summary(spark, sf):
    return summaries.regime_summary(models.rolling_l1_stability(spark, sf), labelled(spark, sf)[1])


@query("start_sensitivity")
def start_sensitivity(spark, sf):
    refit = factors.stability(factors.rolling_rotations(models.by_window(spark, sf), 2, 500))
    return summaries.compared(models.rolling_l1_stability(spark, sf), refit)


def window_loadings(spark, sf):
    fits = factors.rolling_rotations(models.by_window(spark, sf), 2, models.STARTS)
    stocks = F.array(*map(F.lit, MEMBERS[2:]))
    return fits.select("window_no", F.posexplode("loadings").alias("at", "values")).select("window_no", F.concat(F.lit("LF"), (F.col("at") + 1).cast("string")).alias("factor"), F.explode(F.arrays_zip(stocks.alias("symbol"), F.col("values").alias("loading"))).alias("x")).select("window_no", "factor", "x.symbol", "x.loading")


@query("group_concentration")
def group_concentration(spark, sf):
    return summaries.concentration(window_loadings(spark, sf), GROUPS, MEMBERS[2:])


@query("candidate_summary")
def candidate_summary(spark, sf):
    return summaries.candidates(group_concentration(spark, sf), {"open": 0.55, "final": 0.55, "returned": 0.55})


@query("stress_comparison")
def stress_comparison(spark, sf):
    return summaries.stress(group_concentration(spark, sf), "returned", 40, 60)


@query("loading_importance")
def loading_importance(spark, sf):
    return summaries.importance(window_loadings(spark, sf), 4)


@query("method_comparison")
def method_comparison(spark, sf):
    return summaries.methods(models.kalman_windows(spark, sf))


@query("kalman_factor_sensitivity")
def kalman_factor_sensitivity(spark, sf):
    w = windows.rolling(days(spark, sf), 60, 20).filter("window_no % 5 = 0")
    out = [factors.kalman(models.wide(spark, sf), w, MEMBERS, k, 48, models.STARTS).withColumn("k", F.lit(k)) for k in (2, 3)]
    return out[0].unionByName(out[1])


@query("variance_vintages")
def variance_vintages(spark, sf):
    """Realized variance of five symbols' hourly returns: two as benchmarks, three as stocks, fits of ten sessions."""
    members = SORTED
    cal = panels.calendar(spark, sf)
    whole, bins = intervals(spark, sf)
    d = panels.numbered(cal.select(F.col("session").alias("day")))
    m = summaries.bin_moments(whole, bins, cal, members, "ret", variance.INTERVAL).join(d.withColumnRenamed("day", "session"), "session")
    complete = moments.wide(hourly_returns(spark, sf), ["session", "bar"], members, "clean").join(d.withColumnRenamed("day", "session"), "session")
    w = windows.rolling(d, 10, 5)
    gram = moments.gram(windows.sessions_of(w, d).select("window_no", "session_no").join(complete, "session_no"), ["window_no"], members).filter(F.col("n") > 3 * len(members))
    return summaries.vintages(m, factors.causal_fits(gram, members, 1), windows.assignment(windows.score_blocks(w, d), d), members[2:])


@query("checkpoint_networks")
def checkpoint_networks(spark, sf):
    rows = issuance.blocks(design(spark, sf), MEMBERS, har.RETUNE)
    return summaries.checkpoint_edges(rows, MEMBERS)


@query("checkpoint_network_stability")
def checkpoint_network_stability(spark, sf):
    edges = checkpoint_networks(spark, sf).withColumnRenamed("checkpoint", "origin")
    return network.stability(edges)


@query("legacy_walk_forward")
def legacy_walk_forward(spark, sf):
    """Forecasts from observed rows only, without a calendar: rows are those on which every symbol was seen."""
    seen = models.wide(spark, sf).unpivot(["session_no"], MEMBERS, "symbol", "y").join(days(spark, sf), "session_no")
    f = har.legacy_features(seen).withColumnRenamed("row_no", "session_no").withColumn("target_no", F.when(F.col("response").isNotNull(), F.col("session_no") + 1))
    return issuance.forecasts(issuance.blocks(f, MEMBERS, har.RETUNE), MEMBERS, har.RETUNE)


@query("network_score_ledger")
def network_score_ledger(spark, sf):
    """Forecasts of the fitted models, scored like the others."""
    panel = daily(spark, sf)
    outcomes = panel.filter(F.col("level").isNotNull()).select(F.col("session_no").alias("target_no"), "symbol", F.col("level").alias("outcome"))
    quality = panel.groupBy(F.col("session_no").alias("target_no")).agg((F.count("y") >= 4).alias("eligible")).withColumn("reason", F.lit("insufficient_symbols"))
    return scoring.score(models.lasso_har_forecasts(spark, sf), outcomes, quality)


PAIRS = [("aggregate_har", "own_har"), ("local_har", "own_har"), ("network_1se", "own_har"), ("hybrid_har", "aggregate_har"), ("hybrid_har", "network_1se"), ("own_har", "persistence")]


@query("factor_comparisons")
def factor_comparisons(spark, sf):
    """HAC tests of the declared pairs of models at two lags, with Holm's adjustment within a lag."""
    panel = daily(spark, sf)
    outcomes = panel.filter(F.col("level").isNotNull()).select(F.col("session_no").alias("target_no"), "symbol", F.col("level").alias("outcome"))
    quality = panel.groupBy(F.col("session_no").alias("target_no")).agg((F.count("y") >= 4).alias("eligible")).withColumn("reason", F.lit("insufficient_symbols"))
    ledger = models.factor_har_forecasts(spark, sf).withColumn("target_day", F.lit(None).cast("date"))
    rows = settle(scoring.score(ledger, outcomes, quality).select("symbol", "target_no", "target_day", "model", "comparison_eligible", *scoring.LOSSES), "scored")
    daily_differences = [scoring.by_date(scoring.paired(rows, a, b)).withColumn("pair", F.lit(f"{a} - {b}")) for a, b in PAIRS]
    tests = scoring.hac(reduce(DataFrame.unionByName, daily_differences), [5, 20], ["pair"])
    return scoring.holm(tests.withColumn("p_value", scoring.two_sided("z")).withColumn("id", F.col("pair")), "lag", "p_value").drop("id")


MEANS = "count(*) AS n, round(avg(qlike), 6) AS qlike, round(avg(log_mse), 6) AS log_mse, round(avg(log_mae), 6) AS log_mae, round(median(qlike), 6) AS median_qlike, min(target_no) AS first_target, max(target_no) AS last_target"


@query("stress_availability", f"WITH {LEDGER}, periods AS (SELECT * FROM (VALUES ('spring_1997', DATE '1997-03-01', DATE '1997-05-31'), ('never', DATE '1950-01-01', DATE '1950-02-01')) p(period, a, b)), found AS (SELECT period, model, {MEANS} FROM scored JOIN periods ON target_day BETWEEN a AND b WHERE status = 'scored' GROUP BY 1, 2) SELECT p.period, f.* EXCLUDE (period), f.model IS NOT NULL AS available FROM periods p LEFT JOIN found f USING (period)")
def stress_availability(spark, sf):
    """Two periods' summaries; a period without scored rows is one row that says so."""
    rows = scored(spark, sf)
    parts = [scoring.period(rows, name, first, last) for name, first, last in (("spring_1997", "1997-03-01", "1997-05-31"), ("never", "1950-01-01", "1950-02-01"))]
    return parts[0].unionByName(parts[1])
