"""Queries over the hourly and the daily panel that SQL can check, by way of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import grid, har, moments, network, returns, scoring, variance, windows
from gridloom.plans.ctes import BARS, BINS, EDGES, FILLED, HAR, LEDGER, PAIRS, RETURNS, ROLL, STABLE, WIDE
from gridloom.plans.registry import query
from gridloom.sources import panels

BAD_SESSIONS = ["2024-01-16"]
MEMBERS = [*panels.BENCHMARKS, *panels.STOCKS]
SORTED = sorted(panels.SYMBOLS)


def hourly(spark, sf):
    return grid.on_grid(panels.bars(spark, sf), panels.calendar(spark, sf), panels.symbols(spark, sf))


def hourly_returns(spark, sf):
    return returns.clean(returns.contaminated(returns.log_returns(returns.forward_fill(hourly(spark, sf)))), BAD_SESSIONS)


def intervals(spark, sf):
    whole = variance.complete_bars(hourly_returns(spark, sf), "ret", len(panels.SYMBOLS))
    bars = whole.select("session", "bar").distinct()
    return whole, variance.intervals(bars, panels.calendar(spark, sf))


def realized(spark, sf):
    whole, bins = intervals(spark, sf)
    return variance.realized(whole, bins, panels.calendar(spark, sf), "ret")


# -- grids and quality ------------------------------------------------------------------------


@query("calendar_grid", f"WITH {BARS} SELECT session, bar, symbol FROM grid")
def calendar_grid(spark, sf):
    return grid.grid(panels.calendar(spark, sf), panels.symbols(spark, sf))


@query("session_time_filter", "SELECT event_id, ts::DATE AS session, (extract(hour FROM ts) * 60 + extract(minute FROM ts))::INT AS minute FROM events WHERE extract(hour FROM ts) * 60 + extract(minute FROM ts) >= 570 AND extract(hour FROM ts) * 60 + extract(minute FROM ts) < 960")
def session_time_filter(spark, sf):
    ticks = panels.scan(spark, sf, "events", "event_id", "ts").select("event_id", F.to_date("ts").alias("session"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    hours = panels.calendar(spark, sf).select("session", F.lit(570).alias("open_minute"), F.lit(960).alias("close_minute"))
    return grid.in_session(ticks, hours).select("event_id", "session", "minute")


@query("bars_dedup_consolidate", "SELECT event_type, date_trunc('minute', ts) AS minute, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def bars_dedup_consolidate(spark, sf):
    part = panels.scan(spark, sf, "events", "event_id", "ts", "event_type").select("event_type", F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("minute"), "event_id")
    return grid.consolidate(part.unionByName(part), ["event_type", "minute"], "event_id")


@query("month_partitions", "SELECT strftime(m, '%Y-%m') AS label, greatest(m::DATE, DATE '2023-01-17') AS start, least((m + INTERVAL 1 MONTH)::DATE, DATE '2024-03-05') AS \"end\" FROM (SELECT unnest(generate_series(DATE '2023-01-01', DATE '2024-03-01', INTERVAL 1 MONTH)) AS m)")
def month_partitions(spark, sf):
    return grid.month_partitions(spark, "2023-01-17", "2024-03-05")


FLAGS = ", ".join(f"bool_or(missing) FILTER (symbol = '{s}') AS missing_{s}" for s in SORTED)


@query("missing_matrix", f"WITH {BARS} SELECT session, bar, {FLAGS}, sum(missing::INT)::BIGINT AS n_missing, round(100.0::DOUBLE * sum(missing::INT) / count(*), 6) AS missing_pct FROM panel GROUP BY 1, 2")
def missing_matrix(spark, sf):
    return grid.missing_matrix(hourly(spark, sf), SORTED)


@query("common_gaps", f"WITH {BARS} SELECT session, bar, sum(missing::INT)::BIGINT AS n_missing, string_agg(symbol, ',' ORDER BY symbol) FILTER (missing) AS affected FROM panel GROUP BY 1, 2 HAVING sum(missing::INT) >= 2")
def common_gaps(spark, sf):
    return grid.common_gaps(hourly(spark, sf), 2)


@query("daily_missing_summary", f"WITH {BARS} SELECT session, max(n)::BIGINT AS max_missing, sum(n)::BIGINT AS total_missing FROM (SELECT session, bar, sum(missing::INT) AS n FROM panel GROUP BY 1, 2) GROUP BY 1 ORDER BY total_missing DESC, session LIMIT 30")
def daily_missing_summary(spark, sf):
    return grid.daily_missing(hourly(spark, sf))


DAILY = "daily AS (SELECT symbol, session, count(*) AS expected_bars, sum((NOT missing)::INT)::BIGINT AS observed_bars, sum(missing::INT)::BIGINT AS missing_bars, round(sum((NOT missing)::INT) / count(*)::DOUBLE, 8) AS coverage FROM panel GROUP BY 1, 2)"


@query("daily_quality", f"WITH {BARS}, {DAILY} SELECT * FROM daily")
def daily_quality(spark, sf):
    return grid.daily_quality(hourly(spark, sf))


@query("quality_summary", f"WITH {BARS}, {DAILY} SELECT symbol, count(DISTINCT session) AS trading_days, sum(expected_bars)::BIGINT AS expected_bars, sum(observed_bars)::BIGINT AS observed_bars, sum(missing_bars)::BIGINT AS missing_bars, round(avg(coverage), 6) AS avg_daily_coverage, round(min(coverage), 6) AS worst_daily_coverage, round(sum(observed_bars) / sum(expected_bars)::DOUBLE, 6) AS total_coverage, median_volume, mean_volume FROM daily LEFT JOIN (SELECT symbol, median(volume)::DOUBLE AS median_volume, round(avg(volume), 6) AS mean_volume FROM bars GROUP BY 1) USING (symbol) GROUP BY symbol, median_volume, mean_volume")
def quality_summary(spark, sf):
    return grid.quality_summary(grid.daily_quality(hourly(spark, sf)), panels.bars(spark, sf))


@query("gap_filter", f"WITH {BARS} SELECT session, bar, symbol, round(close, 8) AS close FROM bars WHERE NOT (session = DATE '2024-01-10' AND bar BETWEEN 9 AND 11)")
def gap_filter(spark, sf):
    return grid.without_gap(panels.bars(spark, sf), "2024-01-10", 9, 11).select("session", "bar", "symbol", F.round("close", 8).alias("close"))


# -- returns ----------------------------------------------------------------------------------


@query("forward_fill_prices", f"WITH {FILLED} SELECT session, bar, symbol, missing, round(filled, 8) AS filled FROM filled")
def forward_fill_prices(spark, sf):
    return returns.forward_fill(hourly(spark, sf)).select("session", "bar", "symbol", "missing", F.round("filled", 8).alias("filled"))


@query("strict_log_returns", f"WITH {RETURNS} SELECT session, bar, symbol, round(ret, 8) AS ret FROM returns")
def strict_log_returns(spark, sf):
    return returns.log_returns(returns.forward_fill(hourly(spark, sf))).select("session", "bar", "symbol", F.round("ret", 8).alias("ret"))


@query("contamination_mask", f"WITH {RETURNS} SELECT session, bar, symbol, missing, contaminated FROM returns")
def contamination_mask(spark, sf):
    return returns.contaminated(hourly(spark, sf)).select("session", "bar", "symbol", "missing", "contaminated")


@query("clean_returns", f"WITH {RETURNS} SELECT session, bar, symbol, round(clean, 8) AS clean FROM cleaned")
def clean_returns(spark, sf):
    return hourly_returns(spark, sf).select("session", "bar", "symbol", F.round("clean", 8).alias("clean"))


@query("complete_universe", f"WITH {RETURNS} SELECT session, bar, symbol, round(clean, 8) AS clean FROM (SELECT *, count(clean) OVER (PARTITION BY session, bar) AS n FROM cleaned WHERE symbol IN ('click', 'purchase', 'view')) WHERE n = 3")
def complete_universe(spark, sf):
    return returns.complete(hourly_returns(spark, sf), ["session", "bar"], "clean", ["click", "purchase", "view"]).select("session", "bar", "symbol", F.round("clean", 8).alias("clean"))


@query("return_distribution", f"WITH {RETURNS} SELECT symbol, count(clean) AS n, round(avg(clean), 8) AS mean, round(stddev_samp(clean), 8) AS std, round(min(clean), 8) AS min, round(max(clean), 8) AS max, round(quantile_cont(clean, 0.001::DOUBLE), 8) AS q001, round(quantile_cont(clean, 0.999::DOUBLE), 8) AS q999 FROM cleaned GROUP BY 1")
def return_distribution(spark, sf):
    return returns.distribution(hourly_returns(spark, sf), "clean")


@query("top_absolute_returns", f"WITH {RETURNS} SELECT session, bar, symbol, round(clean, 8) AS clean, round(abs(clean), 8) AS absolute FROM cleaned WHERE clean IS NOT NULL ORDER BY absolute DESC, session, bar, symbol LIMIT 50")
def top_absolute_returns(spark, sf):
    return returns.largest(hourly_returns(spark, sf), "clean")


@query("minute_profile", f"WITH {RETURNS}, p AS (SELECT bar, symbol, stddev_samp(clean) AS scale FROM cleaned GROUP BY 1, 2) SELECT bar, round(avg(scale), 8) AS mean_scale, round(min(scale), 8) AS min_scale, round(max(scale), 8) AS max_scale FROM p GROUP BY 1")
def minute_profile(spark, sf):
    return returns.cross_profile(returns.bar_profile(hourly_returns(spark, sf), "clean"))


@query("minute_normalize", f"WITH {RETURNS} SELECT session, bar, symbol, round(CASE WHEN s > 0 THEN clean / s END, 6) AS normalized FROM (SELECT *, stddev_samp(clean) OVER (PARTITION BY symbol, bar) AS s FROM cleaned)")
def minute_normalize(spark, sf):
    return returns.normalized(hourly_returns(spark, sf), "clean").select("session", "bar", "symbol", F.round("normalized", 6).alias("normalized"))


# -- realized variance ------------------------------------------------------------------------


@query("valid_bins", f"WITH {BINS} SELECT session, bin, n_bars, valid FROM bins")
def valid_bins(spark, sf):
    return intervals(spark, sf)[1]


@query("interval_diagnostics", f"WITH {BINS} SELECT * FROM diag")
def interval_diagnostics(spark, sf):
    return variance.diagnostics(intervals(spark, sf)[1], panels.calendar(spark, sf))


@query("realized_variance", f"WITH {BINS} SELECT session, symbol, round(rv, 8) AS rv, round(ln(greatest(rv, 1e-16)), 6) AS log_rv FROM rv")
def realized_variance(spark, sf):
    return realized(spark, sf).select("session", "symbol", F.round("rv", 8).alias("rv"), F.round(variance.log_rv(), 6).alias("log_rv"))


@query("rv_floor_diagnostics", f"WITH {BINS} SELECT symbol, count(rv) AS n_days, sum((rv <= 1e-16)::INT)::BIGINT AS n_floor, sum((rv <= 1e-14)::INT)::BIGINT AS n_material, round(min(rv), 8) AS min_rv, round(median(rv), 8) AS median_rv, round(max(rv), 8) AS max_rv FROM rv GROUP BY 1")
def rv_floor_diagnostics(spark, sf):
    return variance.floor_diagnostics(realized(spark, sf))


@query("rv_eligibility", f"WITH {BINS} SELECT c.session, coalesce(n_valid, 0)::BIGINT AS n_valid, coalesce(valid_bar_fraction, 0) AS valid_bar_fraction, CASE WHEN n_valid IS NULL THEN 'session_missing' WHEN n_valid < 1 THEN 'no_valid_intervals' WHEN valid_bar_fraction < 0.9 THEN 'insufficient_valid_bars' ELSE 'eligible' END AS reason, coalesce(n_valid >= 1 AND valid_bar_fraction >= 0.9, false) AS eligible, coalesce(f, false) AS floor_applied FROM cal c LEFT JOIN diag USING (session) LEFT JOIN (SELECT session, bool_or(rv <= 1e-16) AS f FROM rv GROUP BY 1) USING (session)")
def rv_eligibility(spark, sf):
    cal = panels.calendar(spark, sf)
    whole, bins = intervals(spark, sf)
    return variance.eligibility(cal, variance.diagnostics(bins, cal), variance.realized(whole, bins, cal, "ret"))


# -- the daily panel --------------------------------------------------------------------------


def daily(spark, sf):
    levels = panels.daily_levels(spark, sf)
    return har.on_calendar(levels, panels.numbered(levels), MEMBERS)


def days(spark, sf):
    return panels.numbered(panels.daily_levels(spark, sf))


def design(spark, sf):
    return har.features(daily(spark, sf))


def scored(spark, sf):
    panel = daily(spark, sf)
    outcomes = panel.filter(F.col("level").isNotNull()).select(F.col("session_no").alias("target_no"), "symbol", F.col("level").alias("outcome"))
    quality = panel.groupBy(F.col("session_no").alias("target_no")).agg((F.count("y") >= 4).alias("eligible")).withColumn("reason", F.lit("insufficient_symbols"))
    return scoring.score(har.ledger(har.features(panel)), outcomes, quality)


def pairs(spark, sf):
    return scoring.paired(scored(spark, sf), "own_har", "persistence")


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("har_features", f"WITH {HAR} SELECT symbol, session_no, day, round(d, 6) AS d, round(w, 6) AS w, round(m, 6) AS m, round(response, 6) AS response, target_no FROM design")
def har_features(spark, sf):
    return rounded(design(spark, sf), 6, "d", "w", "m", "response").drop("y", "target_day")


LEGACY = "o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_no)::INT AS row_no FROM panel WHERE y IS NOT NULL)"


@query("har_features_legacy", f"WITH {HAR}, {LEGACY} SELECT symbol, row_no, day, round(y, 6) AS d, round(avg(y) OVER (PARTITION BY symbol ORDER BY row_no ROWS 4 PRECEDING), 6) AS w, round(avg(y) OVER (PARTITION BY symbol ORDER BY row_no ROWS 21 PRECEDING), 6) AS m, round(lead(y) OVER (PARTITION BY symbol ORDER BY row_no), 6) AS response FROM o QUALIFY row_no >= 22")
def har_features_legacy(spark, sf):
    return rounded(har.legacy_features(daily(spark, sf)), 6, "d", "w", "m", "response")


@query("har_training_counts", f"WITH {HAR} SELECT symbol, session_no, day, n_expanding, n_rolling, has_features, status FROM status")
def har_training_counts(spark, sf):
    return har.statuses(har.training_counts(design(spark, sf)))


@query("issuance_status_counts", f"WITH {HAR} SELECT symbol, status, count(*) AS n FROM status GROUP BY 1, 2")
def issuance_status_counts(spark, sf):
    return har.statuses(har.training_counts(design(spark, sf))).groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"))


@query("tuning_blocks", f"WITH {HAR} SELECT symbol, session_no, issued_no, ((issued_no - 1) // 20)::BIGINT AS tuning_block, (issued_no - 1) % 20 = 0 AS retuned FROM (SELECT symbol, session_no, row_number() OVER (PARTITION BY symbol ORDER BY session_no) AS issued_no FROM status WHERE status = 'issued')")
def tuning_blocks(spark, sf):
    return har.tuning_blocks(har.statuses(har.training_counts(design(spark, sf))))


@query("prospective_gates", f"WITH {LEDGER} SELECT gate, count(*) AS n, min(target_no) AS first_target FROM (SELECT target_no, CASE WHEN target_no <= 500 THEN 'not_issued_before_protocol_freeze' WHEN target_no <= 600 THEN 'not_issued_target_already_opened' ELSE 'issued' END AS gate FROM ledger) GROUP BY 1")
def prospective_gates(spark, sf):
    gated = har.prospective(har.ledger(design(spark, sf)), 500, 600)
    return gated.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.min("target_no").alias("first_target"))


@query("persistence_forecast_ledger", f"WITH {LEDGER} SELECT symbol, origin_no, target_no, model, round(ln(forecast), 6) AS log_forecast FROM ledger")
def persistence_forecast_ledger(spark, sf):
    return har.ledger(design(spark, sf)).select("symbol", "origin_no", "target_no", "model", F.round(F.ln("forecast"), 6).alias("log_forecast"))


@query("simple_har_regression", f"WITH {HAR} SELECT symbol, count(*) AS n, round(regr_slope(response, d), 6) AS slope, round(regr_intercept(response, d), 6) AS intercept, round(regr_r2(response, d), 6) AS r2 FROM design WHERE d IS NOT NULL AND response IS NOT NULL GROUP BY 1")
def simple_har_regression(spark, sf):
    return har.regression(design(spark, sf))


# -- scoring ----------------------------------------------------------------------------------


@query("score_ledger", f"WITH {LEDGER} SELECT symbol, target_no, model, status, comparison_eligible, round(qlike, 6) AS qlike, round(log_mse, 6) AS log_mse, round(log_mae, 6) AS log_mae FROM scored")
def score_ledger(spark, sf):
    return rounded(scored(spark, sf).select("symbol", "target_no", "model", "status", "comparison_eligible", *scoring.LOSSES), 6, *scoring.LOSSES)


SUMMARY = "count(*) AS n, round(avg(qlike), 6) AS qlike, round(avg(log_mse), 6) AS log_mse, round(avg(log_mae), 6) AS log_mae, round(median(qlike), 6) AS median_qlike, min(target_no) AS first_target, max(target_no) AS last_target FROM scored WHERE status = 'scored'"


@query("model_summary", f"WITH {LEDGER} SELECT model, {SUMMARY} GROUP BY 1")
def model_summary(spark, sf):
    return scoring.summary(scored(spark, sf), "model")


@query("stock_summary", f"WITH {LEDGER} SELECT model, symbol, {SUMMARY} GROUP BY 1, 2")
def stock_summary(spark, sf):
    return scoring.summary(scored(spark, sf), "model", "symbol")


@query("quarter_summary", f"WITH {LEDGER} SELECT model, year(target_day)::VARCHAR || 'Q' || quarter(target_day)::VARCHAR AS quarter, {SUMMARY} GROUP BY 1, 2")
def quarter_summary(spark, sf):
    return scoring.summary(scored(spark, sf).withColumn("quarter", scoring.quarter("target_day")), "model", "quarter")


@query("stress_period", f"WITH {LEDGER} SELECT model, {SUMMARY} AND target_day BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' GROUP BY 1")
def stress_period(spark, sf):
    return scoring.summary(scored(spark, sf).filter(F.col("target_day").between("1997-03-01", "1997-05-31")), "model")


@query("paired_losses", f"WITH {PAIRS} SELECT symbol, target_no, target_day, round(d_qlike, 6) AS d_qlike, round(d_log_mse, 6) AS d_log_mse, round(d_log_mae, 6) AS d_log_mae FROM pairs")
def paired_losses(spark, sf):
    return rounded(pairs(spark, sf).drop("bench_qlike", "model_qlike"), 6, "d_qlike", "d_log_mse", "d_log_mae")


@query("matched_comparisons", f"WITH {PAIRS}, b AS (SELECT 'ALL' AS level, * FROM pairs UNION ALL SELECT symbol, * FROM pairs) SELECT level, count(*) AS n, round(avg(d_qlike), 6) AS mean_difference, round(-100 * avg(d_qlike) / greatest(avg(bench_qlike), 1e-16), 4) AS improvement_pct, round(avg((d_qlike < 0)::INT), 6) AS win_rate FROM b GROUP BY 1")
def matched_comparisons(spark, sf):
    return scoring.matched(pairs(spark, sf))


HAC = """
c AS (SELECT *, x - avg(x) OVER () AS c, row_number() OVER (ORDER BY target_no) AS k FROM dates WHERE x IS NOT NULL),
a AS (SELECT l.lag AS ell, sum(p.c * q.c) AS g FROM c p CROSS JOIN (SELECT unnest(range(0, 21)) AS lag) l JOIN c q ON q.k = p.k - l.lag GROUP BY 1),
t AS (SELECT L.lag, n, mean, sqrt(greatest((SELECT sum(CASE WHEN ell = 0 THEN g ELSE 2 * greatest(1 - ell / (least(L.lag, n - 1) + 1.0::DOUBLE), 0) * g END) FROM a WHERE ell <= L.lag) / n / n, 0)) AS se FROM (VALUES (5), (20)) L(lag), (SELECT count(*) AS n, avg(x) AS mean FROM c))"""


@query("hac_mean_test", f"WITH {PAIRS}, {HAC} SELECT 'ALL' AS level, lag, n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / se, 3) AS z FROM t WHERE n >= 2 AND se > 0")
def hac_mean_test(spark, sf):
    dates = scoring.by_date(pairs(spark, sf)).withColumn("level", F.lit("ALL"))
    out = scoring.hac(dates, [5, 20], ["level"]).filter("se > 0")
    return out.select("level", "lag", "n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("z", 3).alias("z"))


TESTS = "tests AS (SELECT p_partkey AS id, p_brand AS grp, CASE WHEN p_size % 17 <> 0 THEN ((p_partkey * 7919) % 1009) / 1009.0::DOUBLE END AS p FROM part)"


def tests_of(spark, sf):
    part = panels.scan(spark, sf, "part", "p_partkey", "p_brand", "p_size")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.when(F.col("p_size") % 17 != 0, ((F.col("p_partkey") * 7919) % 1009) / F.lit(1009.0)).alias("p"))


@query("holm_adjust", f"WITH {TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS k, count(*) OVER (PARTITION BY grp) AS n FROM tests WHERE p IS NOT NULL) SELECT id, grp, round(p, 8) AS p, round(least(1, max((n - k + 1) * p) OVER (PARTITION BY grp ORDER BY k ROWS UNBOUNDED PRECEDING)), 8) AS holm FROM r UNION ALL SELECT id, grp, NULL, NULL FROM tests WHERE p IS NULL")
def holm_adjust(spark, sf):
    return rounded(scoring.holm(tests_of(spark, sf), "grp"), 8, "p", "holm")


@query("bh_adjust", f"WITH {TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS k, count(*) OVER (PARTITION BY grp) AS n FROM tests WHERE p IS NOT NULL) SELECT id, grp, round(p, 8) AS p, round(least(1, min(p * n / k) OVER (PARTITION BY grp ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS bh FROM r UNION ALL SELECT id, grp, NULL, NULL FROM tests WHERE p IS NULL")
def bh_adjust(spark, sf):
    return rounded(scoring.benjamini_hochberg(tests_of(spark, sf), "grp"), 8, "p", "bh")


@query("cumulative_loss", f"WITH {PAIRS} SELECT target_no, round(sum(x) OVER (ORDER BY target_no ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM dates")
def cumulative_loss(spark, sf):
    return scoring.cumulative(scoring.by_date(pairs(spark, sf)))


@query("directional_accuracy", f"WITH {LEDGER}, s AS (SELECT model, CASE WHEN sign(forecast - origin_level) <> 0 AND sign(outcome - origin_level) <> 0 THEN (sign(forecast - origin_level) = sign(outcome - origin_level))::INT END AS hit FROM scored WHERE status = 'scored' AND model <> 'persistence') SELECT model, count(hit) AS n, round(avg(hit), 6) AS directional_accuracy FROM s GROUP BY 1")
def directional_accuracy(spark, sf):
    return scoring.directional(scored(spark, sf).filter("model <> 'persistence'"))


@query("model_key_check", f"WITH {LEDGER}, k AS (SELECT symbol, target_no, count(DISTINCT model) AS n_models, count(*) AS n_rows FROM ledger GROUP BY 1, 2) SELECT n_models, count(*) AS n_keys, max(n_rows) AS max_rows, n_models = 3 AND max(n_rows) = 3 AS complete FROM k GROUP BY 1")
def model_key_check(spark, sf):
    return scoring.model_keys(har.ledger(design(spark, sf)), 3)


@query("stock_improvement", f"WITH {PAIRS} SELECT symbol, round(avg(-d_qlike), 6) AS mean, round(stddev_samp(-d_qlike), 6) AS std, count(*) AS n, round(1.96 * stddev_samp(-d_qlike) / sqrt(count(*)), 6) AS half_width FROM pairs GROUP BY 1")
def stock_improvement(spark, sf):
    gain = -F.col("d_qlike")
    return pairs(spark, sf).groupBy("symbol").agg(F.round(F.avg(gain), 6).alias("mean"), F.round(F.stddev_samp(gain), 6).alias("std"), F.count(F.lit(1)).alias("n"), F.round(1.96 * F.stddev_samp(gain) / F.sqrt(F.count(F.lit(1))), 6).alias("half_width"))


# -- networks ---------------------------------------------------------------------------------


def edges(spark, sf):
    return network.lagged_edges(daily(spark, sf))


def groups(spark):
    of = {"A": ["AF", "AO"], "N": ["NF", "NO"], "R": ["RF", "RO"], "O": ["AO", "NO", "RO"]}
    return spark.createDataFrame([(g, s) for g, members in of.items() for s in members], "group string, symbol string")


@query("edge_rollup", f"WITH {EDGES} SELECT * FROM by_origin")
def edge_rollup(spark, sf):
    return network.by_origin(edges(spark, sf))


@query("edge_stability", f"WITH {STABLE} SELECT * FROM stable")
def edge_stability(spark, sf):
    return network.stability(edges(spark, sf))


@query("network_density", f"WITH {STABLE}, n AS (SELECT count(DISTINCT s) AS n FROM (SELECT source AS s FROM by_origin UNION ALL SELECT target FROM by_origin)), o AS (SELECT origin, sum(selected_any) / greatest(n * (n - 1), 1)::DOUBLE AS d, n FROM by_origin, n GROUP BY origin, n) SELECT count(*) AS n_origins, round(avg(d), 6) AS mean_edge_density, round(min(d), 6) AS min_edge_density, round(max(d), 6) AS max_edge_density, (SELECT sum(stable_edge::INT)::BIGINT FROM stable) AS n_stable_edges, round((SELECT sum(stable_edge::INT) FROM stable) / greatest(n * (n - 1), 1)::DOUBLE, 6) AS stable_edge_density, greatest(n * (n - 1), 1)::BIGINT AS possible_directed_edges FROM o GROUP BY n")
def network_density(spark, sf):
    e = edges(spark, sf)
    return network.density(e, network.stability(e))


@query("network_centrality", f"WITH {STABLE}, o AS (SELECT source AS symbol, round(sum(median_absolute_strength), 8) AS os, round(avg(selection_probability), 7) AS op, sum(stable_edge::INT)::BIGINT AS ok FROM stable GROUP BY 1), i AS (SELECT target AS symbol, round(sum(median_absolute_strength), 8) AS s, round(avg(selection_probability), 7) AS p, sum(stable_edge::INT)::BIGINT AS k FROM stable GROUP BY 1) SELECT symbol, coalesce(os, 0) AS outgoing_strength, coalesce(op, 0) AS outgoing_selection_probability, coalesce(ok, 0) AS outgoing_stable_edges, coalesce(s, 0) AS incoming_strength, coalesce(p, 0) AS incoming_selection_probability, coalesce(k, 0) AS incoming_stable_edges FROM o FULL JOIN i USING (symbol)")
def network_centrality(spark, sf):
    return network.centrality(network.stability(edges(spark, sf)))


CONNECT = "z AS (SELECT grp, count(*) AS k FROM grp GROUP BY 1), f AS (SELECT a.grp AS sg, b.grp AS tg, greatest(a.k * b.k - CASE WHEN a.grp = b.grp THEN a.k ELSE 0 END, 0) AS possible FROM z a CROSS JOIN z b), m AS (SELECT a.grp AS sg, b.grp AS tg, avg(selection_probability) AS p, median(median_absolute_strength) AS ms, sum(stable_edge::INT) AS k FROM stable s JOIN grp a ON a.symbol = s.source JOIN grp b ON b.symbol = s.target GROUP BY 1, 2)"


@query("group_connectivity", f"WITH {STABLE}, {CONNECT} SELECT sg AS source_group, tg AS target_group, sg = tg AS within_group, possible::BIGINT AS possible_directed_edges, round(coalesce(p, 0), 6) AS mean_selection_probability, round(coalesce(ms, 0), 8) AS median_edge_strength, coalesce(k, 0)::BIGINT AS stable_edges, round(coalesce(k, 0) / nullif(possible, 0)::DOUBLE, 6) AS stable_edge_density FROM f LEFT JOIN m USING (sg, tg)")
def group_connectivity(spark, sf):
    return network.connectivity(network.stability(edges(spark, sf)), groups(spark))


@query("edge_heatmap", f"WITH {STABLE} SELECT source, " + ", ".join(f"coalesce(max(selection_probability) FILTER (target = '{s}'), 0) AS {s}" for s in sorted(MEMBERS)) + " FROM stable GROUP BY 1")
def edge_heatmap(spark, sf):
    return network.stability(edges(spark, sf)).groupBy("source").pivot("target", sorted(MEMBERS)).agg(F.first("selection_probability", True)).na.fill(0.0)


@query("top_edges", f"WITH {STABLE} SELECT target, source, selection_probability, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY selection_probability DESC, median_absolute_strength DESC, source) AS k FROM stable) WHERE k <= 2")
def top_edges(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("selection_probability"), F.desc("median_absolute_strength"), "source"))
    return network.stability(edges(spark, sf)).withColumn("rank", rank.cast("long")).filter("rank <= 2").select("target", "source", "selection_probability", "rank")


# -- windows ----------------------------------------------------------------------------------

REGIME = "mem AS (SELECT w.window_no, d.session_no, d.day, year(d.day)::VARCHAR AS regime FROM win w JOIN days d ON d.session_no BETWEEN w.start_no AND w.end_no), cn AS (SELECT window_no, regime, count(*) AS k FROM mem GROUP BY 1, 2), la AS (SELECT window_no, arg_max(regime, session_no) AS last, max(day) AS end_day, count(DISTINCT regime) AS n FROM mem GROUP BY 1)"


def rolled(spark, sf):
    return windows.rolling(days(spark, sf), 60, 20)


@query("rolling_windows", f"WITH {ROLL}, {REGIME} SELECT window_no, start_no, end_no, regime AS majority, n > 1 AS mixed, month(end_day) IN (3, 6, 9, 12) AND day(end_day) >= 20 AS quarterly FROM (SELECT *, row_number() OVER (PARTITION BY window_no ORDER BY k DESC, (regime = last) DESC, regime) AS rk FROM cn JOIN la USING (window_no)) JOIN win USING (window_no) WHERE rk = 1")
def rolling_windows(spark, sf):
    w = rolled(spark, sf)
    labelled = windows.sessions_of(w, days(spark, sf)).withColumn("regime", F.year("day").cast("string"))
    return w.join(windows.regimes(labelled), "window_no")


@query("window_sessions", f"WITH {ROLL} SELECT w.window_no, count(*) AS n, min(d.day) AS first_day, max(d.day) AS last_day FROM win w JOIN days d ON d.session_no BETWEEN w.start_no AND w.end_no GROUP BY 1")
def window_sessions(spark, sf):
    return windows.sessions_of(rolled(spark, sf), days(spark, sf)).groupBy("window_no").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("fit_assignment", f"WITH {ROLL}, b AS (SELECT window_no AS block_no, end_no AS training_end, end_no + 1 AS score_start, coalesce(lead(end_no) OVER (ORDER BY window_no), n) AS score_end FROM win, top) SELECT d.session_no, d.day, b.block_no, b.training_end, coalesce(b.training_end < d.session_no, false) AS causal FROM days d LEFT JOIN b ON d.session_no BETWEEN b.score_start AND b.score_end AND b.score_start <= b.score_end")
def fit_assignment(spark, sf):
    d = days(spark, sf)
    return windows.assignment(windows.score_blocks(windows.rolling(d, 60, 20), d), d)


FLAGGED = "fl AS (SELECT p.symbol, w.start_no, count(p.y) < 54 AS flag FROM win w JOIN panel p ON p.session_no BETWEEN w.start_no AND w.end_no GROUP BY 1, 2)"


@query("persistence_flags", f"WITH {ROLL}, {FLAGGED} SELECT symbol, start_no, flag, flag AND coalesce(lag(flag) OVER w2, false) AND coalesce(start_no - lag(start_no) OVER w2 = 20, false) AS persistent FROM fl WINDOW w2 AS (PARTITION BY symbol ORDER BY start_no)")
def persistence_flags(spark, sf):
    panel = daily(spark, sf)
    in_window = windows.sessions_of(rolled(spark, sf), days(spark, sf).select("session_no")).join(panel.select("session_no", "symbol", "y"), "session_no")
    return windows.persistent(in_window.groupBy("symbol", "start_no").agg((F.count("y") < 54).alias("flag")), 20)


@query("smoke_slice", f"WITH {ROLL} SELECT session_no, symbol, round(y, 6) AS y FROM panel, top WHERE session_no > n - 180")
def smoke_slice(spark, sf):
    return rounded(windows.tail_sessions(daily(spark, sf), days(spark, sf), 180).select("session_no", "symbol", "y"), 6, "y")


# -- moments ----------------------------------------------------------------------------------


def wide(spark, sf):
    return moments.wide(daily(spark, sf), ["session_no"], MEMBERS, "y")


PAIR_SQL = "v AS (SELECT session_no, unnest(['AF', 'AO', 'NF', 'NO', 'RF', 'RO']) AS s, unnest([AF, AO, NF, NO, RF, RO]) AS y FROM complete)"


@query("covariance_matrix", f"WITH {WIDE}, {PAIR_SQL} SELECT a.s AS \"row\", b.s AS col, count(*) AS n, round(covar_samp(a.y, b.y), 5) AS cov FROM v a JOIN v b USING (session_no) GROUP BY 1, 2")
def covariance_matrix(spark, sf):
    return rounded(moments.covariance(moments.gram(wide(spark, sf), [], MEMBERS), MEMBERS).drop("corr"), 5, "cov")


@query("correlation_matrix", f"WITH {WIDE}, {PAIR_SQL} SELECT a.s AS \"row\", b.s AS col, count(*) AS n, round(corr(a.y, b.y), 6) AS corr FROM v a JOIN v b USING (session_no) GROUP BY 1, 2")
def correlation_matrix(spark, sf):
    return rounded(moments.covariance(moments.gram(wide(spark, sf), [], MEMBERS), MEMBERS).drop("cov"), 6, "corr")


@query("session_moments", f"WITH {RETURNS}, w AS (SELECT session, bar, " + ", ".join(f"max(clean) FILTER (symbol = '{s}') AS {s}" for s in SORTED) + " FROM cleaned GROUP BY 1, 2), c AS (SELECT * FROM w WHERE " + " AND ".join(f"{s} IS NOT NULL" for s in SORTED) + ") SELECT session, count(*) AS n, round(sum(click), 6) AS s0, round(sum(view), 6) AS s4, round(sum(click * click), 6) AS g00, round(sum(click * view), 6) AS g04, round(sum(view * view), 6) AS g44 FROM c GROUP BY 1")
def session_moments(spark, sf):
    m = moments.gram(moments.wide(hourly_returns(spark, sf), ["session", "bar"], SORTED, "clean"), ["session"], SORTED)
    at = lambda i, j: F.round(F.col("g")[i][j], 6).alias(f"g{i}{j}")
    return m.select("session", "n", F.round(F.col("s")[0], 6).alias("s0"), F.round(F.col("s")[4], 6).alias("s4"), at(0, 0), at(0, 4), at(4, 4))


STOCKS, BENCH = list(panels.STOCKS), list(panels.BENCHMARKS)


@query("benchmark_betas", f"WITH {WIDE} SELECT symbol, n, round(alpha, 5) AS alpha, round(beta1, 6) AS beta1, round(beta2, 6) AS beta2, round(r2, 6) AS r2 FROM fit")
def benchmark_betas(spark, sf):
    fit = moments.betas(wide(spark, sf), STOCKS, BENCH)
    return fit.select("symbol", "n", F.round("alpha", 5).alias("alpha"), *(F.round(c, 6).alias(c) for c in ("beta1", "beta2", "r2")))


def residual_rows(spark, sf):
    w = wide(spark, sf)
    return moments.residuals(w, moments.betas(w, STOCKS, BENCH), STOCKS, BENCH, ["session_no"])


@query("benchmark_residuals", f"WITH {WIDE} SELECT session_no, symbol, round(e, 6) AS residual FROM resid")
def benchmark_residuals(spark, sf):
    return residual_rows(spark, sf).select("session_no", "symbol", F.round("residual", 6).alias("residual"))


@query("residual_diagnostics", f"WITH {WIDE} SELECT symbol, count(*) AS n, round(stddev_samp(y), 6) AS raw_std, round(stddev_samp(e), 6) AS residual_std, round(abs(avg(e)), 6) AS abs_residual_mean, round(abs(corr(e, x1)), 6) AS abs_corr_x1, round(abs(corr(e, x2)), 6) AS abs_corr_x2, round(1 - (stddev_samp(e) / stddev_samp(y)) ** 2, 6) AS r2, round(100 * (1 - (stddev_samp(e) / stddev_samp(y)) ** 2), 4) AS pct_removed FROM resid GROUP BY 1")
def residual_diagnostics(spark, sf):
    return moments.residual_diagnostics(residual_rows(spark, sf))


@query("variance_ledger_benchmark", f"WITH {WIDE} SELECT symbol, round(var_samp(y), 8) AS raw_variance, round(100 * var_samp(y - e) / var_samp(y), 4) AS benchmark_pct, round(100 * var_samp(e) / var_samp(y), 4) AS residual_pct, round(abs(var_samp(y) - var_samp(y - e) - var_samp(e)) / var_samp(y), 6) AS identity_error FROM resid GROUP BY 1")
def variance_ledger_benchmark(spark, sf):
    return moments.variance_ledger(residual_rows(spark, sf))


@query("melt_wide", f"WITH {WIDE}, {PAIR_SQL} SELECT session_no, s AS symbol, round(y, 6) AS y FROM v")
def melt_wide(spark, sf):
    return rounded(wide(spark, sf).unpivot(["session_no"], MEMBERS, "symbol", "y"), 6, "y")
