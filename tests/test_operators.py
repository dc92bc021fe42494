"""Panel operators: calendar rules, missing data, causality, scoring, ledgers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import lasso
from gridloom.operators import factors, grid, har, issuance, moments, network, returns, scoring, variance, windows
from gridloom.sources import ledgers, panels
from gridloom.streaming import prospective


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_grid_comes_from_the_calendar(spark):
    cal = spark.createDataFrame([(day(0), 0, 4, 4), (day(1), 0, 2, 2)], "session date, open_bar int, close_bar int, expected_bars int")
    bars = spark.createDataFrame([(day(0), 1, "a", 2.0, 1), (day(1), 3, "a", 9.0, 1)], "session date, bar int, symbol string, close double, volume long")
    panel = grid.on_grid(bars, cal, bars.select("symbol").distinct())
    assert panel.count() == 6 and panel.filter("missing").count() == 5


def test_fill_returns_and_contamination(spark):
    rows = [(day(0), b, "a", c) for b, c in enumerate([None, 1.0, None, math.e, 1.0])] + [(day(1), 0, "a", 5.0)]
    panel = spark.createDataFrame([(*r, r[3] is None) for r in rows], "session date, bar int, symbol string, close double, missing boolean")
    out = returns.contaminated(returns.log_returns(returns.forward_fill(panel))).orderBy("session", "bar").collect()
    assert [r.filled for r in out] == [None, 1.0, 1.0, math.e, 1.0, 5.0]
    assert [r.ret for r in out] == [None, None, 0.0, 1.0, -1.0, None]
    assert [r.contaminated for r in out] == [True, True, True, True, False, False]
    holed = grid.without_gap(panel.withColumn("missing", F.lit(False)), "2024-01-01", 2, 2)
    strict = returns.log_returns(holed, "close").filter("bar = 3").first().ret
    loose = returns.log_returns(holed, "close", strict=False).filter("bar = 3").first().ret
    assert strict is None and abs(loose - 1) < 1e-12


def test_selection_before_complete_cases(spark):
    panel = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", None), (2, "a", None), (2, "b", 1.0)], "t int, symbol string, v double")
    assert returns.complete(panel, ["t"], "v", ["a", "b"]).count() == 2
    assert returns.complete(panel, ["t"], "v", ["a", "b", "c"]).count() == 0


def test_full_day_interval_fraction(spark):
    cal = spark.createDataFrame([(day(0), 570, 960, 390), (day(1), 570, 780, 210)], "session date, open_bar int, close_bar int, expected_bars int")
    bars = cal.select("session", F.explode(F.sequence(F.col("open_bar") + 1, F.col("close_bar") - 1)).alias("bar"))
    bins = variance.intervals(bars, cal, 5)
    d = {r.session: r for r in variance.diagnostics(bins, cal, 5).collect()}
    assert (d[day(0)].n_candidate, d[day(0)].n_valid) == (78, 77) and abs(d[day(0)].valid_bar_fraction - 0.98718) < 1e-5
    assert d[day(1)].n_candidate == 42
    rv = variance.realized(bars.withColumn("symbol", F.lit("a")).withColumn("r", F.lit(0.1)), bins, cal, "r", 5)
    assert abs(rv.filter(F.col("session") == day(0)).first().rv - 77 * 0.25) < 1e-9


def days_of(spark, n):
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("session_no"), F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("day"))


@pytest.mark.parametrize("width, step, n", [(60, 5, 174), (120, 5, 162), (60, 20, 45)])
def test_window_counts(spark, width, step, n):
    w = windows.rolling(days_of(spark, 923), width, step)
    assert w.count() == n and w.agg(F.max("end_no")).first()[0] == 923
    assert windows.rolling(days_of(spark, width - 1), width, step).count() == 0


@pytest.mark.parametrize("factor_window, n", [(120, 529), (60, 589)])
def test_issuance_counts(spark, factor_window, n):
    panel = days_of(spark, 923).filter(F.col("session_no") > factor_window).select((F.col("session_no") - factor_window).alias("session_no"), "day", F.lit("a").alias("symbol"), F.lit(1.0).alias("y"))
    counts = har.training_counts(har.features(panel))
    assert counts.filter((F.col("n_expanding") >= 252) & (F.col("session_no") < 923 - factor_window)).count() == n


def test_missing_session_voids_means(spark):
    panel = days_of(spark, 60).select("session_no", "day", F.lit("a").alias("symbol"), F.when(F.col("session_no") != 30, F.col("session_no") * 1.0).alias("y"))
    f = {r.session_no: r for r in har.features(panel).collect()}
    assert f[29].w == 27.0 and all(f[k].w is None for k in range(30, 35)) and f[35].w == 33.0
    assert all(f[k].m is None for k in range(30, 52)) and f[52].m is not None
    assert 30 not in [r.row_no for r in har.legacy_features(panel).collect() if r.m is None]


def level_panel(spark, n=400, seed=1, symbols=("AF", "AO", "NF", "NO", "RF", "RO"), bump=None):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, len(symbols))) * 0.1
    for t in range(1, n):
        y[t] += 0.6 * y[t - 1]
        y[t, 2] += 0.5 * y[t - 1, 0]
    if bump is not None:
        y[bump:] += 5
    rows = [(t + 1, day(t), s, float(np.exp(y[t, i])), float(y[t, i])) for t in range(n) for i, s in enumerate(symbols)]
    return spark.createDataFrame(rows, "session_no int, day date, symbol string, level double, y double")


def test_forecasts_ignore_the_future(spark):
    a, b = (har.ledger(har.features(level_panel(spark, bump=x))).filter("origin_no < 300") for x in (None, 310))
    key = ["symbol", "origin_no", "model"]
    assert a.join(b.select(*key, F.col("forecast").alias("other")), key).filter("abs(forecast - other) > 1e-9").count() == 0
    symbols = ["AF", "AO", "NF", "NO", "RF", "RO"]
    short = [level_panel(spark, n=170, bump=x) for x in (None, 155)]
    c, d = (issuance.forecasts(issuance.blocks(har.features(p), symbols, 20), symbols, 20).filter("origin_no < 150").select(*key, "forecast").toPandas().sort_values(key) for p in short)
    assert len(c) > 0 and np.allclose(c["forecast"], d["forecast"], rtol=1e-9)


def test_planted_edge_is_selected(spark):
    symbols = ["AF", "AO", "NF", "NO", "RF", "RO"]
    rows = issuance.blocks(har.features(level_panel(spark)), symbols, 20)
    e = issuance.edge_bootstrap(rows, symbols, 10, 20, 1, True).toPandas()
    daily_edges = e[e["horizon"] == "D"]
    best = daily_edges.loc[daily_edges["median_coefficient"].abs().idxmax()]
    assert (best.source, best.target, best.selection_probability) == ("AF", "NF", 1.0) and abs(best.median_coefficient - 0.5) < 0.2
    again = issuance.edge_bootstrap(rows.repartition(5), symbols, 10, 20, 1, True).toPandas()
    assert sorted(map(tuple, e.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_edge_bootstrap_covers_all_training_rows(spark):
    symbols = ["AF", "AO", "NF", "NO", "RF", "RO"]
    rows = issuance.blocks(har.features(level_panel(spark, n=560)), symbols, 20)
    for circular in (True, False):
        e = issuance.sign_consistency(issuance.edge_bootstrap(rows, symbols, 5, (20, 5), 1, circular, None)).toPandas()
        # 538 origins with a target: checkpoints at 252, 378, 504 and the last; each trains on every origin before it.
        assert sorted(set(zip(e["checkpoint"], e["n_train"], e["training_end"]))) == [(c, c, c + 21) for c in (252, 378, 504, 537)]
        assert set(e["block_length"]) == {5, 20} and set(e["n"]) == {5} and len(e) == 4 * 2 * 6 * 15
        nonzero = e["n_positive"] + e["n_negative"]
        assert (e["sign_consistency"].isna() == (nonzero == 0)).all() and e["sign_consistency"].dropna().between(0.5, 1).all()
        planted = e[(e["source"] == "AF") & (e["target"] == "NF") & (e["horizon"] == "D")]
        assert len(planted) == 8 and (planted["sign_consistency"].dropna() == 1).all() and planted["selection_probability"].mean() > 2 * e["selection_probability"].mean()
    part = rows.toPandas().query("symbol == 'NF' and session_no < 252 + 22").sort_values("session_no")
    terms = np.array(part["terms"].tolist())
    tuned = lasso.tune(terms[:, 6:9], np.delete(terms, [6, 7, 8], 1), part["response"].to_numpy())["one_se"]
    assert np.allclose(e[(e["target"] == "NF") & (e["checkpoint"] == 252)]["penalty"], tuned)


def test_score_statuses(spark):
    ledger = spark.createDataFrame([("a", t, m, 1.0, 1.0) for t in range(1, 6) for m in ("x", "y")], "symbol string, target_no int, model string, forecast double, origin_level double")
    outcomes = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.0), ("a", 3, 1.0), ("a", 5, 1.0)], "symbol string, target_no int, outcome double")
    quality = spark.createDataFrame([(1, True, ""), (2, True, ""), (3, False, "few_bars")], "target_no int, eligible boolean, reason string")
    out = {(r.target_no, r.model): r for r in scoring.score(ledger, outcomes, quality).collect()}
    assert [out[t, "x"].status for t in range(1, 6)] == ["scored", "nonpositive_target", "few_bars", "outcome_unavailable", "no_quality_metadata"]
    assert abs(out[1, "x"].qlike - (2 - math.log(2) - 1)) < 1e-12 and out[2, "x"].qlike is None and out[3, "x"].log_mse is not None
    assert [out[t, "x"].comparison_eligible for t in range(1, 6)] == [True, False, False, False, False]


def test_hac_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=80).cumsum() * 0.1
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)] + [("s", 0, 1.0), ("s", 1, 2.0), ("o", 0, 1.0)], "g string, target_no int, x double")
    out = {(r.g, r.lag): r for r in scoring.hac(df, [5, 20], ["g"]).collect()}

    def se(x, lag):
        c, n = x - x.mean(), len(x)
        lag = min(lag, n - 1)
        v = c @ c / n + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lag + 1))
        return math.sqrt(max(v / n, 0))

    for lag in (5, 20):
        assert abs(out["g", lag].se - se(x, lag)) < 1e-12
        assert abs(out["s", lag].se - se(np.array([1.0, 2.0]), lag)) < 1e-12 and out["o", lag].se is None


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, None, 0.005]
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(p)], "id int, g string, p double")
    h = {r.id: r.holm for r in scoring.holm(df, "g").collect()}
    b = {r.id: r.bh for r in scoring.benjamini_hochberg(df, "g").collect()}
    assert [h[i] for i in range(5)] == pytest.approx([0.03, 0.06, 0.06, None, 0.02])
    assert [b[i] for i in range(5)] == pytest.approx([0.02, 0.04, 0.04, None, 0.02])


def test_moments_agree_with_rows(spark):
    panel = level_panel(spark, n=120)
    members = ["AF", "AO", "NF", "NO", "RF", "RO"]
    wide = moments.wide(panel, ["session_no"], members, "y")
    m = moments.gram(wide, [], members).first()
    x = wide.orderBy("session_no").toPandas()[members].to_numpy()
    assert m.n == 120 and np.allclose(m.g, x.T @ x) and np.allclose(m.s, x.sum(0))
    fit = {r.symbol: r for r in moments.betas(wide, members[2:], members[:2]).collect()}
    direct = np.linalg.lstsq(np.column_stack([np.ones(120), x[:, :2]]), x[:, 2:], rcond=None)[0]
    for j, s in enumerate(members[2:]):
        assert np.allclose([fit[s].alpha, fit[s].beta1, fit[s].beta2], direct[:, j])
    d = moments.residual_diagnostics(moments.residuals(wide, moments.betas(wide, members[2:], members[:2]), members[2:], members[:2], ["session_no"])).collect()
    assert all(r.abs_residual_mean == 0 and r.abs_corr_x1 == 0 for r in d)


def test_bootstrap_moments_equal_resampled_rows():
    rng = np.random.default_rng(5)
    parts = [rng.normal(size=(rng.integers(3, 9), 4)) for _ in range(20)]
    draw = rng.integers(0, 20, 20)
    x = np.concatenate([parts[i] for i in draw])
    w = np.bincount(draw, minlength=20)
    from gridloom.functions import linalg

    cov = linalg.from_moments(sum(k * len(p) for k, p in zip(w, parts)), sum(k * p.sum(0) for k, p in zip(w, parts)), sum(k * p.T @ p for k, p in zip(w, parts)))[1]
    assert np.allclose(cov, np.cov(x, rowvar=False))


def test_causal_residuals_are_orthogonal_to_the_common_part(spark):
    members = ["AF", "AO", "NF", "NO", "RF", "RO"]
    wide = moments.wide(level_panel(spark, n=200), ["session_no"], members, "y")
    d = days_of(spark, 200)
    w = windows.rolling(d, 60, 20)
    gram = moments.gram(windows.sessions_of(w, d).select("window_no", "session_no").join(wide, "session_no"), ["window_no"], members)
    blocks = windows.assignment(windows.score_blocks(w, d), d)
    out = factors.apply_causal(wide, blocks, factors.causal_fits(gram, members, 1), members[:2], members[2:])
    assert out.filter("abs(residual - adjusted - common) > 1e-9").count() == 0 and out.count() == 140 * 4
    assert blocks.filter("causal").count() == 140 and blocks.filter("session_no <= 60 and causal").count() == 0


def test_network_rollups_on_a_known_history(spark):
    rows = [(o, "a", "b", h, c, c != 0) for o, h, c in [(1, "D", 0.5), (1, "W", 0.0), (2, "D", 0.3), (2, "W", -0.2), (3, "D", 0.0), (3, "W", 0.0)]]
    edges = spark.createDataFrame(rows, "origin int, source string, target string, horizon string, coefficient double, selected boolean")
    r = network.stability(edges).first()
    assert abs(r.selection_probability - 2 / 3) < 1e-5 and abs(r.sign_consistency - 2 / 3) < 1e-5 and r.support_jaccard == 0.25
    assert (r.median_coefficient, r.first_selection, r.last_selection, r.stable_edge) == (0.3, 1, 2, False)
    c = {x.symbol: x for x in network.centrality(network.stability(edges)).collect()}
    assert c["a"].incoming_strength == 0 and c["b"].outgoing_stable_edges == 0
    g = network.connectivity(network.stability(edges), spark.createDataFrame([("g", "a"), ("h", "b"), ("h", "c")], "group string, symbol string"))
    assert {(x.source_group, x.target_group): x.possible_directed_edges for x in g.collect()} == {("g", "g"): 0, ("g", "h"): 2, ("h", "g"): 2, ("h", "h"): 2}


def test_majority_regime_ties(spark):
    rows = [(0, 1, day(0), "a"), (0, 2, day(1), "b"), (1, 1, day(0), "b"), (1, 2, day(1), "c"), (1, 3, day(2), "b"), (2, 1, day(80), "a")]
    out = {r.window_no: r for r in windows.regimes(spark.createDataFrame(rows, "window_no int, session_no int, day date, regime string")).collect()}
    assert [out[i].majority for i in range(3)] == ["b", "b", "a"] and [out[i].mixed for i in range(3)] == [True, True, False]
    assert out[2].quarterly and not out[0].quarterly


def test_required_columns_and_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "a int, b double")
    assert panels.no_nan(df).filter("b is null").count() == 1
    assert panels.require(df, "b", "a").columns == ["b", "a"]
    with pytest.raises(ValueError):
        panels.require(df, "c")


def test_ledgers(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([("a", 1, 2.0)], "symbol string, target_no int, forecast double")
    for spec in ("x", "y", "x"):
        ledgers.append_ledger(rows, path, "r1", spec)
    assert ledgers.read_ledger(spark, path, "r1").count() == 2 and ledgers.read_ledger(spark, path, "r1", "x").count() == 1
    assert ledgers.violations(rows, ["symbol", "target_no"], ["forecast"]) == {}
    bad = rows.unionByName(rows).withColumn("outcome", F.lit(1.0)).withColumn("forecast", F.lit(-1.0))
    assert set(ledgers.violations(bad, ["symbol", "target_no"], ["model"])) == {"missing:model", "forbidden:outcome", "repeated_keys", "nonpositive_forecasts"}
    twice = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0 + 1e-12), ("b", 1, 1.0), ("b", 2, 1.1)], "k string, at int, v double")
    last, conflicts = ledgers.canonical(twice, ["k"], ["v"], "at")
    assert sorted((r.k, r.at) for r in last.collect()) == [("a", 2), ("b", 2)] and [r.k for r in conflicts.collect()] == ["b"]
    doc = ledgers.manifest({"w": 60}, {"rows": rows})
    ledgers.write_json(spark, doc, f"{path}.json")
    assert ledgers.read_json(spark, f"{path}.json") == doc and ledgers.may_resume(doc, {"w": 60}) and not ledgers.may_resume(doc, {"w": 61})
    assert ledgers.frame_hash(twice) == ledgers.frame_hash(twice.repartition(3).orderBy("v"))
    ledgers.write_csv(twice, f"{path}.csv")
    assert ledgers.read_csv(spark, f"{path}.csv", "k string, at int, v double").count() == 4
    assert "a\\|b" in ledgers.markdown(spark.createDataFrame([("a|b", None)], "x string, y double"))


def test_months_and_retries(spark, tmp_path):
    path = f"file://{tmp_path}/months"
    bars = spark.createDataFrame([(day(0), 1, "a", 1.0), (day(0), 1, "b", 1.0), (day(40), 1, "a", 1.0)], "session date, bar int, symbol string, close double")
    ledgers.write_months(bars, path)
    ledgers.write_months(bars.filter("symbol = 'a'"), path)
    assert ledgers.consolidated(spark, path).count() == 3
    assert [(r.month, r.lacking) for r in ledgers.incomplete_months(spark, path, ["a", "b"]).collect()] == [("2024-02", ["b"])]
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 4:
            raise OSError
        return 7

    assert ledgers.retried(flaky, sleep=waits.append) == 7 and waits == [1, 2, 4]
    labels = [(r.label, r.start, r.end) for r in grid.month_partitions(spark, "2024-01-15", "2024-03-01").orderBy("label").collect()]
    assert labels == [("2024-01", dt.date(2024, 1, 15), dt.date(2024, 2, 1)), ("2024-02", dt.date(2024, 2, 1), dt.date(2024, 3, 1))]


def test_stream_issues_each_forecast_once(spark, tmp_path):
    panel = level_panel(spark, n=90).drop("level")
    incoming, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "ledger", "state"))
    panel.filter("session_no <= 80").coalesce(1).write.parquet(incoming)
    prospective.run(spark, incoming, out, state, 60)
    for n in range(81, 84):
        panel.filter(F.col("session_no") == n).coalesce(1).write.mode("append").parquet(incoming)
        prospective.run(spark, incoming, out, state, 60)
    got = spark.read.parquet(out)
    assert got.groupBy("symbol", "origin_no", "model").count().filter("count > 1").count() == 0
    assert got.agg(F.min("target_no"), F.max("target_no")).first() == (61, 84)
    batch = har.ledger(har.features(panel.filter("session_no <= 84"))).filter("origin_no between 60 and 82").select("symbol", "origin_no", "model", F.col("forecast").alias("f"))
    assert got.join(batch, ["symbol", "origin_no", "model"]).filter("abs(forecast - f) > 1e-9").count() == 0


def test_csv_keeps_nulls_and_quotes(spark, tmp_path):
    from gridloom.sources import ledgers

    rows = [(1, "plain"), (2, None), (3, ""), (4, 'a "quoted", comma'), (5, "back\\slash")]
    ledgers.write_csv(spark.createDataFrame(rows, "k bigint, v string"), f"{tmp_path}/c")
    assert sorted(map(tuple, ledgers.read_csv(spark, f"{tmp_path}/c", "k bigint, v string").collect())) == rows


def test_violation_rows_of_an_empty_ledger(spark):
    from gridloom.sources import ledgers

    none = spark.createDataFrame([], "k bigint, forecast double")
    assert ledgers.violation_rows(none, ["k"], ["forecast"]).collect() == []
    null = spark.createDataFrame([(1, None)], "k bigint, forecast double")
    assert ledgers.violations(null, ["k"], ["forecast", "model"]) == {"missing:model": 1, "nonpositive_forecasts": 1}


def test_p_values_by_batches(spark):
    from gridloom.functions import linalg
    from gridloom.operators import scoring

    rows = spark.createDataFrame([(0, 0.0), (1, -1.96), (2, None), (3, 12.0)], "k int, z double")
    assert [r["p"] for r in rows.withColumn("p", scoring.two_sided("z")).orderBy("k").collect()] == [1.0, linalg.two_sided(-1.96), None, linalg.two_sided(12.0)]
