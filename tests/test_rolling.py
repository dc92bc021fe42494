"""Rolling components, alignment and resumed issuance against plain numpy and uninterrupted runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import lasso
from gridloom.operators import har, issuance, rolling, summaries, tasks, windows
from gridloom.plans import QUERIES

SF = "/root/testdata/sf0.01"
MEMBERS = ["A", "B", "p", "q", "r", "s"]


def panel(spark, n=50, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, 6))
    scaled = x / np.array([1.0, 2, 3, 1, 2, 3])
    table = lambda m: spark.createDataFrame([(i + 1, *map(float, r)) for i, r in enumerate(m)], "session_no int, " + ", ".join(f"{c} double" for c in MEMBERS))
    return x, scaled, table(x), table(scaled)


def spans(spark, n, width, step):
    days = spark.range(1, n + 1).select(F.col("id").cast("int").alias("session_no"))
    return windows.rolling(days, width, step).withColumn("width", F.lit(width))


def test_components_of_every_width_and_view_equal_numpy(spark):
    x, scaled, raw, normalized = panel(spark)
    both = [*MEMBERS, *(f"n_{m}" for m in MEMBERS)]
    spread = spans(spark, 50, 20, 7).unionByName(spans(spark, 50, 30, 7))
    got = rolling.components(rolling.window_moments(rolling.paired(raw, normalized, MEMBERS), spread, both), MEMBERS).collect()
    assert {(r.width, r.start_no) for r in got} == {(20, s) for s in (1, 8, 15, 22, 29, 31)} | {(30, s) for s in (1, 8, 15, 21)}
    assert len(got) == 10 * 6 and all(r.status == "fitted" for r in got)
    first = {}
    for r in sorted(got, key=lambda r: (r.width, r.window_no)):
        part, norm = x[r.start_no - 1 : r.end_no], scaled[r.start_no - 1 : r.end_no]
        design = np.column_stack([np.ones(len(part)), part[:, :2]])
        residual = part[:, 2:] - design @ np.linalg.lstsq(design, part[:, 2:], rcond=None)[0]
        data = {"raw": part[:, 2:], "normalized": norm[:, 2:], "residual": residual}[r.view]
        matrix = np.cov(data, rowvar=False) if r.method == "covariance" else np.corrcoef(data, rowvar=False)
        w, v = np.linalg.eigh(matrix)
        assert np.allclose([r.eigenvalue_1, r.eigenvalue_2, r.eigenvalue_3], w[::-1][:3])
        assert np.isclose(r.effective_dimension, w.sum() ** 2 / (w**2).sum()) and np.isclose(r.explained_first_3, 100 * w[1:].sum() / w.sum())
        key = (r.width, r.view, r.method)
        assert (r.similarity is None) == (key not in first)
        if key in first:
            assert np.isclose(r.similarity, abs(first[key] @ v[:, -1]))
        first[key] = v[:, -1]
        if r.view == "residual":
            assert np.isclose(r.benchmark_removed_pct, (100 * (1 - residual.var(0) / part[:, 2:].var(0))).mean()) and r.max_abs_residual_corr < 1e-7


def test_windows_that_cannot_be_fitted_say_why(spark):
    _, _, raw, normalized = panel(spark, 20)
    rows = rolling.paired(raw, normalized, MEMBERS).filter("session_no <= 12").withColumn("q", F.when(F.col("session_no") > 10, F.col("q")).otherwise(1.0))
    both = [*MEMBERS, *(f"n_{m}" for m in MEMBERS)]
    got = rolling.components(rolling.window_moments(rows, spans(spark, 20, 10, 5), both), MEMBERS).collect()
    assert {(r.window_no, r.n_rows, r.status) for r in got} == {(0, 10, "constant_column"), (1, 7, "too_few_rows"), (2, 2, "too_few_rows")}
    assert len(got) == 18 and all(r.eigenvalue_1 is None and r.similarity is None for r in got)
    none = rolling.components(rolling.window_moments(rows.filter("false"), spans(spark, 20, 10, 5), both), MEMBERS)
    assert {(r.n_rows, r.status) for r in none.collect()} == {(0, "too_few_rows")}


def test_panels_of_different_sessions_are_refused(spark):
    _, _, raw, normalized = panel(spark, 10)
    with pytest.raises(Exception, match="different sessions"):
        rolling.paired(raw, normalized.filter("session_no <> 4"), MEMBERS).collect()


def fitted(spark, base, order, signs, window_no=0):
    m = base[:, order] * signs
    return [("s", window_no, m.T.tolist(), 1.0)], spark.createDataFrame([(base.T.tolist(),)], "reference array<array<double>>")


def test_whole_sample_alignment_undoes_order_and_sign(spark):
    base = np.random.default_rng(0).normal(size=(9, 3))
    rows, reference = fitted(spark, base, [2, 0, 1], [1, -1, -1])
    got = rolling.against_whole_sample(spark.createDataFrame(rows, "spec string, window_no bigint, loadings array<array<double>>, condition double"), reference).orderBy("factor").collect()
    assert [(r.source_factor, r.sign) for r in got] == [("LF2", -1), ("LF3", -1), ("LF1", 1)]
    assert all(np.isclose(r.cosine, 1) and r.jaccard == 1 for r in got) and np.allclose(np.array([r.loadings for r in got]).T, base)


def test_states_follow_their_factors(spark):
    base = np.random.default_rng(1).normal(size=(9, 2))
    cov = np.array([[4.0, 1.0], [1.0, 9.0]])
    schema = "window_no bigint, loadings array<array<double>>, state array<double>, state_cov array<array<double>>, projector_error double"
    rows = [(0, base.T.tolist(), [1.0, 5.0], cov.tolist(), 0.0), (1, [(-base[:, 1]).tolist(), base[:, 0].tolist()], [-5.0, 1.0], [[9.0, -1.0], [-1.0, 4.0]], 0.0)]
    reference = spark.createDataFrame([(base.T.tolist(),)], "reference array<array<double>>")
    got = {(r.window_no, r.factor): r for r in rolling.kalman_stability(spark.createDataFrame(rows, schema), reference).collect()}
    for factor, state, sd in (("LF1", 1.0, 2.0), ("LF2", 5.0, 3.0)):
        a, b = got[0, factor], got[1, factor]
        assert (a.state, a.state_sd, a.previous_cosine, a.turnover, a.noisy) == (state, sd, None, None, False)
        assert (b.state, b.state_sd, b.noisy) == (state, sd, False) and np.isclose(b.previous_cosine, 1) and abs(b.turnover) < 1e-12 and np.isclose(b.state_high - b.state, 1.96 * sd)


def test_causal_factors_against_the_block_before(spark):
    base = np.random.default_rng(2).normal(size=(9, 2))
    rows = [("c", k, (base[:, ::-1] * [1, -1] if k == 1 else base).T.tolist(), 1.0) for k in range(3)]
    fits = spark.createDataFrame(rows, "spec string, window_no bigint, loadings array<array<double>>, condition double")
    w = spans(spark, 30, 20, 5).drop("width")
    days = spark.range(1, 31).select(F.col("id").cast("int").alias("session_no"))
    got = rolling.causal_stability(fits, windows.score_blocks(w, days)).collect()
    assert {r.block_no for r in got} == {0, 1}  # the last window scores nothing
    assert all(r.cosine is None for r in got if r.block_no == 0)
    assert all(np.isclose(r.cosine, 1) and r.jaccard == 1 and abs(r.turnover) < 1e-12 for r in got if r.block_no == 1)


def test_networks_of_three_controls_and_two_windows(spark):
    got = QUERIES["descriptive_networks"](spark, SF).groupBy("control", "factor_window").agg(F.countDistinct("edge_id").alias("n")).collect()
    assert {(r.control, r.factor_window) for r in got} == {(c, w) for c in ("raw", "benchmark_residual", "factor_adjusted") for w in ("60", "120")}
    assert all(r.n == 12 for r in got)


def har_rows(spark, sessions, n=120, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, 2)).cumsum(0) * 0.1 + rng.normal(size=(n, 2))
    data = [(i + 1, s, float(y[i, k])) for i in range(sessions) for k, s in enumerate(("a", "b"))]
    p = spark.createDataFrame(data, "session_no int, symbol string, y double").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("session_no")))
    return issuance.blocks(har.features(p), ["a", "b"], 20)


def test_resumed_issuance_equals_an_uninterrupted_one(spark, tmp_path):
    symbols, path = ["a", "b"], f"file://{tmp_path}/ledger"
    whole = {(r.symbol, r.origin_no, r.model): r for r in issuance.forecasts(har_rows(spark, 120), symbols, 20).collect()}
    early = issuance.resumed(har_rows(spark, 95), symbols, 20, path).count()
    assert 0 < early < len(whole)
    for _ in range(2):  # a call that has nothing to add changes nothing
        rows = issuance.resumed(har_rows(spark, 120), symbols, 20, path).collect()
        assert len(rows) == len(whole)
        for r in rows:
            a = whole[r.symbol, r.origin_no, r.model]
            assert (r.target_no, r.n_train, r.tuning_block, r.n_selected, r.tuning_status) == (a.target_no, a.n_train, a.tuning_block, a.n_selected, a.tuning_status)
            assert np.allclose([r.log_forecast, r.forecast, r.penalty], [a.log_forecast, a.forecast, a.penalty], rtol=1e-12)
    with pytest.raises(ValueError, match="configuration"):
        issuance.resumed(har_rows(spark, 120), symbols, 10, path)
    with pytest.raises(ValueError, match="changed"):
        issuance.resumed(har_rows(spark, 120, seed=6), symbols, 20, path)
    assert issuance.resumed(har_rows(spark, 20), symbols, 20, f"{path}-empty").count() == 0


def test_checkpoint_networks_from_one_history(spark):
    """Checkpoints fitted along a history equal fits of each checkpoint's rows, and rows are copied no more where there are more checkpoints."""
    symbols = ["a", "b"]
    blocks = har_rows(spark, 120)
    edges = {(r.target, r.checkpoint, r.source, r.horizon): r for r in summaries.checkpoint_edges(blocks, symbols, every=7, least=30).collect()}
    rows = blocks.filter("response is not null").toPandas().sort_values("session_no")
    seen = set()
    for i, target in enumerate(symbols):
        part = rows[rows["symbol"] == target]
        for checkpoint in [*range(7, part["row_no"].max(), 7), part["row_no"].max()]:
            p = part[part["row_no"] <= checkpoint]
            if len(p) < 30:
                continue
            terms, y = np.array(p["terms"].tolist()), p["response"].to_numpy()
            own, cross = terms[:, 3 * i : 3 * i + 3], np.delete(terms, np.s_[3 * i : 3 * i + 3], 1)
            fit = lasso.path(lasso.Sample.of(own, cross, y), [lasso.tune(own, cross, y)["one_se"]])[0]
            for t, b in zip("DWM", fit["cross"]):
                got = edges[target, checkpoint, symbols[1 - i], t]
                assert abs(got.coefficient - b) < 1e-4 and got.selected == bool(got.coefficient != 0)
                seen.add((target, checkpoint, symbols[1 - i], t))
    assert seen == set(edges)
    copies = tasks.sliced(blocks, "symbol", groups=2)
    n = copies.first()["slices"]
    assert copies.count() == n * blocks.count() and copies.select("slice").distinct().count() == n


def test_forecasts_from_one_history(spark):
    """Origins fitted as a stack along a history equal fits of each origin's own rows."""
    symbols, blocks = ["a", "b"], har_rows(spark, 120).withColumn("f_d", F.sin(F.col("session_no") * 1.7))
    got = {(r.symbol, r.origin_no, r.model): r for r in issuance.forecasts(blocks, symbols, 20, ["f_d"], ["f_d"]).collect()}
    rows, n = blocks.toPandas().sort_values("session_no"), 0
    for i, symbol in enumerate(symbols):
        p = rows[rows["symbol"] == symbol]
        terms, y, sessions, targets, f = np.array(p["terms"].tolist()), p["response"].to_numpy(), p["session_no"].to_numpy(), p["target_no"].to_numpy(), p[["f_d"]].to_numpy()
        own, cross, head, none = terms[:, 3 * i : 3 * i + 3], np.delete(terms, np.s_[3 * i : 3 * i + 3], 1), None, np.zeros((len(p), 0))
        for at in range(len(p)):
            a = np.flatnonzero(np.isfinite(y) & (targets <= sessions[at]))
            if len(a) < issuance.LEAST:
                continue
            block = p["block"].iloc[at]
            if head is None or head[0] != block:
                head = block, lasso.tune(own[a], cross[a], y[a]), lasso.tune(np.column_stack([own, f])[a], cross[a], y[a])
            for model, o, c, alpha in (("own_har", own, none, 0.0), ("network_1se", own, cross, head[1]["one_se"]), ("network_min", own, cross, head[1]["min"]), ("local_har", np.column_stack([own, f]), none, 0.0), ("aggregate_har", np.column_stack([own, f]), none, 0.0), ("hybrid_har", np.column_stack([own, f]), cross, head[2]["one_se"])):
                fit, r = lasso.path(lasso.Sample.of(o[a], c[a], y[a]), [alpha])[0], got[symbol, sessions[at], model]
                log_forecast = float(lasso.predict(fit, o[at : at + 1], c[at : at + 1])[0])
                assert r.n_train == len(a) and r.tuning_block == block and np.isclose(r.penalty, alpha, atol=1e-9)
                assert np.isclose(r.log_forecast, log_forecast, atol=1e-4) and np.isclose(r.forecast, lasso.level(log_forecast, lasso.smearing(fit, o[a], c[a], y[a])), rtol=2e-4)
                n += 1
    assert n > 100 and len(got) == n + n // 6


def test_edge_bootstrap_draws_of_the_longest_target(spark):
    """A circular draw is as long as the most rows that any target has at the checkpoint, which leaves out rows that the last one doesn't know."""
    blocks = har_rows(spark, 120).filter("symbol = 'a' or session_no not in (60, 70)")
    got = {(r.checkpoint, r.target, r.horizon): r for r in issuance.edge_bootstrap(blocks, ["a", "b"], 9, 5, 3, True, 0.05, 40, 13).collect()}
    rows, n = blocks.filter("response is not null").toPandas().sort_values("session_no"), 0
    last = int(blocks.agg(F.max("session_no")).first()[0]) - 22
    for checkpoint in [*range(40, last, 13), last]:
        known = rows[rows["session_no"] - 22 < checkpoint]
        for i, target in enumerate("ab"):
            p = known[known["symbol"] == target]
            if len(p) < 40:
                continue
            terms, y = np.array(p["terms"].tolist()), p["response"].to_numpy()
            own, cross = terms[:, 3 * i : 3 * i + 3], np.delete(terms, np.s_[3 * i : 3 * i + 3], 1)
            penalty, b = 0.05 * lasso.top_penalty(lasso.Sample.of(own, cross, y)), []
            for rep in range(9):
                draw = lasso.block_draw(np.random.default_rng([3, checkpoint, rep]), known.groupby("symbol").size().max(), 5, True) % len(y)
                b.append(lasso.path(lasso.Sample.of(own[draw], cross[draw], y[draw]), [penalty])[0]["cross"])
            for t, median in zip("DWM", np.median(b, 0)):
                r = got[checkpoint, target, t]
                assert r.n_train == len(y) and np.isclose(r.penalty, penalty) and np.isclose(r.median_coefficient, median, atol=1e-3)
                n += 1
    assert n == len(got) > 0
