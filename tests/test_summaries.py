"""Rollups over fits: identities and known histories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import scoring, summaries
from gridloom.plans import QUERIES
from gridloom.plans.panel_queries import realized, scored

SF = "/root/testdata/sf0.01"


def test_ledger_adds_to_one_hundred(spark):
    rows = QUERIES["variance_ledger_components"](spark, SF).collect()
    assert len(rows) == 4 and all(abs(r.total_pct - 100) < 1e-8 for r in rows)
    shares = {r.part: r.share_of_raw_pct for r in QUERIES["global_variance_shares"](spark, SF).collect()}
    assert abs(sum(shares.values()) - 100) < 1e-8


def test_vintage_of_raw_returns_is_realized_variance(spark):
    v = QUERIES["variance_vintages"](spark, SF)
    raw = v.filter("control = 'raw'")
    days = v.sparkSession.read.parquet(f"{SF}/events.parquet").select(F.to_date("ts").alias("session")).distinct().orderBy("session").collect()
    number = {r.session: i + 1 for i, r in enumerate(days)}
    direct = {(number[r.session], r.symbol): r.rv for r in realized(spark, SF).collect()}
    rows = raw.collect()
    assert rows and all(abs(direct[r.session_no, r.symbol] - r.rv) < 1e-9 for r in rows)
    assert {r.control for r in v.select("control").distinct().collect()} == {"raw", "benchmark_residual", "factor_adjusted", "common"}


def test_concentration_and_recurrence(spark):
    rows = [(w, "LF1", s, x) for w in range(5) for s, x in (("a", 3.0 if w else 1.0), ("b", 1.0), ("c", -1.0))]
    g = summaries.concentration(spark.createDataFrame(rows, "window_no int, factor string, symbol string, loading double"), {"g": ["a"]}, ["a", "b", "c"])
    c = summaries.candidates(g, {"g": 0.5}).first()
    assert (c.median_share, c.median_density_ratio, c.recurrence_rate, c.recurring) == (0.6, 3.0, 0.8, True)
    s = summaries.stress(g, "g", 0, 0).first()
    assert (s.n_inside, s.n_outside, s.stronger) == (1, 4, False) and s.difference == pytest.approx(1 / 3 - 0.6)


def test_empty_period_says_so(spark):
    none = scoring.period(scored(spark, SF), "never", "1950-01-01", "1950-01-02").collect()
    assert len(none) == 1 and none[0].available is False and none[0].qlike is None


def test_sensitivity_labels(spark):
    schema = "window_no int, unstable boolean, anchor_cosine double"
    a = spark.createDataFrame([(0, True, 0.5), (0, False, 0.9), (1, False, 0.9), (2, True, 0.1)], schema)
    b = spark.createDataFrame([(0, True, 0.4), (1, True, 0.7)], schema)
    got = {r.window_no: r.candidate_type for r in summaries.compared(a, b).collect()}
    assert got == {0: "persistent", 1: "sensitivity", 2: "persistent"}


def test_windows_and_bootstrap_rollups(spark):
    out = QUERIES["rolling_pca_summary"](spark, SF).collect()
    assert len(out) == 12 and all(1 <= r.min_effective_dimension <= r.max_effective_dimension <= 4 for r in out)
    b = QUERIES["session_bootstrap_summary"](spark, SF).collect()
    assert len(b) == 3 and all(r.n == 100 and r.cosine_5pct <= r.cosine_median for r in b)
    assert np.isfinite([r.median_holdout_mse for r in QUERIES["method_comparison"](spark, SF).collect()]).all()


def test_declared_pairs_are_tested_and_adjusted(spark):
    rows = QUERIES["factor_comparisons"](spark, SF).collect()
    assert len(rows) == 12 and {r.lag for r in rows} == {5, 20}
    assert all(0 <= r.p_value <= r.holm <= 1 and r.n > 100 for r in rows)
    by_lag = sorted((r.p_value, r.holm) for r in rows if r.lag == 5)
    assert [h for _, h in by_lag] == sorted(h for _, h in by_lag)


def test_rolling_fits_step_by_five_sessions(spark):
    from gridloom.plans import model_queries as models

    last = models.days(spark, SF).count()
    assert models.by_window(spark, SF).select("window_no").distinct().count() == len({*range(1, last - 58, 5), last - 59})
