"""Rollups over fits: variance ledgers, rolling diagnostics, regimes, group concentration, comparisons, vintages."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import lasso, linalg
from gridloom.operators.factors import covariance_of, fit_rows
from gridloom.operators.tasks import sliced


def component_ledger(moments: DataFrame, members: list[str], skip: int = 2) -> DataFrame:
    """Variance of every stock in per cent: benchmarks, then residual components 1, 2 to 3, and the rest; they add to 100.

    Component j of the residual covariance contributes its eigenvalue times the squared weight.
    """

    def fit(row: dict) -> list[dict]:
        cov = covariance_of(row)
        y = list(range(skip, len(members)))
        _, rest = linalg.residual_covariance(cov, list(range(skip)), y)
        w, v = linalg.principal(rest)
        raw, part = np.diag(cov)[y], v**2 * w
        out = []
        for i, s in enumerate(members[skip:]):
            pct = 100 * part[i] / raw[i]
            bench = 100 * (raw[i] - rest[i, i]) / raw[i]
            out.append({"symbol": s, "raw_variance": raw[i], "benchmark_pct": bench, "pc1_pct": pct[0], "pc2_3_pct": pct[1:3].sum(), "pc4_pct": pct[3:].sum(), "total_pct": bench + pct.sum()})
        return out

    return fit_rows(moments, fit, "symbol string, raw_variance double, benchmark_pct double, pc1_pct double, pc2_3_pct double, pc4_pct double, total_pct double")


def global_shares(ledger: DataFrame) -> DataFrame:
    """The ledger's parts over all stocks, in per cent of all variance."""
    parts = ("benchmark_pct", "pc1_pct", "pc2_3_pct", "pc4_pct")
    sums = ledger.agg(F.sum("raw_variance").alias("raw"), *(F.sum(F.col(p) / 100 * F.col("raw_variance")).alias(p) for p in parts))
    return sums.select("raw", F.explode(F.array(*(F.struct(F.lit(p[:-4]).alias("part"), F.col(p).alias("variance")) for p in parts))).alias("x")).select("x.part", "x.variance", (100 * F.col("x.variance") / F.col("raw")).alias("share_of_raw_pct"))


def rolling_summary(rolling: DataFrame) -> DataFrame:
    """Mean, least and largest explained share, effective dimension and likeness to the window before, by width, view and method."""
    stats = [f(c).alias(f"{n}_{c}") for c in ("explained_1", "explained_first_3", "effective_dimension", "similarity") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return rolling.groupBy("width", "view", "method").agg(F.count(F.lit(1)).alias("n_windows"), F.count("explained_1").alias("n_fitted"), *stats)


def sparse_rollup(path: DataFrame) -> DataFrame:
    return path.groupBy("kind", "l1").agg(F.max("nonzero").alias("nonzero"), F.max("explained_pct").alias("explained_pct"), F.max("rounds").alias("rounds"))


def bootstrap_summary(draws: DataFrame) -> DataFrame:
    q = F.percentile("cosine", F.array(F.lit(0.05), F.lit(0.5)))
    g = draws.groupBy("factor").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.avg("jaccard").alias("mean_jaccard"), F.avg(F.col("local").cast("double")).alias("local_rate"))
    return g.select("factor", "n", F.col("q")[0].alias("cosine_5pct"), F.col("q")[1].alias("cosine_median"), "mean_jaccard", "local_rate")


def window_diagnostics(stability: DataFrame, windows: DataFrame) -> DataFrame:
    """One row a window: likeness to its anchor, local factors and flags over its factors."""
    g = stability.groupBy("spec", "window_no").agg(
        F.avg("anchor_cosine").alias("mean_anchor_cosine"), F.min("anchor_cosine").alias("min_anchor_cosine"), F.avg("jaccard").alias("mean_jaccard"), F.min("jaccard").alias("min_jaccard"),
        F.sum(F.col("local").cast("int")).alias("n_local"), F.sum(F.col("unstable").cast("int")).alias("n_unstable"), F.bool_or("unstable").alias("candidate"),
    )
    return g.join(windows, "window_no", "left")


def regime_summary(stability: DataFrame, labels: DataFrame) -> DataFrame:
    j = stability.join(labels.select("window_no", "majority", "mixed"), "window_no")
    return j.groupBy("spec", F.col("majority").alias("regime"), "factor").agg(
        F.countDistinct("window_no").alias("n_windows"), F.sum(F.col("mixed").cast("int")).alias("n_mixed"), F.avg("previous_cosine").alias("mean_previous_cosine"), F.avg("anchor_cosine").alias("mean_anchor_cosine"), F.min("anchor_cosine").alias("min_anchor_cosine"),
        F.avg("jaccard").alias("mean_jaccard"), F.avg("n_small").alias("mean_small"), F.avg(F.col("local").cast("double")).alias("local_rate"), F.sum(F.col("unstable").cast("int")).alias("n_unstable"),
    )


def compared(primary: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """Windows under two numbers of starts: whether the refit calls the same ones unstable; columns of the refit end in _sensitivity."""
    own = primary.groupBy("window_no").agg(F.bool_or("unstable").alias("unstable"), F.min("anchor_cosine").alias("min_cosine"))
    other = sensitivity.groupBy("window_no").agg(F.bool_or("unstable").alias("unstable_sensitivity"), F.min("anchor_cosine").alias("min_cosine_sensitivity"))
    j = own.join(other, "window_no", "left")
    same = F.coalesce(F.col("unstable") == F.col("unstable_sensitivity"), F.lit(True))
    kind = F.when(F.col("unstable") & ~same, "persistent_and_sensitivity").when(F.col("unstable"), "persistent").when(~same, "sensitivity").otherwise("none")
    return j.withColumn("agrees", same).withColumn("candidate_type", kind)


def concentration(loadings: DataFrame, groups: dict[str, list[str]], members: list[str]) -> DataFrame:
    """Share of absolute loadings inside a group and the ratio of mean loadings inside and outside, by window and factor."""
    a = loadings.withColumn("absolute", F.abs("loading"))
    out = []
    for name, inside in groups.items():
        here, there = F.when(F.col("symbol").isin(inside), F.col("absolute")), F.when(~F.col("symbol").isin(inside), F.col("absolute"))
        g = a.groupBy("window_no", "factor").agg((F.sum(here) / F.sum("absolute")).alias("share"), (F.avg(here) / F.greatest(F.avg(there), F.lit(1e-12))).alias("density_ratio"))
        out.append(g.withColumn("group", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def candidates(groups: DataFrame, least: dict[str, float], density: float = 1.5, rate: float = 0.60) -> DataFrame:
    """Groups that a factor keeps coming back to: the share of windows in which both limits are met."""
    limit = reduce(lambda acc, kv: acc.when(F.col("group") == kv[0], kv[1]), least.items(), F.when(F.lit(False), 0.0))
    hit = ((F.col("share") >= limit) & (F.col("density_ratio") >= density)).cast("double")
    g = groups.groupBy("factor", "group").agg(F.median("share").alias("median_share"), F.median("density_ratio").alias("median_density_ratio"), F.avg(hit).alias("recurrence_rate"))
    return g.withColumn("recurring", F.col("recurrence_rate") >= rate)


def stress(groups: DataFrame, group: str, first: int, last: int) -> DataFrame:
    """A group's median share inside and outside a span of windows."""
    inside = F.col("window_no").between(first, last)
    g = groups.filter(F.col("group") == group).groupBy("factor").agg(F.sum(inside.cast("int")).alias("n_inside"), F.sum((~inside).cast("int")).alias("n_outside"), F.median(F.when(inside, F.col("share"))).alias("inside"), F.median(F.when(~inside, F.col("share"))).alias("outside"))
    return g.withColumn("difference", F.col("inside") - F.col("outside")).withColumn("stronger", F.coalesce(F.col("inside") > F.col("outside"), F.lit(False)))


def importance(loadings: DataFrame, most: int) -> DataFrame:
    """The `most` symbols of a factor with the largest mean absolute loading; ties by symbol."""
    mean = loadings.groupBy("factor", "symbol").agg(F.avg(F.abs("loading")).alias("importance"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("importance"), "symbol"))).filter(F.col("rank") <= most)


def methods(kalman: DataFrame) -> DataFrame:
    """Static, filtered and one-step reconstructions over all windows."""
    one = lambda name, c, train: kalman.agg(F.lit(name).alias("method"), F.count(F.lit(1)).alias("n_windows"), F.median(c).alias("median_holdout_mse"), F.avg(100 * (1 - F.col(train))).alias("mean_train_explained_pct"), F.max("worst_condition").alias("worst_condition"))
    return one("static", "static_mse", "static_train_mse").unionByName(one("filtered", "filtered_mse", "smoothed_train_mse")).unionByName(one("one_step", "one_step_mse", "smoothed_train_mse"))


def bin_moments(bars: DataFrame, bins: DataFrame, calendar: DataFrame, members: list[str], value: str, interval: int) -> DataFrame:
    """session, m: the sum over valid intervals of v v', v being the interval's returns of all members and its number of bars.

    Any linear map of the returns has its realized variance from this matrix, so the bars are scanned once for all vintages.
    """
    at = bars.join(calendar.select("session", "open_bar"), "session").withColumn("bin", F.floor((F.col("bar") - F.col("open_bar")) / interval).cast("int"))
    good = at.join(bins.filter("valid").select("session", "bin"), ["session", "bin"], "left_semi")
    v = good.groupBy("session", "bin").pivot("symbol", members).agg(F.sum(value)).dropna(subset=members)
    names = [*(F.col(m) for m in members), F.lit(float(interval))]
    cells = [F.sum(a * b).alias(f"m{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    k = len(names)
    matrix = F.array(*(F.array(*(F.col(f"m{min(i, j)}_{max(i, j)}") for j in range(k))) for i in range(k)))
    return v.groupBy("session").agg(*cells).select("session", matrix.alias("m"))


def vintages(moments: DataFrame, fits: DataFrame, assigned: DataFrame, stocks: list[str]) -> DataFrame:
    """Daily realized variance of raw returns, benchmark residuals, factor-adjusted residuals and the common part, by frozen fits.

    moments: session, session_no, m.  fits: block_no, symbol, alpha, beta, keep, common, a row a stock.
    """
    maps = fits.groupBy("block_no").agg(F.collect_list(F.struct("symbol", "alpha", "beta", "keep", "common")).alias("fits"))
    j = moments.join(assigned.filter("causal").select("session_no", "block_no"), "session_no").join(maps, "block_no")
    k = len(stocks)

    def fit(row: dict) -> list[dict]:
        m = np.array([list(r) for r in row["m"]], float)
        by = {f["symbol"]: f for f in row["fits"]}
        if len(by) < k:
            return []
        n = len(m) - 1 - k
        raw = np.column_stack([np.zeros((k, n)), np.eye(k), np.zeros((k, 1))])
        resid = np.column_stack([-np.array([list(by[s]["beta"]) for s in stocks]), np.eye(k), -np.array([[by[s]["alpha"]] for s in stocks])])
        keep, common = (np.array([list(by[s][c]) for s in stocks]) @ resid for c in ("keep", "common"))
        out = []
        for control, t in (("raw", raw), ("benchmark_residual", resid), ("factor_adjusted", keep), ("common", common)):
            rv = np.einsum("ij,jk,ik->i", t, m, t)
            out += [{"session_no": int(row["session_no"]), "block_no": int(row["block_no"]), "control": control, "symbol": s, "rv": float(rv[i])} for i, s in enumerate(stocks)]
        return out

    return fit_rows(j, fit, "session_no int, block_no bigint, control string, symbol string, rv double")


def checkpoint_edges(rows: DataFrame, symbols: list[str], every: int = 60, least: int = 60, by: tuple[str, ...] = (), networks: int = 1) -> DataFrame:
    """Cross terms chosen at every `every`-th origin and the last, from all rows before it: descriptive networks, one for each value of the text columns `by`.

    A target's rows are one history whose beginnings are the samples, so checkpoints don't copy rows. networks: about how many `by` tells apart.
    """
    spread = sliced(rows.filter(F.col("response").isNotNull()), *by, "symbol", groups=networks * len(symbols))
    at = {s: i for i, s in enumerate(symbols)}
    terms_of = ("D", "W", "M")

    def run(key, part):
        import pandas as pd

        *spec, symbol, turn = key
        part = part.sort_values("session_no")
        row_no, top = part["row_no"].to_numpy(), int(part["row_no"].max())
        points = np.array([*range(every, top, every), top])[turn :: part["slices"].iloc[0]]
        ns = np.searchsorted(row_no, points, "right")
        points, ns = points[ns >= least], ns[ns >= least]
        if not len(ns):
            return pd.DataFrame([])
        terms, y = np.stack(part["terms"].to_numpy()).astype(float), part["response"].to_numpy(float)
        mine = np.arange(3 * at[symbol], 3 * at[symbol] + 3)
        history = lasso.History(terms[:, mine], np.delete(terms, mine, 1), y)
        names, out = [(s, t) for s in symbols if s != symbol for t in terms_of], []
        for i in range(0, len(ns), 128):
            penalties = np.array([[t["one_se"]] for t in lasso.tune_all(history, ns[i : i + 128])])
            fits = lasso.path_all(history.grams(ns[i : i + 128]), ns[i : i + 128], history.own, penalties)[:, 0, history.own :]
            out += [dict(zip(by, spec)) | {"checkpoint": int(c), "edge_id": f"{s}->{symbol}", "source": s, "target": symbol, "horizon": t, "coefficient": float(b), "selected": bool(b != 0)} for c, fit in zip(points[i : i + 128], fits) for (s, t), b in zip(names, fit)]
        return pd.DataFrame(out)

    schema = "".join(f"{c} string, " for c in by) + "checkpoint int, edge_id string, source string, target string, horizon string, coefficient double, selected boolean"
    return spread.groupBy(*by, "symbol", "slice").applyInPandas(run, schema)
