"""Components of rolling windows, and how the fits of windows hang together.

Windows are fitted apart from one another; only what compares a window with the one before it runs as a
sequence, over a small row a window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import linalg, rotation
from gridloom.operators import moments
from gridloom.operators.factors import covariance_of, fit_rows, matrix_of

# Benchmarks are the first members.
SKIP = 2
NEAR_ZERO, ACTIVE = 1e-8, 0.05
LIKE, OVERLAP = 0.8, 0.5


def paired(raw: DataFrame, normalized: DataFrame, members: list[str]) -> DataFrame:
    """session_no, every member, and every member normalised (n_<member>); both panels must have the same sessions, else the job fails."""
    nothing = F.lit(None).cast("double")
    a = raw.select("session_no", *members, *(nothing.alias(f"n_{m}") for m in members))
    b = normalized.select("session_no", *(nothing.alias(m) for m in members), *(F.col(m).alias(f"n_{m}") for m in members))
    names = [*members, *(f"n_{m}" for m in members)]
    rows = a.unionByName(b).groupBy("session_no").agg(F.count(F.lit(1)).alias("panels"), *(F.max(c).alias(c) for c in names))
    refused = F.raise_error(F.lit("raw and normalised panels have different sessions")).cast("double")
    return rows.withColumn(names[0], F.when(F.col("panels") == 2, F.col(names[0])).otherwise(refused)).drop("panels")


def by_weekday(panel: DataFrame) -> DataFrame:
    """Values (session_no, day, symbol, y) over the symbol's full-sample deviation on that weekday: descriptive, as it looks ahead.

    The profile is seven rows a symbol.
    """
    at = panel.withColumn("weekday", F.dayofweek("day"))
    profile = at.groupBy("symbol", "weekday").agg(F.stddev_samp("y").alias("scale"))
    return at.join(profile, ["symbol", "weekday"]).select("session_no", "symbol", F.when(F.col("scale") > 0, F.col("y") / F.col("scale")).alias("y"))


def window_moments(rows: DataFrame, windows: DataFrame, members: list[str]) -> DataFrame:
    """Every window (width, window_no, start_no, end_no) with the moments of its rows; those without rows have nulls."""
    spread = windows.select("width", "window_no", F.explode(F.sequence("start_no", "end_no")).alias("session_no"))
    inside = spread.join(rows, spread.session_no == rows.session_no.cast("long")).drop("session_no")
    return windows.join(moments.gram(inside, ["width", "window_no"], members), ["width", "window_no"], "left")


def usable(row: dict, p: int) -> tuple[int, str]:
    """Rows of a window, and whether p columns can be fitted on them."""
    n = 0 if row["s"] is None else int(row["n"])
    if n <= p + 1:
        return n, "too_few_rows"
    return n, "fitted" if (np.diag(covariance_of(row)) > 0).all() else "constant_column"


def benchmarked(cov: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Betas, residual covariance, share of variance removed (per cent) and the largest correlation left with a benchmark, a stock each."""
    x, y = list(range(SKIP)), list(range(SKIP, p))
    beta, rest = linalg.residual_covariance(cov, x, y)
    left = cov[np.ix_(y, x)] - beta @ cov[np.ix_(x, x)]
    scale = np.sqrt(np.outer(np.maximum(np.diag(rest), 1e-300), np.diag(cov)[x]))
    return beta, rest, 100 * (1 - np.diag(rest) / np.diag(cov)[y]), np.abs(left / scale).max(axis=1)


VIEWS = tuple((view, method) for view in ("raw", "normalized", "residual") for method in ("correlation", "covariance"))


def components(by_window: DataFrame, members: list[str]) -> DataFrame:
    """Leading components of the stocks in every window, view and method, and the first one's likeness to the last window's.

    by_window has the moments of members and of their normalised values, in this order.  A window that can't be
    fitted is a row that says why.
    """
    p = len(members)
    measures = ("eigenvalue_1", "eigenvalue_2", "eigenvalue_3", "explained_1", "explained_2", "explained_3", "explained_first_3", "effective_dimension")

    def fit(row: dict) -> list[dict]:
        n, status = usable(row, p)
        base = {c: int(row[c]) for c in ("width", "window_no", "start_no", "end_no")} | {"n_rows": n, "status": status}
        if status != "fitted":
            return [base | {"view": view, "method": method, "weights": None} for view, method in VIEWS]
        both = covariance_of(row)
        cov = both[:p, :p]
        _, rest, removed, left = benchmarked(cov, p)
        of = {"raw": cov[SKIP:, SKIP:], "normalized": both[p + SKIP :, p + SKIP :], "residual": rest}
        out = []
        for view, method in VIEWS:
            w, v = linalg.principal(linalg.to_correlation(of[view]) if method == "correlation" else of[view])
            share = w / w.sum()
            top = [*w[:3], *(100 * share[:3]), 100 * share[:3].sum(), 1 / (share**2).sum()]
            more = {"benchmark_removed_pct": float(removed.mean()), "max_abs_residual_corr": float(left.max())} if view == "residual" else {}
            out.append(base | {"view": view, "method": method} | dict(zip(measures, map(float, top))) | {"weights": v[:, :3].T.tolist()} | more)
        return out

    schema = "width int, window_no bigint, start_no bigint, end_no bigint, n_rows bigint, status string, view string, method string, " + ", ".join(f"{m} double" for m in measures) + ", weights array<array<double>>, benchmark_removed_pct double, max_abs_residual_corr double"
    rows = fit_rows(by_window, fit, schema)
    before = Window.partitionBy("width", "view", "method").orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.withColumn("before", F.last(F.col("weights")[0], True).over(before))
    product = F.aggregate(F.zip_with(F.col("weights")[0], "before", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return last.withColumn("similarity", F.abs(product)).drop("before")


def loadings(rolled: DataFrame, stocks: list[str]) -> DataFrame:
    """The first three components' weights, a row a stock."""
    at = rolled.filter("status = 'fitted'").select("width", "window_no", "view", "method", "weights", F.posexplode(F.array(*map(F.lit, stocks))).alias("i", "symbol"))
    return at.select("width", "window_no", "view", "method", "symbol", *(F.col("weights")[k][F.col("i")].alias(f"weight_{k + 1}") for k in range(3)))


def benchmark_diagnostics(by_window: DataFrame, members: list[str]) -> DataFrame:
    """Betas and what they remove, by window and stock."""
    p = len(members)

    def fit(row: dict) -> list[dict]:
        n, status = usable(row, p)
        if status != "fitted":
            return []
        cov, mean = covariance_of(row)[:p, :p], np.array(row["s"], float)[:p] / n
        beta, rest, removed, left = benchmarked(cov, p)
        alpha = mean[SKIP:] - beta @ mean[:SKIP]
        return [
            {"width": int(row["width"]), "window_no": int(row["window_no"]), "symbol": s, "n_rows": n, "alpha": alpha[i], "beta": beta[i].tolist(), "r2": removed[i] / 100, "variance_removed_pct": removed[i], "residual_std": float(np.sqrt(max(rest[i, i], 0.0))), "max_abs_residual_corr": left[i]}
            for i, s in enumerate(members[SKIP:])
        ]

    return fit_rows(by_window, fit, "width int, window_no bigint, symbol string, n_rows bigint, alpha double, beta array<double>, r2 double, variance_removed_pct double, residual_std double, max_abs_residual_corr double")


def whole_sample(whole: DataFrame, k: int, starts: int = 1000, seed: int = 917) -> DataFrame:
    """One row: the sparse loadings of the residual view over all rows, factor by factor."""

    def fit(row: dict) -> list[dict]:
        w, v = linalg.principal(matrix_of(row, "correlation", SKIP))
        return [{"reference": rotation.rotate(w, v, k, starts, seed)["loadings"].T.tolist()}]

    return fit_rows(whole, fit, "reference array<array<double>>")


def matrix(columns) -> np.ndarray:
    """Columns that came as lists, as a matrix."""
    return np.array([list(c) for c in columns], float).T


def against_whole_sample(fits: DataFrame, reference: DataFrame) -> DataFrame:
    """Every window's factors matched with those of the whole sample: which one, its sign, cosine, overlap and signed loadings.

    Looks ahead by design, so it describes and decides nothing.  The reference is one row of p * k numbers.
    """

    def fit(row: dict) -> list[dict]:
        anchor, own = matrix(row["reference"]), matrix(row["loadings"])
        order, signs, cosine = linalg.aligned(anchor, own)
        turned = own[:, order] * signs
        h, critical = linalg.local_threshold(len(own))
        return [
            {"spec": row["spec"], "window_no": int(row["window_no"]), "factor": f"LF{j + 1}", "source_factor": f"LF{order[j] + 1}", "sign": int(signs[j]), "cosine": float(cosine[j]), "jaccard": linalg.jaccard(np.abs(turned[:, j]) >= h, np.abs(anchor[:, j]) >= h), "n_small": int((np.abs(turned[:, j]) < h).sum()), "local": bool((np.abs(turned[:, j]) < h).sum() > critical), "loadings": turned[:, j].tolist()}
            for j in range(own.shape[1])
        ]

    joined = fits.crossJoin(F.broadcast(reference))
    return fit_rows(joined, fit, "spec string, window_no bigint, factor string, source_factor string, sign int, cosine double, jaccard double, n_small int, local boolean, loadings array<double>")


def share_change(a: np.ndarray, b: np.ndarray) -> float:
    """Half the absolute change of a factor's shares of loading: 0 where they are equal, 1 where they don't meet."""
    a, b = np.abs(a), np.abs(b)
    return float(0.5 * np.abs(a / a.sum() - b / b.sum()).sum())


def kalman_stability(fits: DataFrame, reference: DataFrame) -> DataFrame:
    """Factors and states of Kalman windows under one naming, in order of windows.

    The first window is matched with the whole sample, each other with the one before it; loadings, the last state
    and its covariance are permuted and signed alike.  `noisy` warns of a factor that is unlike the last window's.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], None
        for r in part.sort_values("window_no").itertuples():
            static, own = matrix(r.reference), matrix(r.loadings)
            order, signs, cosine = linalg.aligned(static if last is None else last, own)
            own = own[:, order] * signs
            state = np.array(list(r.state), float)[order] * signs
            spread = np.sqrt(np.maximum(np.diag(matrix(r.state_cov))[order], 0.0))
            h, _ = linalg.local_threshold(len(own))
            for j in range(own.shape[1]):
                a = own[:, j]
                row = {"window_no": int(r.window_no), "factor": f"LF{j + 1}", "l1_norm": float(np.abs(a).sum()), "n_zero": int((np.abs(a) < NEAR_ZERO).sum()), "n_small": int((np.abs(a) < h).sum())}
                row["static_cosine"] = float(abs(a @ static[:, j]) / (np.linalg.norm(a) * np.linalg.norm(static[:, j])))
                row |= {"state": float(state[j]), "state_sd": float(spread[j]), "state_low": float(state[j] - 1.96 * spread[j]), "state_high": float(state[j] + 1.96 * spread[j])}
                row |= {"projector_error": float(r.projector_error), "previous_cosine": None, "jaccard": None, "turnover": None, "noisy": False}
                if last is not None:
                    overlap = linalg.jaccard(np.abs(a) >= h, np.abs(last[:, j]) >= h, 0.0)
                    row |= {"previous_cosine": float(cosine[j]), "jaccard": overlap, "turnover": share_change(a, last[:, j]), "noisy": bool(cosine[j] < LIKE or overlap < OVERLAP)}
                rows.append(row)
            last = own
        return pd.DataFrame(rows)

    schema = "window_no bigint, factor string, l1_norm double, n_zero int, n_small int, static_cosine double, state double, state_sd double, state_low double, state_high double, projector_error double, previous_cosine double, jaccard double, turnover double, noisy boolean"
    small = fits.select("window_no", "loadings", "state", "state_cov", "projector_error").crossJoin(F.broadcast(reference)).withColumn("sequence", F.lit(0))
    return small.groupBy("sequence").applyInPandas(run, schema)


def causal_stability(fits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Factors of causal fits that score a block, each matched with the fit before it, and how far they moved."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], None
        for r in part.sort_values("block_no").itertuples():
            own = matrix(r.loadings)
            if last is not None:
                order, signs, _ = linalg.aligned(last, own)
                own = own[:, order] * signs
            for j in range(own.shape[1]):
                a = own[:, j]
                row = {"block_no": int(r.block_no), "training_end": int(r.training_end), "score_start": int(r.score_start), "score_end": int(r.score_end), "factor": f"LF{j + 1}", "l1_norm": float(np.abs(a).sum()), "n_small": int((np.abs(a) <= ACTIVE).sum()), "condition": float(r.condition), "cosine": None, "jaccard": None, "turnover": None}
                if last is not None:
                    b = last[:, j]
                    like = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
                    row |= {"cosine": like, "jaccard": linalg.jaccard(np.abs(a) > ACTIVE, np.abs(b) > ACTIVE), "turnover": 1 - like}
                rows.append(row)
            last = own
        return pd.DataFrame(rows)

    schema = "block_no bigint, training_end bigint, score_start bigint, score_end bigint, factor string, l1_norm double, n_small int, condition double, cosine double, jaccard double, turnover double"
    joined = fits.withColumnRenamed("window_no", "block_no").join(blocks, "block_no")
    return joined.groupBy("spec").applyInPandas(run, schema)
