"""Factor fits from moments: one row in, one small numpy fit, tidy rows out; windows fit in parallel.

What feeds back from window to window (alignment, anchors) runs over the fits afterwards, one
sequence of a few hundred small rows for every specification.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import linalg, rotation, state_space
from gridloom.operators.tasks import dealt


def fit_rows(moments: DataFrame, fit: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """`fit` on every row (a dict); its dicts are the result's rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [out for row in part.to_dict("records") for out in fit(row)]
            yield pd.DataFrame(rows, columns=names)

    keys = [c for c in moments.columns if c in ("window_no", "k", "l1", "kind", "rep")]
    return (dealt(moments, *keys) if keys else moments).mapInPandas(run, schema)


def covariance_of(row: dict) -> np.ndarray:
    s, g = np.array(row["s"], float), np.array([list(r) for r in row["g"]], float)
    return linalg.from_moments(row["n"], s, g)[1]


def matrix_of(row: dict, method: str, benchmarks: int = 0) -> np.ndarray:
    """The matrix that a view takes components of; the first `benchmarks` columns are projected out."""
    cov = covariance_of(row)
    if benchmarks:
        x = list(range(benchmarks))
        cov = linalg.residual_covariance(cov, x, list(range(benchmarks, len(cov))))[1]
    return linalg.to_correlation(cov) if method == "correlation" else cov


VIEWS = (("raw", "correlation", 0), ("raw", "covariance", 0), ("residual", "correlation", 2))


def components(moments: DataFrame, members: list[str]) -> DataFrame:
    """Eigenvalues and loadings of every view: view, method, component, eigenvalue, explained_pct, cumulative_pct, symbol, weight, loading."""

    def fit(row: dict) -> list[dict]:
        out = []
        for view, method, skip in VIEWS:
            w, v = linalg.principal(matrix_of(row, method, skip))
            share = 100 * w / w.sum()
            for k in range(len(w)):
                for i, symbol in enumerate(members[skip:]):
                    out.append({"view": view, "method": method, "component": k + 1, "eigenvalue": w[k], "explained_pct": share[k], "cumulative_pct": share[: k + 1].sum(), "symbol": symbol, "weight": v[i, k], "loading": v[i, k] * np.sqrt(w[k])})
        return out

    return fit_rows(moments, fit, "view string, method string, component int, eigenvalue double, explained_pct double, cumulative_pct double, symbol string, weight double, loading double")


def summary(parts: DataFrame) -> DataFrame:
    return parts.select("view", "method", "component", "eigenvalue", "explained_pct", "cumulative_pct").distinct()


def scores(panel: DataFrame, moments_tidy: DataFrame, loadings: DataFrame) -> DataFrame:
    """Component scores of complete rows: standardised values times weights, by a join with the few loadings."""
    stats = moments_tidy.select("symbol", "mean", "std")
    z = panel.join(F.broadcast(stats), "symbol").withColumn("z", (F.col("y") - F.col("mean")) / F.col("std"))
    return z.join(F.broadcast(loadings.select("symbol", "component", "weight")), "symbol").groupBy("session_no", "component").agg(F.sum(F.col("z") * F.col("weight")).alias("score"))


def reconstruction(moments: DataFrame, members: list[str]) -> DataFrame:
    """Variance of every column that is left after the first k components, and the share explained."""

    def fit(row: dict) -> list[dict]:
        r = matrix_of(row, "correlation")
        w, v = linalg.principal(r)
        out = []
        for k in range(1, len(w) + 1):
            rest = np.eye(len(w)) - v[:, :k] @ v[:, :k].T
            left = np.diag(rest @ r @ rest)
            out += [{"k": k, "symbol": s, "unexplained": left[i], "explained_pct": 100 * (1 - left[i] / r[i, i])} for i, s in enumerate(members)]
        return out

    return fit_rows(moments, fit, "k int, symbol string, unexplained double, explained_pct double")


def varimax(moments: DataFrame, members: list[str], k: int) -> DataFrame:
    def fit(row: dict) -> list[dict]:
        w, v = linalg.principal(matrix_of(row, "correlation"))
        turned, _, rounds = linalg.varimax(v[:, :k] * np.sqrt(w[:k]))
        return [{"factor": f"VF{j + 1}", "symbol": s, "loading": turned[i, j], "rounds": rounds} for j in range(k) for i, s in enumerate(members)]

    return fit_rows(moments, fit, "factor string, symbol string, loading double, rounds int")


PENALTIES = (0.02, 0.05, 0.10, 0.15, 0.20)


def sparse_path(moments: DataFrame, members: list[str], k: int) -> DataFrame:
    """Every penalty and kind is a row of work of its own, so the path runs in parallel."""
    grid = moments.withColumn("l1", F.explode(F.array(*map(F.lit, PENALTIES)))).withColumn("kind", F.explode(F.array(F.lit("lasso"), F.lit("elastic_net"))))

    def fit(row: dict) -> list[dict]:
        got = linalg.sparse_components(matrix_of(row, "correlation"), k, row["l1"], 0.10 if row["kind"] == "elastic_net" else 0.0)
        return [{"kind": row["kind"], "l1": row["l1"], "component": j + 1, "symbol": s, "weight": got["weights"][i, j], "nonzero": got["nonzero"], "explained_pct": got["explained_pct"], "rounds": got["rounds"]} for j in range(k) for i, s in enumerate(members)]

    return fit_rows(grid, fit, "kind string, l1 double, component int, symbol string, weight double, nonzero int, explained_pct double, rounds int")


def l1_rotation(moments: DataFrame, members: list[str], factors: tuple[int, ...], starts: int, seed: int = 916) -> DataFrame:
    """Sparse rotations for several numbers of factors, with the test of locality; seed + 100 K each."""
    grid = moments.withColumn("k", F.explode(F.array(*map(F.lit, factors))))

    def fit(row: dict) -> list[dict]:
        k = row["k"]
        w, v = linalg.principal(matrix_of(row, "correlation"))
        got = rotation.rotate(w, v, k, starts, seed + 100 * k)
        project = got["loadings"] @ np.linalg.pinv(got["loadings"])
        error = float(np.abs(project - v[:, :k] @ v[:, :k].T).max())
        return [
            {"k": k, "factor": f"LF{j + 1}", "symbol": s, "loading": got["loadings"][i, j], "l1_norm": got["l1"][j], "frequency": got["frequency"][j], "source": got["source"][j], "n_small": int(got["small"][j]), "critical": got["critical"], "local": bool(got["small"][j] > got["critical"]), "projector_error": error, "success_rate": got["success"]}
            for j in range(k) for i, s in enumerate(members)
        ]

    return fit_rows(grid, fit, "k int, factor string, symbol string, loading double, l1_norm double, frequency int, source string, n_small int, critical int, local boolean, projector_error double, success_rate double")


def factor_count(moments: DataFrame, most: int = 5) -> DataFrame:
    """The number of factors by the largest ratio of neighbouring eigenvalues."""

    def fit(row: dict) -> list[dict]:
        w, _ = linalg.principal(matrix_of(row, "correlation"))
        ratios = w[:-1] / np.maximum(w[1:], 1e-300)
        return [{"k": i + 1, "ratio": r, "chosen": i == int(ratios[:most].argmax())} for i, r in enumerate(ratios[:most])]

    return fit_rows(moments, fit, "k int, ratio double, chosen boolean")


def session_bootstrap(by_session: DataFrame, replications: int, k: int, starts: int, seed: int, spark) -> DataFrame:
    """Whole sessions drawn with replacement: a replication is a weighted sum of session moments.

    The moments of all sessions (p^2 numbers each) go to every replication as one row.
    """
    whole = by_session.orderBy("session").agg(F.collect_list(F.struct("session", "n", "s", "g")).alias("m"))
    def rotated(row: dict, weights: Callable[[int], np.ndarray], seed: int) -> np.ndarray:
        m = sorted(row["m"], key=lambda x: x["session"])
        n = np.array([x["n"] for x in m], float)
        s = np.array([list(x["s"]) for x in m], float)
        g = np.array([[list(r) for r in x["g"]] for x in m], float)
        w = weights(len(n))
        cov = linalg.from_moments(w @ n, w @ s, np.tensordot(w, g, 1))[1]
        return rotation.rotate(*linalg.principal(linalg.to_correlation(cov)), k, starts, seed)["loadings"]

    # The rotation of all sessions, once for all replications: p * k numbers.
    first = fit_rows(whole, lambda row: [{"loadings": rotated(row, np.ones, seed).tolist()}], "loadings array<array<double>>").collect()
    base = np.array([list(r) for row in first for r in row["loadings"]], float)
    grid = spark.range(replications).withColumnRenamed("id", "rep").join(F.broadcast(whole))

    def fit(row: dict) -> list[dict]:
        own = seed + int(row["rep"]) + 1
        got = rotated(row, lambda n: np.bincount(np.random.default_rng(own).integers(0, n, n), minlength=n).astype(float), own)
        order, signs, cosine = linalg.aligned(base, got)
        turned = got[:, order] * signs
        h, critical = linalg.local_threshold(len(turned))
        return [{"rep": int(row["rep"]), "factor": f"LF{j + 1}", "cosine": cosine[j], "jaccard": linalg.jaccard(np.abs(base[:, j]) >= h, np.abs(turned[:, j]) >= h), "local": bool((np.abs(turned[:, j]) < h).sum() > critical)} for j in range(k)]

    return fit_rows(grid, fit, "rep int, factor string, cosine double, jaccard double, local boolean")


def window_seed(base: int, *parts) -> int:
    """A seed that depends on what is fitted and on nothing else."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, (base, *parts))).encode()).digest()[:8], "little") % 2147483647


def rolling_rotations(by_window: DataFrame, k: int, starts: int, spec: str = "w60") -> DataFrame:
    """Sparse loadings of the residual view in every window."""

    def fit(row: dict) -> list[dict]:
        r = matrix_of(row, "correlation", 2)
        w, v = linalg.principal(r)
        got = rotation.rotate(w, v, k, starts, window_seed(916, row["window_no"]))
        condition = float(np.linalg.cond(got["loadings"]))
        return [{"spec": spec, "window_no": int(row["window_no"]), "loadings": got["loadings"].T.tolist(), "l1": list(map(float, got["l1"])), "sources": list(got["source"]), "condition": condition}]

    return fit_rows(by_window, fit, "spec string, window_no bigint, loadings array<array<double>>, l1 array<double>, sources array<string>, condition double")


def stability(fits: DataFrame) -> DataFrame:
    """Alignment to a past-only anchor, and what makes a window unstable, in order of windows.

    The anchor is the mean of the unit loadings aligned so far, so each window depends on those before
    it: one sequence a specification, over small rows.  Norms and sources are permuted with the factors.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows, past, last = [], [], None
        for r in part.sort_values("window_no").itertuples():
            m = np.array([list(c) for c in r.loadings], float).T
            anchor = np.mean(past, 0) if past else m
            order, signs, to_anchor = linalg.aligned(anchor, m)
            m = m[:, order] * signs
            h, critical = linalg.local_threshold(len(m))
            before = m if last is None else last
            for j in range(m.shape[1]):
                a, b = m[:, j], before[:, j]
                cosine = float(abs(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)))
                overlap = linalg.jaccard(np.abs(a) >= h, np.abs(b) >= h)
                local, was = bool((np.abs(a) < h).sum() > critical), bool((np.abs(b) < h).sum() > critical)
                why = [w for w, bad in (("previous_cosine", cosine < 0.8), ("anchor_cosine", to_anchor[j] < 0.8), ("support", overlap < 0.5), ("locality_change", local != was), ("condition", r.condition > 10)) if bad]
                rows.append({"spec": r.spec, "window_no": r.window_no, "factor": f"LF{j + 1}", "previous_cosine": cosine, "anchor_cosine": float(to_anchor[j]), "jaccard": overlap, "n_small": int((np.abs(a) < h).sum()), "local": local, "l1_norm": float(r.l1[order[j]]), "source": r.sources[order[j]], "reasons": ";".join(why), "unstable": bool(why)})
            past.append(m / np.linalg.norm(m, axis=0))
            last = m
        return pd.DataFrame(rows)

    return fits.groupBy("spec").applyInPandas(run, "spec string, window_no bigint, factor string, previous_cosine double, anchor_cosine double, jaccard double, n_small int, local boolean, l1_norm double, source string, reasons string, unstable boolean")


def causal_fits(by_window: DataFrame, members: list[str], k: int) -> DataFrame:
    """Frozen linear maps of every window: betas, scales and the projector on the first k residual components."""

    def fit(row: dict) -> list[dict]:
        n, s = row["n"], np.array(row["s"], float)
        mean, cov = s / n, covariance_of(row)
        x, y = [0, 1], list(range(2, len(members)))
        b, rest = linalg.residual_covariance(cov, x, y)
        scale = np.sqrt(np.diag(rest))
        w, v = linalg.principal(rest / np.outer(scale, scale))
        p = v[:, :k] @ v[:, :k].T
        keep = np.diag(scale) @ (np.eye(len(y)) - p) @ np.diag(1 / scale)
        alpha = mean[y] - b @ mean[x]
        return [{"block_no": int(row["window_no"]), "symbol": members[i], "alpha": alpha[j], "beta": b[j].tolist(), "keep": keep[j].tolist(), "common": (np.diag(scale) @ p @ np.diag(1 / scale))[j].tolist(), "explained_pct": 100 * w[:k].sum() / w.sum()} for j, i in enumerate(y)]

    return fit_rows(by_window, fit, "block_no bigint, symbol string, alpha double, beta array<double>, keep array<double>, common array<double>, explained_pct double")


def apply_causal(complete: DataFrame, assigned: DataFrame, fits: DataFrame, benchmarks: list[str], stocks: list[str]) -> DataFrame:
    """Benchmark residual and factor-adjusted residual of sessions after each fit, by joins and array sums only."""
    wide = complete.join(assigned.filter("causal").select("session_no", "block_no"), "session_no")
    tidy = wide.select("session_no", "block_no", F.array(*benchmarks).alias("x"), F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), F.col(s).alias("y"), F.lit(i).alias("at")) for i, s in enumerate(stocks)))).alias("t"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    j = tidy.select("session_no", "block_no", "x", "t.*").join(fits, ["block_no", "symbol"])
    e = j.withColumn("residual", F.col("y") - F.col("alpha") - dot(F.col("beta"), F.col("x")))
    vectors = e.groupBy("session_no", "block_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "residual"))), lambda r: r["residual"]).alias("e"))
    out = e.join(vectors, ["session_no", "block_no"])
    return out.select("session_no", "block_no", "symbol", "residual", dot(F.col("keep"), F.col("e")).alias("adjusted"), dot(F.col("common"), F.col("e")).alias("common"))


def kalman(panel: DataFrame, windows: DataFrame, members: list[str], k: int, train: int, starts: int) -> DataFrame:
    """Static, filtered and one-step reconstructions of every window's holdout, fitted on its training sessions.

    One task a window: its sessions (at most a window's length of small rows) are one group.
    """
    inside = windows.withColumn("session_no", F.explode(F.sequence("start_no", "end_no"))).join(panel, "session_no")
    p = len(members) - 2

    def run(key, part):
        part = part.sort_values("session_no")
        first = part["start_no"].iloc[0]
        data, is_train = part[members].to_numpy(float), (part["session_no"] < first + train).to_numpy()
        a, b = data[is_train], data[~is_train]
        if len(a) < 3 * p or len(b) < 2:
            return pd.DataFrame([])
        design = np.column_stack([np.ones(len(a)), a[:, :2]])
        beta = np.linalg.lstsq(design, a[:, 2:], rcond=None)[0]
        ea, eb = a[:, 2:] - design @ beta, b[:, 2:] - np.column_stack([np.ones(len(b)), b[:, :2]]) @ beta
        mean, scale = ea.mean(0), ea.std(0, ddof=1)
        xa, xb = (ea - mean) / scale, (eb - mean) / scale
        w, v = linalg.principal(np.corrcoef(xa, rowvar=False))
        h = np.sqrt(p) * v[:, :k]
        turned = rotation.rotate(w, v, k, starts, window_seed(917, key[0]))["loadings"]
        model = state_space.Dynamics.learned(xa, h)
        fa = model.filtered(xa)
        fb = model.filtered(xb, fa)
        smooth, _ = model.smoothed(fa)
        static = lambda x: x @ turned @ np.linalg.pinv(turned)
        mse = lambda x, y: float(((x - y) ** 2).mean())
        rmse, standardized, condition = model.surprise(xb, fb)
        # The states of the rotated factors: what the rotated loadings need to say the same.
        back = np.linalg.pinv(turned)
        named, error = back @ h, float(np.abs(turned @ back - v[:, :k] @ v[:, :k].T).max())
        return pd.DataFrame([{"window_no": int(key[0]), "n_train": len(a), "n_holdout": len(b), "static_train_mse": mse(xa, static(xa)), "smoothed_train_mse": mse(xa, smooth @ h.T), "static_mse": mse(xb, static(xb)), "filtered_mse": mse(xb, fb.after @ h.T), "one_step_mse": mse(xb, fb.before @ h.T), "innovation_rmse": rmse, "standardized_rms": standardized, "worst_condition": condition, "projector_error": error, "loadings": turned.T.tolist(), "state": (named @ fb.after[-1]).tolist(), "state_cov": (named @ fb.after_cov[-1] @ named.T).tolist()}])

    return dealt(inside, "window_no").groupBy("window_no").applyInPandas(run, "window_no bigint, n_train int, n_holdout int, static_train_mse double, smoothed_train_mse double, static_mse double, filtered_mse double, one_step_mse double, innovation_rmse double, standardized_rms double, worst_condition double, projector_error double, loadings array<array<double>>, state array<double>, state_cov array<array<double>>")
