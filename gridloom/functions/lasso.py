"""HAR with lasso on the other stocks' terms, from cross products.

A training sample enters as its Gram matrix over [1, own, cross, y]: projecting out the own terms is
a Schur complement, the lasso descends on what is left, and growing samples only add outer products.
Many samples are fitted at once as stacks: an operation on a stack costs little more than on one sample.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from gridloom.functions.linalg import shrink

FRACTIONS = (0.0, 0.01, 0.03, 0.1, 0.3, 0.6, 1.0)
FOLDS = 5
ROUNDS, TOLERANCE = 2000, 1e-6


@dataclass(frozen=True)
class Sample:
    """Cross products of n rows; `own` counts the columns of [1, own], the last column is y."""

    n: int
    gram: np.ndarray
    own: int

    @staticmethod
    def of(own: np.ndarray, cross: np.ndarray, y: np.ndarray) -> Sample:
        m = np.column_stack([np.ones(len(y)), own, cross, y])
        return Sample(len(y), m.T @ m, own.shape[1] + 1)

    def projected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram and right side of the standardised cross terms given [1, own], and their scales."""
        k = self.own
        z = np.linalg.pinv(self.gram[:k, :k], hermitian=True)
        rest = self.gram[k:, k:] - self.gram[k:, :k] @ z @ self.gram[:k, k:]
        spread = np.sqrt(np.maximum(np.diag(rest)[:-1], 0) / max(self.n - 1, 1))
        scale = np.where(spread > 1e-12, spread, 1.0)
        return rest[:-1, :-1] / np.outer(scale, scale) / self.n, rest[:-1, -1] / scale / self.n, scale

    def own_terms(self, cross: np.ndarray) -> np.ndarray:
        """Intercept and own coefficients given the cross coefficients."""
        k = self.own
        return np.linalg.pinv(self.gram[:k, :k], hermitian=True) @ (self.gram[:k, -1] - self.gram[:k, k:-1] @ cross)


def descend(g: np.ndarray, c: np.ndarray, alpha: float, start: np.ndarray) -> tuple[np.ndarray, bool, float]:
    """Lasso by coordinate descent: coefficients, whether converged, and the worst violation of its conditions."""

    def violation(b: np.ndarray) -> float:
        slope = g @ b - c
        return float(np.where(np.abs(b) > 1e-10, np.abs(slope + alpha * np.sign(b)), np.maximum(np.abs(slope) - alpha, 0)).max(initial=0.0))

    top = np.abs(c).max(initial=0.0)
    if alpha >= top - 1e-12 * max(1.0, top):
        return np.zeros(len(c)), True, violation(np.zeros(len(c)))
    b, scale = start.copy(), np.diag(g).copy()
    b[scale <= 1e-14] = 0.0
    rest = c - g @ b
    every = np.flatnonzero(scale > 1e-14).tolist()

    def sweep(columns: list[int]) -> float:
        """One pass; `rest`, the gradient, is kept up to date, so a column that stays costs nothing."""
        moved = 0.0
        for i in columns:
            old = b[i]
            pull = rest[i] + scale[i] * old
            new = (pull - alpha if pull > alpha else pull + alpha if pull < -alpha else 0.0) / scale[i]
            if new != old:
                np.subtract(rest, (new - old) * g[i], out=rest)
                b[i] = new
                moved = max(moved, abs(new - old))
        return float(moved)

    for _ in range(ROUNDS):
        if sweep(every) <= TOLERANCE and violation(b) <= 10 * TOLERANCE:
            return b, True, violation(b)
        active = np.flatnonzero(b).tolist()
        for _ in range(ROUNDS):  # settle the columns in use before looking at all again
            if sweep(active) <= TOLERANCE:
                break
        rest = c - g @ b
    return b, False, violation(b)


def path(sample: Sample, alphas: list[float]) -> list[dict]:
    """Fits for descending penalties, each starting from the one before; a penalty of 0 is least squares."""
    g, c, scale = sample.projected()
    b, out = np.zeros(len(c)), []
    for alpha in alphas:
        if alpha <= 1e-14:
            b, ok, worst = np.linalg.lstsq(g, c, rcond=None)[0], True, 0.0
        else:
            b, ok, worst = descend(g, c, alpha, b)
        out.append({"alpha": alpha, "standardized": b, "cross": b / scale, "own": sample.own_terms(b / scale), "converged": ok, "kkt": worst})
    return out


class History:
    """Rows of one target in order; the first n of them, for any n, are a sample whose cross products cost a few rows.

    Sums of products are kept for every `stride` rows, those of the rest are added when asked for.  Rows are less the
    mean of the first few, `base`, as levels are large beside their changes; coefficients but the intercept don't depend on it.
    """

    def __init__(self, own: np.ndarray, cross: np.ndarray, y: np.ndarray, stride: int = 64):
        rows = np.column_stack([np.ones(len(y)), own, cross, y])
        self.base = rows[:20].mean(0) if len(y) else np.zeros(rows.shape[1])
        self.base[0] = 0.0
        self.rows, self.own, self.stride = rows - self.base, own.shape[1] + 1, stride
        whole, k = len(y) // stride, self.rows.shape[1]
        parts = self.rows[: whole * stride].reshape(whole, stride, k)
        self.sums = np.concatenate([np.zeros((1, k, k)), np.cumsum(parts.transpose(0, 2, 1) @ parts, 0)])

    def grams(self, ns: np.ndarray) -> np.ndarray:
        """Gram matrices of the first n rows, for each n."""
        out = self.sums[np.asarray(ns, int) // self.stride]
        for i, n in enumerate(ns):
            rest = self.rows[n - n % self.stride : n]
            out[i] += rest.T @ rest
        return out


def projected_all(grams: np.ndarray, ns: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample.projected of a stack."""
    z = np.linalg.pinv(grams[:, :own, :own], hermitian=True)
    rest = grams[:, own:, own:] - grams[:, own:, :own] @ z @ grams[:, :own, own:]
    n = np.asarray(ns, float)[:, None]
    spread = np.sqrt(np.maximum(np.diagonal(rest, axis1=1, axis2=2)[:, :-1], 0) / np.maximum(n - 1, 1))
    scale = np.where(spread > 1e-12, spread, 1.0)
    return rest[:, :-1, :-1] / (scale[:, :, None] * scale[:, None, :]) / n[:, :, None], rest[:, :-1, -1] / scale / n, scale


def settled(g: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lasso's equations solved for the columns that b uses, with b's signs; b where they can't be solved."""
    on, eye = b != 0, np.eye(c.shape[1])
    ridge = 1e-13 * eye * np.maximum(np.diagonal(g, axis1=1, axis2=2).max(1, initial=1.0), 1.0)[:, None, None]
    try:
        got = np.linalg.solve(np.where(on[:, :, None] & on[:, None, :], g, eye) + ridge, np.where(on, c - a * np.sign(b), 0.0)[:, :, None])
    except np.linalg.LinAlgError:
        return b
    return np.where(on, got[:, :, 0], 0.0)


def descend_all(g: np.ndarray, c: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> np.ndarray:
    """`descend` on a stack, each problem by itself: passes over all columns until its conditions hold.

    Every few passes the equations of the columns in use are solved as they stand, which settles nearly collinear
    columns at once; the solution counts only if it keeps the signs and meets the same conditions.  What is left after
    ROUNDS passes is descended alone.
    """
    out = np.zeros_like(start)
    top = np.abs(c).max(1, initial=0.0)
    at = np.flatnonzero(alpha < top - 1e-12 * np.maximum(1.0, top))
    g, c, a, b = g[at], c[at], alpha[at, None], start[at].copy()
    diagonal = np.diagonal(g, axis1=1, axis2=2)
    used = diagonal > 1e-14
    scale = np.where(used, diagonal, 1.0)
    b[~used] = 0.0

    def holds(b: np.ndarray) -> np.ndarray:
        slope = (g @ b[:, :, None])[:, :, 0] - c
        return np.where(np.abs(b) > 1e-10, np.abs(slope + a * np.sign(b)), np.maximum(np.abs(slope) - a, 0)).max(1, initial=0.0) <= 10 * TOLERANCE

    for turn in range(ROUNDS):
        if not len(at):
            return out
        rest, moved = c - (g @ b[:, :, None])[:, :, 0], np.zeros(len(at))
        for i in range(c.shape[1]):
            old = b[:, i].copy()
            pull = rest[:, i] + scale[:, i] * old
            new = np.where(used[:, i], np.sign(pull) * np.maximum(np.abs(pull) - a[:, 0], 0.0) / scale[:, i], 0.0)
            rest -= (new - old)[:, None] * g[:, i]
            b[:, i] = new
            np.maximum(moved, np.abs(new - old), out=moved)
        done = (moved <= TOLERANCE) & holds(b)
        if turn % 8 == 7:
            exact = settled(g, c, a, b)
            take = ~done & (np.sign(exact) == np.sign(b)).all(1) & holds(exact)
            b[take], done = exact[take], done | take
        if done.any():
            out[at[done]] = b[done]
            g, c, a, b, at, scale, used, diagonal = (x[~done] for x in (g, c, a, b, at, scale, used, diagonal))
    for j, i in enumerate(at):
        out[i] = descend(g[j], c[j], float(a[j, 0]), b[j])[0]
    return out


def path_all(grams: np.ndarray, ns: np.ndarray, own: int, alphas: np.ndarray) -> np.ndarray:
    """`path` on a stack, alphas a row a sample: the coefficients of [1, own, cross] by sample and penalty."""
    g, c, scale = projected_all(grams, ns, own)
    z = np.linalg.pinv(grams[:, :own, :own], hermitian=True)
    b, out = np.zeros_like(c), np.zeros((*alphas.shape, grams.shape[1] - 1))
    for k in range(alphas.shape[1]):
        free = alphas[:, k] <= 1e-14
        last, b = b, np.zeros_like(b)
        if c.shape[1]:
            if free.any():
                b[free] = (np.linalg.pinv(g[free], rcond=np.finfo(float).eps * c.shape[1], hermitian=True) @ c[free][:, :, None])[:, :, 0]
            b[~free] = descend_all(g[~free], c[~free], alphas[~free, k], last[~free])
        out[:, k, own:] = b / scale
        out[:, k, :own] = (z @ (grams[:, :own, -1] - (grams[:, :own, own:-1] @ out[:, k, own:, None])[:, :, 0])[:, :, None])[:, :, 0]
    return out


def top_penalties(grams: np.ndarray, ns: np.ndarray, own: int) -> np.ndarray:
    return np.abs(projected_all(grams, ns, own)[1]).max(1, initial=0.0)


def top_penalty(sample: Sample) -> float:
    return float(np.abs(sample.projected()[1]).max(initial=0.0))


def folds(n: int, own: int, k: int = FOLDS) -> list[tuple[int, int]]:
    """Chronological validation: (training end, validation end)."""
    first = min(max(5, 20, own + 5), max(1, n - 1))
    ends = np.linspace(first, n, k + 1, dtype=int)
    return [(int(a), int(b)) for a, b in zip(ends, ends[1:]) if b > a]


def tune(own: np.ndarray, cross: np.ndarray, y: np.ndarray, fractions: tuple[float, ...] = FRACTIONS) -> dict:
    """Fractions of the top penalty of least loss, and the largest within one standard error of it."""
    falling = sorted(fractions, reverse=True)
    losses: dict[float, list[float]] = {f: [] for f in falling}
    for a, b in (parts := folds(len(y), own.shape[1])):
        sample = Sample.of(own[:a], cross[:a], y[:a])
        top = top_penalty(sample)
        for f, fit in zip(falling, path(sample, [f * top for f in falling])):
            losses[f].append(float(((y[a:b] - predict(fit, own[a:b], cross[a:b])) ** 2).mean()))
    return chosen(losses, len(parts), top_penalty(Sample.of(own, cross, y)))


def chosen(losses: dict[float, list[float]], parts: int, top: float) -> dict:
    """The penalties that the folds' losses by fraction point to."""
    fractions = sorted(losses)
    if not parts:
        return {"min": fractions[-1] * top, "one_se": fractions[-1] * top, "status": "fallback_no_valid_folds"}
    mean = {f: float(np.mean(v)) for f, v in losses.items()}
    best = min(fractions, key=mean.get)
    error = float(np.std(losses[best], ddof=1) / np.sqrt(parts)) if parts > 1 else 0.0
    wide = max(f for f in fractions if mean[f] <= mean[best] + error)
    return {"min": best * top, "one_se": wide * top, "status": "ok" if parts == FOLDS else "fallback_insufficient_folds"}


def tune_all(history: History, ns: np.ndarray, columns: np.ndarray | None = None, own: int | None = None, fractions: tuple[float, ...] = FRACTIONS) -> list[dict]:
    """`tune` on the first n rows for each n, by cross products alone; columns (of [1, own, cross, y], the first `own` unpenalised) where not all are used."""
    own, falling = own or history.own, np.array(sorted(fractions, reverse=True))
    pick = np.arange(history.rows.shape[1]) if columns is None else np.asarray(columns)
    of = lambda at: history.grams(at)[:, pick[:, None], pick]
    parts = [folds(int(n), own - 1) for n in ns]
    ends = np.array([ab for p in parts for ab in p], int).reshape(-1, 2)
    tops = top_penalties(of(ns), ns, own)
    losses = np.zeros((len(ends), len(falling)))
    if len(ends):
        samples = of(ends[:, 0])
        inside = of(ends[:, 1]) - samples
        fits = path_all(samples, ends[:, 0], own, falling * top_penalties(samples, ends[:, 0], own)[:, None])
        misses = np.concatenate([-fits, np.ones((*fits.shape[:2], 1))], 2)
        losses = np.maximum(((misses @ inside) * misses).sum(2), 0.0) / (ends[:, 1] - ends[:, 0])[:, None]
    out, first = [], 0
    for p, top in zip(parts, tops):
        own_losses = losses[first : first + len(p)]
        out.append(chosen({float(f): own_losses[:, k].tolist() for k, f in enumerate(falling)}, len(p), float(top)))
        first += len(p)
    return out


def predict(fit: dict, own: np.ndarray, cross: np.ndarray) -> np.ndarray:
    return fit["own"][0] + own @ fit["own"][1:] + cross @ fit["cross"]


def smearing(fit: dict, own: np.ndarray, cross: np.ndarray, y: np.ndarray) -> float:
    """Mean of the exponential training residuals, which are clipped at 30."""
    return max(float(np.exp(np.clip(y - predict(fit, own, cross), -30, 30)).mean()), 1e-12)


def level(log_forecast: float, factor: float, floor: float = 1e-16) -> float:
    """A forecast on the original scale."""
    return max(float(np.exp(np.clip(log_forecast, -40, 40))) * factor, floor)


def smearing_all(history: History, ns: np.ndarray, fits: np.ndarray, together: list[np.ndarray]) -> np.ndarray:
    """`smearing` by model and sample, the first ns rows; fits (model, sample, coefficient).  Samples that are `together` share a pass over the rows."""
    sums = np.zeros(fits.shape[:2])
    for at in together:
        coefficients, n = fits[:, at].reshape(-1, fits.shape[2]).T, np.tile(ns[at], len(fits))
        for i in range(0, int(n.max()), 4096):
            part = history.rows[i : min(i + 4096, int(n.max()))]
            e = part[:, -1:] - part[:, :-1] @ coefficients
            e = np.exp(np.clip(e, -30, 30, out=e), out=e)
            if i + len(part) > n.min():
                e[np.arange(i, i + len(part))[:, None] >= n] = 0.0
            sums[:, at] += e.sum(0).reshape(len(fits), -1)
    return np.maximum(sums / ns, 1e-12)


def levels(log_forecast: np.ndarray, factor: np.ndarray | float, floor: float = 1e-16) -> np.ndarray:
    """`level` of an array."""
    return np.maximum(np.exp(np.clip(log_forecast, -40, 40)) * factor, floor)


def resampled(history: History, draws: Iterable[np.ndarray], n: int, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrices of resamples of the first n rows, and their sizes: products of rows weighted by how often each was drawn."""
    counts = np.stack([np.bincount(d, minlength=n) for d in draws]).astype(float)
    k = history.rows.shape[1]
    i, j = np.triu_indices(k)
    sums = np.zeros((len(counts), len(i)))
    for a in range(0, n, chunk):
        rows = history.rows[a : min(a + chunk, n)]
        sums += counts[:, a : a + chunk] @ (rows[:, i] * rows[:, j])
    grams = np.empty((len(counts), k, k))
    grams[:, i, j] = grams[:, j, i] = sums
    return grams, counts.sum(1).astype(int)


def block_draw(rng: np.random.Generator, n: int, length: int, circular: bool) -> np.ndarray:
    """Row numbers of a moving-block resample of n rows."""
    blocks = -(-n // length)
    starts = rng.integers(0, n if circular else max(n - length + 1, 1), blocks)
    rows = (starts[:, None] + np.arange(length)).ravel()[:n]
    return rows % n if circular else np.minimum(rows, n - 1)
