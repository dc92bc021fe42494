"""Numeric kernels: invariants, planted structure, agreement with direct computation."""

import numpy as np
import pytest

from gridloom.functions import lasso, linalg, rotation, state_space


@pytest.fixture
def data():
    rng = np.random.default_rng(1)
    f = rng.normal(size=(600, 3))
    load = np.zeros((12, 3))
    for k in range(3):
        load[4 * k : 4 * k + 4, k] = rng.uniform(1, 2, 4)
    return f @ load.T + 0.1 * rng.normal(size=(600, 12)), load


def test_components_from_moments(data):
    x, _ = data
    mean, cov = linalg.from_moments(len(x), x.sum(0), x.T @ x)
    assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x, rowvar=False))
    w, v = linalg.principal(cov)
    assert np.allclose(v @ np.diag(w) @ v.T, cov) and (np.diff(w) <= 1e-12).all()
    assert (v[np.abs(v).argmax(0), range(12)] > 0).all()
    scores = (x - mean) @ v
    assert np.allclose(scores.var(0, ddof=1), w)
    with pytest.raises(ValueError):
        linalg.principal(np.diag([1.0, -1.0]))


def test_regression_from_moments():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = x @ np.array([[1.0, 2], [3, 4], [0, 1]]).T + 0.3 + rng.normal(size=(200, 3))
    b, rest = linalg.residual_covariance(np.cov(np.column_stack([x, y]), rowvar=False), [0, 1], [2, 3, 4])
    direct = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose(b, direct[1:].T)
    e = y - np.column_stack([np.ones(200), x]) @ direct
    assert np.allclose(rest, e.T @ e / 199)


def test_varimax_is_orthogonal_and_simple(data):
    x, load = data
    w, v = linalg.principal(np.corrcoef(x, rowvar=False))
    turned, turn, rounds = linalg.varimax(v[:, :3] * np.sqrt(w[:3]))
    assert np.allclose(turn.T @ turn, np.eye(3)) and rounds < 1000
    _, _, cosine = linalg.aligned((load != 0).astype(float), turned)  # correlations even the sizes out
    assert cosine.min() > 0.99


def test_sparse_components(data):
    gram = np.corrcoef(data[0], rowvar=False)
    dense, sparse = linalg.sparse_components(gram, 3, 0.0, 0.0), linalg.sparse_components(gram, 3, 0.2, 0.1)
    assert dense["nonzero"] == 36 and sparse["nonzero"] < 20
    w, _ = linalg.principal(gram)
    assert abs(dense["explained_pct"] - 100 * w[:3].sum() / w.sum()) < 1e-6
    assert np.allclose(np.linalg.norm(sparse["weights"], axis=0), 1)


def test_sphere_maps():
    q = np.random.default_rng(3).normal(size=(50, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    assert np.allclose(rotation.direction(rotation.angles_of(q)), q)


def test_simplex_search_finds_the_minimum():
    target = np.array([0.3, -1.2, 2.0])
    x, v, ok = rotation.nelder_mead(lambda p: ((p - target) ** 2).sum(1), np.random.default_rng(4).normal(size=(20, 3)), 1000)
    assert ok.all() and np.allclose(x, target, atol=1e-4) and (v < 1e-8).all()


def test_rotation_recovers_planted_factors(data):
    x, load = data
    w, v = linalg.principal(np.corrcoef(x, rowvar=False))
    got = rotation.rotate(w, v, 3, 200)
    _, _, cosine = linalg.aligned((load != 0).astype(float), got["loadings"])
    assert cosine.min() > 0.98 and got["local"]
    p = got["loadings"] @ np.linalg.pinv(got["loadings"])
    assert np.allclose(p, v[:, :3] @ v[:, :3].T, atol=1e-8)
    again = rotation.rotate(w, v, 3, 200)
    assert np.array_equal(got["loadings"], again["loadings"])


def test_locality_constants():
    assert linalg.local_threshold(12)[1] == 7 and abs(linalg.local_threshold(12)[0] - 0.40243) < 1e-5
    assert linalg.local_threshold(18)[1] == 9 and abs(linalg.local_threshold(18)[0] - 0.34598) < 1e-5


def test_alignment_undoes_permutation_and_sign():
    m = np.random.default_rng(5).normal(size=(9, 4))
    mixed = m[:, [2, 0, 3, 1]] * np.array([1, -1, 1, -1])
    order, signs, cosine = linalg.aligned(m, mixed)
    assert np.allclose(mixed[:, order] * signs, m) and np.allclose(cosine, 1)
    assert linalg.jaccard(np.zeros(3, bool), np.zeros(3, bool)) == 1.0 and linalg.jaccard(np.zeros(3, bool), np.zeros(3, bool), 0.0) == 0.0


def test_filter_beats_static_on_a_persistent_state():
    rng = np.random.default_rng(6)
    h = np.column_stack([np.ones(6), np.r_[np.ones(3), -np.ones(3)]])
    f = np.zeros((300, 2))
    for t in range(1, 300):
        f[t] = 0.95 * f[t - 1] + 0.2 * rng.normal(size=2)
    y = f @ h.T + rng.normal(size=(300, 6))
    model = state_space.Dynamics.learned(y, h)
    assert np.abs(np.linalg.eigvals(model.step)).max() <= 0.98 + 1e-9
    track = model.filtered(y)
    smooth, cov = model.smoothed(track)
    mse = lambda s: ((s - f) ** 2).mean()
    assert mse(smooth) < mse(track.after) < mse(y @ h / 6)
    assert all(np.linalg.eigvalsh(c).min() > 0 for c in cov)


def test_filter_and_smoother_are_conditional_means():
    """Against the joint normal distribution of all states and rows."""
    rng = np.random.default_rng(8)
    n, p, k = 7, 4, 2
    h = rng.normal(size=(p, k))
    model = state_space.Dynamics.learned(rng.normal(size=(40, p)), h)
    y = rng.normal(size=(n, p))
    mean, covs = [model.mean], np.zeros((n, n, k, k))
    covs[0, 0] = model.cov
    for t in range(1, n):
        mean.append(model.step @ mean[-1])
        covs[t, t] = model.step @ covs[t - 1, t - 1] @ model.step.T + model.shock
        for s in range(t):
            covs[t, s] = model.step @ covs[t - 1, s]
            covs[s, t] = covs[t, s].T
    m, c = np.concatenate(mean), covs.transpose(0, 2, 1, 3).reshape(n * k, n * k)
    big, noise = np.kron(np.eye(n), h), np.kron(np.eye(n), np.diag(model.noise))
    track = model.filtered(y)
    for seen in (3, n):
        b, r = big[: seen * p], noise[: seen * p, : seen * p]
        gain = c @ b.T @ np.linalg.inv(b @ c @ b.T + r)
        given, left = m + gain @ (y[:seen].ravel() - b @ m), c - gain @ b @ c
        last = slice((seen - 1) * k, seen * k)
        assert np.allclose(track.after[seen - 1], given[last]) and np.allclose(track.after_cov[seen - 1], left[last, last])
    smooth, spread = model.smoothed(track)
    assert np.allclose(smooth.ravel(), given) and np.allclose(spread[2], left[2 * k : 3 * k, 2 * k : 3 * k])
    split = model.filtered(y[3:], model.filtered(y[:3]))
    assert np.allclose(split.after, track.after[3:]) and np.allclose(split.before_cov, track.before_cov[3:])


def sample(n=240):
    rng = np.random.default_rng(7)
    own, cross = rng.normal(size=(n, 3)), rng.normal(size=(n, 9))
    y = 0.2 + own @ [0.4, 0.3, 0.1] + 0.5 * cross[:, 4] + 0.2 * rng.normal(size=n)
    return own, cross, y


def test_lasso_edges_and_conditions():
    own, cross, y = sample()
    s = lasso.Sample.of(own, cross, y)
    top = lasso.top_penalty(s)
    none, some, free = lasso.path(s, [top, 0.1 * top, 0.0])
    assert not none["cross"].any() and some["converged"] and some["kkt"] < 1e-5
    assert np.abs(some["cross"]).argmax() == 4
    x = np.column_stack([np.ones(len(y)), own, cross])
    assert np.allclose(np.r_[free["own"], free["cross"]], np.linalg.lstsq(x, y, rcond=None)[0])
    assert np.allclose(none["own"], np.linalg.lstsq(x[:, :4], y, rcond=None)[0])


def test_tuning_is_chronological():
    own, cross, y = sample()
    t = lasso.tune(own, cross, y)
    assert t["status"] == "ok" and t["one_se"] >= t["min"]
    parts = lasso.folds(240, 3)
    assert parts[-1][1] == 240 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert lasso.tune(own[:6], cross[:6], y[:6])["status"].startswith("fallback")


def test_block_draws():
    rng = np.random.default_rng(8)
    a, b = lasso.block_draw(rng, 50, 7, True), lasso.block_draw(rng, 50, 7, False)
    assert len(a) == len(b) == 50 and set(a) | set(b) <= set(range(50))
    assert (np.diff(b.reshape(-1)[:7]) == 1).all()


def test_tail_probabilities():
    assert abs(linalg.two_sided(1.959963984540054) - 0.05) < 1e-12 and linalg.two_sided(20) > 0


def test_histories_equal_single_samples():
    """Beginnings of one history, tuned and fitted as a stack, give what each sample gives alone."""
    rng = np.random.default_rng(4)
    terms = 10 + rng.normal(size=(500, 9))
    terms[:, 8] = terms[:, 7] + 1e-3 * terms[:, 8]  # nearly collinear
    own, cross = terms[:, :3], terms[:, 3:]
    y = own @ [0.5, 0.2, 0.1] + 0.3 * cross[:, 0] - 0.2 * cross[:, 4] + 0.2 * rng.normal(size=500)
    history, ns = lasso.History(own, cross, y), np.array([21, 64, 128, 199, 500])
    for n, t in zip(ns, lasso.tune_all(history, ns)):
        alone = lasso.tune(own[:n], cross[:n], y[:n])
        assert t["status"] == alone["status"] and np.allclose([t["min"], t["one_se"]], [alone["min"], alone["one_se"]], rtol=1e-6, atol=1e-12)
    ns = ns[1:]
    alphas = np.array([0.3, 0.05, 0.01, 0.0]) * lasso.top_penalties(history.grams(ns), ns, 4)[:, None]
    for n, a, fits in zip(ns, alphas, lasso.path_all(history.grams(ns), ns, 4, alphas)):
        sample = lasso.Sample.of(own[:n], cross[:n], y[:n])
        g, c, scale = sample.projected()
        for alpha, fit, one in zip(a, fits, lasso.path(sample, list(a))):
            b = fit[4:] * scale
            slope = g @ b - c
            worst = np.where(np.abs(b) > 1e-10, np.abs(slope + alpha * np.sign(b)), np.maximum(np.abs(slope) - alpha, 0)).max()
            assert worst <= 1.1 * max(one["kkt"], 10 * lasso.TOLERANCE)
            assert np.allclose(history.rows[:n, :-1] @ fit + history.base[-1], lasso.predict(one, own[:n], cross[:n]), atol=1e-3)
