"""Meta-learners over out-of-fold columns (M0-M6) and the stackers that use them (K0-K6)."""

from __future__ import annotations

import numpy as np

from .kernels import BINARY, sigmoid

DEFAULT, SIMPLEX, NONEG = "default", "simplex", "nonneg"
C_GRID = np.logspace(-4, 4, 10)


def score(metric: str, y, z) -> float:
    """Greater is better."""
    if metric == "mse":
        return -float(np.mean((y - z) ** 2))
    if metric == "logloss":
        return -float(np.mean(np.logaddexp(0, z) - y * z))
    if metric == "auroc":
        order = np.argsort(z, kind="stable")
        v, start, count = np.unique(z[order], return_index=True, return_counts=True)
        rank = np.repeat(start + (count + 1) / 2, count)
        pos = y[order] == 1
        n1, n0 = pos.sum(), (~pos).sum()
        return float((rank[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else 0.5
    p = z > 0
    if metric == "accuracy":
        return float(np.mean(p == (y == 1)))
    tp, tn, fp, fn = (float(np.sum(a & b)) for a, b in ((p, y == 1), (~p, y == 0), (p, y == 0), (~p, y == 1)))
    den = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (tp * tn - fp * fn) / den if den else 0.0


def _descend(x, norm, y, l2, bound, intercept, start, steps=500, tol=1e-8):
    """Mean logistic loss + l2 / 2 |w|^2 by accelerated projected gradient; ``norm``: the spectral norm of x."""
    n = len(y)
    ridge = np.full(x.shape[1], l2)
    if intercept:
        ridge[-1] = 0
    step = 1 / (0.25 * norm**2 / n + l2)
    w, v, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        nw = v - step * (x.T @ (sigmoid(x @ v) - y) / n + ridge * v)
        nw = bound(nw)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (v - nw) @ (nw - w) > 0:
            nt = 1.0
        v = nw + (t - 1) / nt * (nw - w)
        done = np.max(np.abs(nw - w), initial=0) < tol
        w, t = nw, nt
        if done:
            break
    return w


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with entries of at least 0 that add up to 1."""
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    k = np.flatnonzero(u > c)[-1]
    return np.maximum(v - c[k], 0)


def fit_meta(z, y, folds, task: str = BINARY, kind: str = NONEG, metric: str = "mcc", intercept: bool = False):
    """(weights, intercept). Strengths are compared by the metric summed over the folds, first best; then a fit on all rows."""
    n, m = z.shape
    if kind == SIMPLEX and task == BINARY:
        intercept = False

    def bound(w):
        if kind == DEFAULT:
            return w
        body = simplex(w[:m]) if kind == SIMPLEX else np.maximum(w[:m], 0)
        return np.concatenate([body, w[m:]])

    if task != BINARY:
        return _regression(z, y, folds, kind)
    first = np.full(m + intercept, 1 / m)
    if intercept:
        first[-1] = 0
    total = np.zeros(len(C_GRID))
    whole = np.c_[z, np.ones(n)] if intercept else z
    for f in np.unique(folds):
        tr, te = folds != f, folds == f
        x, held, ytr, yte = whole[tr], z[te], y[tr], y[te]
        norm = np.linalg.norm(x, 2)
        w = first
        for k, c in enumerate(C_GRID):
            w = _descend(x, norm, ytr, 1 / (c * len(ytr)), bound, intercept, w)
            total[k] += score(metric, yte, held @ w[:m] + (w[m] if intercept else 0))
    c = C_GRID[int(np.argmax(total))]
    w = _descend(whole, np.linalg.norm(whole, 2), y, 1 / (c * n), bound, intercept, first, 2000)
    return w[:m], float(w[m]) if intercept else 0.0


def _elastic(z, y, lam, mix, positive, w, steps=200, tol=1e-9):
    n = len(y)
    gram, corr = z.T @ z / n, z.T @ y / n
    for _ in range(steps):
        old = w.copy()
        for j in range(len(w)):
            r = corr[j] - gram[j] @ w + gram[j, j] * w[j]
            v = np.sign(r) * max(abs(r) - lam * mix, 0)
            v = max(v, 0) if positive else v
            w[j] = v / (gram[j, j] + lam * (1 - mix)) if gram[j, j] + lam * (1 - mix) > 0 else 0
        if np.max(np.abs(w - old), initial=0) < tol:
            break
    return w


def _regression(z, y, folds, kind, mix=0.5, n_lambda=50):
    """M4: elastic net by coordinate descent with an intercept; weights of at least 0 unless ``kind`` is the default."""
    positive = kind != DEFAULT
    zm, ym = z.mean(0), y.mean()
    top = np.abs((z - zm).T @ (y - ym)).max() / len(y) / mix
    lambdas = max(top, 1e-12) * np.logspace(0, -3, n_lambda)
    loss = np.zeros(n_lambda)
    for f in np.unique(folds):
        tr, te = folds != f, folds == f
        m, c, w = z[tr].mean(0), y[tr].mean(), np.zeros(z.shape[1])
        for k, lam in enumerate(lambdas):
            w = _elastic(z[tr] - m, y[tr] - c, lam, mix, positive, w)
            loss[k] += np.mean((y[te] - c - (z[te] - m) @ w) ** 2)
    w = _elastic(z - zm, y - ym, lambdas[int(np.argmin(loss))], mix, positive, np.zeros(z.shape[1]), 2000)
    return w, float(ym - zm @ w)


def fit_multiclass(z, y, folds, classes, **kw):
    """M2: one-vs-rest; z is (classes, rows, members). Returns weights (classes, members) and intercepts."""
    got = [fit_meta(z[k], (y == c).astype(float), folds, **kw) for k, c in enumerate(classes)]
    return np.array([w for w, _ in got]), np.array([b for _, b in got])


BASE, GREEDY, STRATIFIED, PRESELECTED, POSTSELECTED, POSTSELECTED_STRATIFIED = "base", "greedy", "stratified", "preselected", "postselected", "postselected_stratified"


def stack(z, y, folds, learner: list[str], is_base: list[bool], kind: str = BASE, task: str = BINARY, meta: str = NONEG, metric: str = "mcc", top: int = 2):
    """(weight of each member, intercept): which out-of-fold columns count, and how much (K1-K6).

    PRESELECTED keeps the learners whose base member is best, POSTSELECTED those whose own stack is best.
    """
    z, who = np.asarray(z), np.asarray(learner)
    m = z.shape[1]
    fit = lambda cols: fit_meta(cols, y, folds, task, meta, metric)
    out = np.zeros(m)
    if kind == GREEDY:
        out[int(np.argmax([score(metric, y, z[:, k]) for k in range(m)]))] = 1.0
        return out, 0.0
    names = list(dict.fromkeys(learner))
    if kind == PRESELECTED:
        base = {who[k]: score(metric, y, z[:, k]) for k in range(m) if is_base[k]}
        names = sorted(base, key=lambda a: -base[a])[:top]
    own = {}
    if kind in (STRATIFIED, POSTSELECTED, POSTSELECTED_STRATIFIED):
        for a in names:
            at = np.flatnonzero(who == a)
            w, b = fit(z[:, at])
            own[a] = (at, w, b, z[:, at] @ w + b)
        if kind != STRATIFIED:
            names = sorted(names, key=lambda a: -score(metric, y, own[a][3]))[:top]
    if kind in (STRATIFIED, POSTSELECTED_STRATIFIED):
        w2, b2 = fit(np.stack([own[a][3] for a in names], 1))
        for a, v in zip(names, w2):
            out[own[a][0]] = v * own[a][1]
        return out, b2 + float(sum(v * own[a][2] for a, v in zip(names, w2)))
    at = np.flatnonzero(np.isin(who, names))
    w, b = fit(z[:, at])
    out[at] = w
    return out, b
