"""Learners as NumPy kernels that run inside one task: penalised GLM path, boosted and bagged trees, RBF machine.

They share ``fit(X, y, importance, penalty, weight, seed)`` and ``predict(X)``, which gives logits for binary tasks.
"""

from __future__ import annotations

import numpy as np

BINARY, REGRESSION = "binary", "regression"


def scaler(x: np.ndarray):
    """Mean and population deviation; a constant column has scale 1."""
    s = x.std(0)
    return x.mean(0), np.where(s == 0, 1.0, s)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logit(p, eps: float = 1e-8):
    p = np.clip(p, eps, 1 - eps)
    return np.log(p / (1 - p))


class Lasso:
    """L1: elastic-net GLM along a path of lambdas, with a penalty factor for each feature.

    Accelerated proximal steps with warm starts. ``lambda`` is chosen by the held-out loss of the folds, which also
    give the out-of-fold predictions: one pass for both. Columns are standardised on the training rows only.
    """

    def __init__(self, task: str = BINARY, mix: float = 1.0, n_lambda: int = 50, ratio: float = 1e-2, tol: float = 1e-6, max_iter: int = 400):
        self.task, self.mix, self.n_lambda, self.ratio, self.tol, self.max_iter = task, mix, n_lambda, ratio, tol, max_iter

    def _mean(self, eta):
        return sigmoid(eta) if self.task == BINARY else eta

    def _loss(self, eta, y):
        return np.mean(np.logaddexp(0, eta) - y * eta) if self.task == BINARY else 0.5 * np.mean((y - eta) ** 2)

    def path(self, x, y, factor, lambdas=None, weight=None):
        """(lambdas, coefficients by lambda, intercepts) on standardised columns."""
        n, p = x.shape
        w = np.full(n, 1 / n) if weight is None else weight / weight.sum()
        mean = float(w @ y)
        b0 = float(logit(np.array(mean))) if self.task == BINARY else mean
        if lambdas is None:
            grad = np.abs(x.T @ (w * (y - self._mean(np.full(n, b0)))))
            top = np.max(grad / np.maximum(factor, 1e-12)) / max(self.mix, 1e-3)
            lambdas = top * np.logspace(0, np.log10(self.ratio), self.n_lambda)
        curve = 0.25 if self.task == BINARY else 1.0
        smooth = curve * (np.linalg.norm(x * np.sqrt(w)[:, None], 2) ** 2 + 1) + 1e-12
        b, c, out, cuts = np.zeros(p), b0, [], []
        for lam in lambdas:
            step = 1 / (smooth + lam * (1 - self.mix) * factor.max(initial=0))
            v, vc, t = b.copy(), c, 1.0
            for _ in range(self.max_iter):
                r = w * (self._mean(x @ v + vc) - y)
                g = x.T @ r + lam * (1 - self.mix) * factor * v
                nb = v - step * g
                nb = np.sign(nb) * np.maximum(np.abs(nb) - step * lam * self.mix * factor, 0)
                nc = vc - step * r.sum()
                nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
                move = max(np.max(np.abs(nb - b), initial=0), abs(nc - c))
                if (v - nb) @ (nb - b) + (vc - nc) * (nc - c) > 0:
                    nt = 1.0
                v, vc = nb + (t - 1) / nt * (nb - b), nc + (t - 1) / nt * (nc - c)
                b, c, t = nb, nc, nt
                if move < self.tol:
                    break
            out.append(b.copy())
            cuts.append(c)
        return np.asarray(lambdas), np.array(out), np.array(cuts)

    def fit_cv(self, x, y, folds, penalty=None, weight=None):
        """Fit on all rows; return the out-of-fold predictions at the chosen lambda."""
        factor = np.ones(x.shape[1]) if penalty is None else penalty / penalty.sum() * len(penalty)
        m, s = scaler(x)
        self.m, self.s = m, s
        lambdas, coefs, cuts = self.path((x - m) / s, y, factor, None, weight)
        eta = np.full((len(lambdas), len(y)), np.nan)
        losses = []
        for f in np.unique(folds):
            tr, te = folds != f, folds == f
            if self.task == BINARY and len(np.unique(y[tr])) < 2:
                continue  # a fold without both classes says nothing
            fm, fs = scaler(x[tr])
            _, b, c = self.path((x[tr] - fm) / fs, y[tr], factor, lambdas, None if weight is None else weight[tr])
            eta[:, te] = ((x[te] - fm) / fs @ b.T + c).T
            losses.append([self._loss(e, y[te]) for e in eta[:, te]])
        k = int(np.argmin(np.mean(losses, 0))) if losses else len(lambdas) - 1
        self.coef, self.cut, self.lam = coefs[k], cuts[k], lambdas[k]
        z = eta[k]
        return np.where(np.isfinite(z) & (np.abs(z) <= 1e4), z, 0.0)

    def predict(self, x):
        return (x - self.m) / self.s @ self.coef + self.cut


class Tree:
    """One regression tree on binned columns, grown level by level from first and second derivatives."""

    def __init__(self, depth: int, share: float, weights: np.ndarray | None, rng, min_child: float = 1.0, l2: float = 1.0):
        self.depth, self.share, self.weights, self.rng, self.min_child, self.l2 = depth, share, weights, rng, min_child, l2

    def fit(self, bins, n_bins, g, h):
        """``node`` is each row's leaf. A node's rows are counted for the features it drew alone, in the order of the rows."""
        n, p = bins.shape
        node = np.zeros(n, np.int64)
        self.feature, self.cut, self.value = [], [], [[0.0]]
        k = max(1, min(p, int(round(self.share * p))))
        columns = bins.T
        for level in range(self.depth + 1):
            m = 1 << level
            gs, hs = np.bincount(node, g, m), np.bincount(node, h, m)
            self.value.append(list(-gs / (hs + self.l2)))
            if level == self.depth:
                break
            prob = None if self.weights is None or self.weights.sum() <= 0 else self.weights / self.weights.sum()
            feat, cut = np.full(m, -1), np.zeros(m, np.int64)
            size = np.bincount(node, minlength=m)
            order = np.argsort(node.astype(np.min_scalar_type(m)), kind="stable")
            ends = np.cumsum(size)
            some = k if prob is None else min(k, int((prob > 0).sum()))
            for q in np.flatnonzero(size):
                drawn = np.sort(self.rng.choice(p, some, replace=False, p=prob))
                if size[q] == 1:
                    continue  # no cut leaves rows on both sides
                at = order[ends[q] - size[q] : ends[q]]
                gq, hq = g[at], h[at]
                gl, hl = np.empty((some, n_bins)), np.empty((some, n_bins))
                for i, j in enumerate(drawn):
                    b = columns[j][at]
                    gl[i], hl[i] = np.bincount(b, gq, n_bins), np.bincount(b, hq, n_bins)
                gl, hl = np.cumsum(gl, 1)[:, :-1], np.cumsum(hl, 1)[:, :-1]
                hr = hs[q] - hl
                gain = gl**2 / (hl + self.l2) + (gs[q] - gl) ** 2 / (hr + self.l2) - gs[q] ** 2 / (hs[q] + self.l2)
                gain[(hl < self.min_child) | (hr < self.min_child)] = -1
                best = int(gain.argmax())  # the first of equals: least feature, then least cut
                if gain.flat[best] > 1e-9:
                    feat[q], cut[q] = drawn[best // (n_bins - 1)], best % (n_bins - 1)
            self.feature.append(feat)
            self.cut.append(cut)
            node = self._down(bins, node, feat, cut)
        self.node = node
        return self

    @staticmethod
    def _down(bins, node, feat, cut):
        f = feat[node]
        right = (f >= 0) & (bins[np.arange(len(node)), np.maximum(f, 0)] > cut[node])
        return node * 2 + right

    def predict(self, bins):
        node = np.zeros(len(bins), np.int64)
        for f, c in zip(self.feature, self.cut):
            node = self._down(bins, node, f, c)
        return np.asarray(self.value[-1])[node]

    def fitted(self):
        """Predictions of the rows of the fit, whose leaves are let go."""
        node, self.node = self.node, None
        return np.asarray(self.value[-1])[node]


class _Binned:
    n_bins = 64

    def _cuts(self, x):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.n_bins + 1)[1:-1])) for c in x.T]

    def _bins(self, x):
        """(rows, features), a byte each, a feature's rows side by side."""
        out = np.empty((x.shape[1], len(x)), np.min_scalar_type(self.n_bins - 1))
        for row, e, c in zip(out, self.edges, x.T):
            row[:] = np.searchsorted(e, c)
        return out.T


class Boosted(_Binned):
    """L2: gradient boosting; features are drawn for every node in proportion to their importance."""

    def __init__(self, task: str = BINARY, rounds: int = 50, depth: int = 6, eta: float = 0.3, share: float = 0.2, least: int = 30):
        self.task, self.rounds, self.depth, self.eta, self.share, self.least = task, rounds, depth, eta, share, least

    def fit(self, x, y, importance=None, penalty=None, weight=None, seed=42):
        rng = np.random.default_rng(seed)
        w = np.ones(len(y)) if weight is None else weight
        self._cuts(x)
        bins = self._bins(x)
        share = max(self.share, min(1.0, self.least / x.shape[1]))
        mean = float(w @ y / w.sum())
        self.base = float(logit(np.array(mean))) if self.task == BINARY else mean
        z, self.trees = np.full(len(y), self.base), []
        self.gains = np.zeros(x.shape[1])
        for _ in range(self.rounds):
            p = sigmoid(z) if self.task == BINARY else z
            g, h = w * (p - y), w * (p * (1 - p) if self.task == BINARY else np.ones(len(y)))
            t = Tree(self.depth, share, importance, rng).fit(bins, self.n_bins, g, np.maximum(h, 1e-12))
            for f in t.feature:
                np.add.at(self.gains, f[f >= 0], 1)
            z = z + self.eta * t.fitted()
            self.trees.append(t)
        return self

    def predict(self, x):
        bins = self._bins(x)
        return self.base + self.eta * sum(t.predict(bins) for t in self.trees)


class Forest(_Binned):
    """L3, L4: bagged trees; important features are drawn more often at every node."""

    def __init__(self, task: str = BINARY, trees: int = 50, depth: int = 8):
        self.task, self.n, self.depth = task, trees, depth

    def fit(self, x, y, importance=None, penalty=None, weight=None, seed=42):
        rng = np.random.default_rng(seed)
        w = np.ones(len(y)) if weight is None else weight
        self._cuts(x)
        bins = self._bins(x)
        share = np.sqrt(x.shape[1]) / x.shape[1] if self.task == BINARY else 1 / 3
        self.trees = []
        for _ in range(self.n):
            draw = rng.multinomial(len(y), w / w.sum()).astype(float)
            self.trees.append(Tree(self.depth, share, importance, rng, l2=1e-9).fit(bins, self.n_bins, -draw * y, draw))
            self.trees[-1].node = None
        return self

    def predict(self, x):
        bins = self._bins(x)
        mean = np.mean([t.predict(bins) for t in self.trees], 0)
        return logit(mean) if self.task == BINARY else mean


class Kernel:
    """RBF machine on standardised columns scaled by importance; logistic or squared loss with a ridge of 1 / C.

    The exact kernel up to ``exact`` training rows, random Fourier features beyond; in out-of-fold fits the cell's rows
    decide for all models. Features are made anew for a block of rows at a time and never held for all of them.
    """

    block = 4096

    def __init__(self, task: str = BINARY, c: float = 1.0, exact: int = 2000, features: int = 512, steps: int = 30):
        self.task, self.c, self.exact, self.d, self.steps = task, c, exact, features, steps

    def _scaled(self, x):
        return (x - self.m) / self.s * self.scale

    def _map(self, x):
        u = self._scaled(x)
        if self.train is not None:
            d = (u * u).sum(1)[:, None] + (self.train * self.train).sum(1)[None] - 2 * u @ self.train.T
            return np.exp(-self.gamma * np.maximum(d, 0))
        return np.sqrt(2 / self.d) * np.cos(u @ self.w + self.b)

    def _blocks(self, n: int):
        return (slice(s, s + self.block) for s in range(0, n, self.block))

    def fit(self, x, y, importance=None, penalty=None, weight=None, seed=42):
        rng = np.random.default_rng(seed)
        self.m, self.s = scaler(x)
        self.scale = np.ones(x.shape[1]) if importance is None else importance
        exact = len(x) <= self.exact
        if exact:
            self.train = self._scaled(x)
            var = self.train.var()
        else:
            self.train = None
            mean = sum(self._scaled(x[s]).sum() for s in self._blocks(len(x))) / x.size
            var = sum(((self._scaled(x[s]) - mean) ** 2).sum() for s in self._blocks(len(x))) / x.size
        self.gamma = 1 / max(x.shape[1] * var, 1e-12)
        self.w = None if exact else rng.standard_normal((x.shape[1], self.d)) * np.sqrt(2 * self.gamma)
        self.b = None if exact else rng.uniform(0, 2 * np.pi, self.d)
        wt = np.ones(len(y)) if weight is None else weight
        if exact:
            k = np.c_[self._map(x), np.ones(len(x))]
            parts, size = [(k, slice(None))], k.shape[1]
        else:
            parts, size = None, self.d + 1
        pen = np.zeros((size,) * 2)
        pen[:-1, :-1] = (k[:, :-1] if exact else np.eye(self.d)) / self.c
        v = np.zeros(size)
        for _ in range(self.steps if self.task == BINARY else 1):
            grad, curve = np.zeros(size), np.zeros((size,) * 2)
            for kk, at in parts or ((np.c_[self._map(x[s]), np.ones(len(x[s]))], s) for s in self._blocks(len(x))):
                z = kk @ v
                p = sigmoid(z) if self.task == BINARY else z
                h = wt[at] * (np.maximum(p * (1 - p), 1e-6) if self.task == BINARY else 1.0)
                grad += kk.T @ (wt[at] * (p - y[at]))
                if exact:
                    curve += kk.T @ (kk * h[:, None])
                else:  # half the products: the sum is symmetric
                    kk *= np.sqrt(h)[:, None]
                    curve += kk.T @ kk
            move = np.linalg.solve(curve + pen + 1e-6 * np.eye(size), grad + pen @ v)
            v = v - move
            if np.abs(move).max() < 1e-8:
                break
        self.coef, self.cut = v[:-1], v[-1]
        return self

    def predict(self, x):
        out = np.empty(len(x))
        for s in self._blocks(len(x)):
            out[s] = self._map(x[s]) @ self.coef + self.cut
        return out


LEARNERS = {"lasso": Lasso, "boosted": Boosted, "forest": Forest, "kernel": Kernel}


def _form(name: str, y, options: dict) -> dict:
    if name == "kernel" and len(y) > options.get("exact", Kernel().exact):
        return options | {"exact": 0}  # the folds' models take the form of the final one
    return options


def held_out(task: str, y, folds, fold: int):
    """(training, held-out) rows of a fold; None if it is empty or the others lack a class."""
    tr, te = folds != fold, folds == fold
    return None if not te.any() or task == BINARY and len(np.unique(y[tr])) < 2 else (tr, te)


def fit_fold(name: str, task: str, cell_y, x, y, test_x, importance=None, penalty=None, weight=None, seed: int = 42, **options):
    """Predictions of a fold's rows by a model of the others; ``cell_y``: the labels of both."""
    return LEARNERS[name](task, **_form(name, cell_y, options)).fit(x, y, importance, penalty, weight, seed).predict(test_x)


def fit_whole(name: str, task: str, x, y, folds, importance=None, penalty=None, weight=None, seed: int = 42, **options):
    """(model fitted on all rows, out-of-fold predictions if the learner's fit makes them)."""
    model = LEARNERS[name](task, **_form(name, y, options))
    if name == "lasso":
        return model, model.fit_cv(x, y, folds, penalty, weight)
    return model.fit(x, y, importance, penalty, weight, seed), None


def fit_out_of_fold(name: str, task: str, x, y, folds, importance=None, penalty=None, weight=None, seed: int = 42, **options):
    """L0: (model fitted on all rows, out-of-fold predictions)."""
    model, out = fit_whole(name, task, x, y, folds, importance, penalty, weight, seed, **options)
    if out is None:
        out = np.zeros(len(y))
        for f in np.unique(folds):
            at = held_out(task, y, folds, f)
            if at:
                tr, te = at
                out[te] = fit_fold(name, task, y, x[tr], y[tr], x[te], importance, penalty, None if weight is None else weight[tr], seed, **options)
    return model, out
