"""Numeric properties of learners, meta-learners, stackers and the experiment driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorforge.functions import kernels, meta
from priorforge.operators import selection, splits
from priorforge.plans import experiment

RNG = np.random.default_rng(0)


def data(n=240, p=12, task="binary"):
    x = RNG.standard_normal((n, p)) * RNG.uniform(0.5, 3, p)
    s = 1.5 * x[:, 0] / x[:, 0].std() - x[:, 1] / x[:, 1].std()
    y = (s + 0.5 * RNG.standard_normal(n) > 0).astype(float) if task == "binary" else s + 0.1 * RNG.standard_normal(n)
    return x, y, np.arange(n) % 5


@pytest.mark.parametrize("task", ["binary", "regression"])
def test_lasso_meets_the_optimality_conditions(task):
    x, y, folds = data(task=task)
    penalty = RNG.uniform(0.5, 2, x.shape[1])
    m = kernels.Lasso(task, tol=1e-10, max_iter=5000)
    z = m.fit_cv(x, y, folds, penalty)
    xs = (x - m.m) / m.s
    grad = xs.T @ (y - m._mean(xs @ m.coef + m.cut)) / len(y)
    factor = penalty / penalty.sum() * len(penalty) * m.lam
    on = m.coef != 0
    assert np.allclose(grad[on], np.sign(m.coef[on]) * factor[on], atol=1e-4) and np.all(np.abs(grad[~on]) <= factor[~on] + 1e-4)
    assert np.corrcoef(z, y)[0, 1] > 0.7


@pytest.mark.parametrize("name", ["lasso", "boosted", "forest", "kernel"])
@pytest.mark.parametrize("task", ["binary", "regression"])
def test_learners_learn(name, task):
    x, y, folds = data(task=task)
    options = {"trees": 15, "depth": 6} if name == "forest" else {"rounds": 20} if name == "boosted" else {}
    model, z = kernels.fit_out_of_fold(name, task, x, y, folds, np.ones(x.shape[1]), np.ones(x.shape[1]), **options)
    assert (meta.score("auroc", y, z) > 0.8) if task == "binary" else (np.mean((y - z) ** 2) < 0.6 * y.var())
    assert model.predict(x).shape == y.shape


def test_random_features_stand_for_the_kernel():
    x, y, folds = data()
    m = kernels.Kernel("binary", exact=100).fit(x, y)
    assert m.train is None and meta.score("auroc", y, m.predict(x)) > 0.85


@pytest.mark.parametrize("kind", [meta.DEFAULT, meta.NONEG, meta.SIMPLEX])
def test_meta_weights(kind):
    x, y, folds = data()
    z = np.stack([x[:, 0], -x[:, 0], RNG.standard_normal(len(y))], 1)
    w, b = meta.fit_meta(z, y, folds, kind=kind)
    assert b == 0.0 and w[0] > 0
    if kind != meta.DEFAULT:
        assert (w >= 0).all()
    if kind == meta.SIMPLEX:
        assert w.sum() == pytest.approx(1)
    w, b = meta.fit_meta(z, y, folds, kind=meta.NONEG, intercept=True)
    assert (w >= 0).all() and b != 0


def test_meta_regression_and_classes():
    x, y, folds = data(task="regression")
    w, b = meta.fit_meta(np.stack([y + 0.1, -y, x[:, 5]], 1), y, folds, task="regression")
    assert (w >= 0).all() and w[0] > 0.8 and w[1] == 0
    y3 = np.arange(90) % 3
    z = np.stack([np.stack([(y3 == c) * 2.0 - 1, RNG.standard_normal(90)], 1) for c in range(3)])
    w, b = meta.fit_multiclass(z, y3, np.arange(90) % 5, [0, 1, 2])
    assert w.shape == (3, 2) and (w[:, 0] > 0).all()


def test_simplex_projection():
    v = meta.simplex(np.array([0.2, 3.0, -1.0]))
    assert v.sum() == pytest.approx(1) and (v >= 0).all()


@pytest.mark.parametrize("kind", [meta.BASE, meta.GREEDY, meta.STRATIFIED, meta.PRESELECTED, meta.POSTSELECTED, meta.POSTSELECTED_STRATIFIED])
def test_stackers(kind):
    x, y, folds = data()
    z = np.stack([x[:, 0], x[:, 0] - 0.5 * x[:, 1], RNG.standard_normal(len(y)), RNG.standard_normal(len(y)), -x[:, 0], -x[:, 0]], 1)
    w, b = meta.stack(z, y, folds, ["a", "a", "b", "b", "c", "c"], [True, False] * 3, kind, top=1)
    assert meta.score("auroc", y, z @ w + b) > 0.75
    if kind in (meta.PRESELECTED, meta.POSTSELECTED, meta.POSTSELECTED_STRATIFIED):
        assert not w[2:].any()


def hopeless(learner):
    """Test predictions of a learner's stack where the folds' predictions go against their rows, so no member gets a weight."""
    x, folds = np.zeros((80, 3)), np.arange(80) % 2
    y = np.where(np.arange(80) % 8 < 6, 1 - folds, folds).astype(float)
    stack = experiment.learner_study(learner)[-1]
    return experiment.run_cell(stack, "binary", x, y, np.zeros((7, 3)), np.ones(3), folds, 1)


def test_a_lasso_stack_without_weights_still_predicts_every_row():
    z = hopeless("lasso")
    assert z.tolist() == [0.0] * 7 and meta.score("auroc", np.arange(7) % 2, z) == 0.5


def test_a_boosted_stack_without_weights_still_predicts_every_row():
    z = hopeless("boosted")
    assert z.tolist() == [0.0] * 7 and meta.score("mcc", np.arange(7) % 2, z) == 0.0


def test_score_equals_the_definition():
    y, z = np.array([0, 1, 1, 0.0]), np.array([0.1, 0.1, 0.5, -0.4])
    assert meta.score("auroc", y, z) == pytest.approx(3.5 / 4)
    assert meta.score("mcc", y, np.ones(4)) == 0.0


def test_model_selectors():
    x, y, _ = data()
    assert 0 in selection.by_model(x, y, 2) and 0 in selection.by_model(x, y, 2, "path") and 0 in selection.by_model(x, y, 4, "elimination", step=4)


def test_a_perfect_prior_helps_and_work_resumes(spark):
    rng = np.random.default_rng(5)
    n, p = 160, 60
    x = rng.standard_normal((n, p))
    y = ((x[:, :4].sum(1) + 0.8 * rng.standard_normal(n)) > 0).astype(float)
    df = spark.createDataFrame([(k, float(y[k]), x[k].tolist()) for k in range(n)], "row_id long, label double, features array<double>")
    plan = splits.shuffle_split(df, [(0, 0.5, 0.3)], 4)
    scores = spark.createDataFrame([(j, 1.0 if j < 4 else 0.1) for j in range(p)], "j int, score double")
    study = experiment.Study(cv=4, methods=experiment.learner_study("lasso", (0.0, 1.0))[:2])
    got = experiment.run(df, plan, scores, study).cache()
    auc = {r.name: r.a for r in got.groupBy("name").agg(F.avg("auroc").alias("a")).collect()}
    assert got.count() == 8 and auc["lasso_t1"] > auc["lasso_t0"] - 0.005
    left = experiment.run(df, plan, scores, study, done=got.filter("split_idx < 3"))
    assert left.count() == 2 and {r.split_idx for r in left.collect()} == {3}


def test_a_boosted_study_without_weights_gives_every_row(spark):
    """Twins of opposite labels: the one in another fold teaches the wrong label, so the stack takes no member."""
    df = spark.createDataFrame([(k, float(k % 2), [float(k // 2)] * 3) for k in range(67)], "row_id long, label double, features array<double>")
    plan = spark.createDataFrame([(0, 0.9, 0, k, "train" if k < 60 else "test") for k in range(67)], "ratio_idx int, train_ratio double, split_idx int, row_id long, part string")
    scores = spark.createDataFrame([(j, 0.1 + j / 3) for j in range(3)], "j int, score double")
    got = {r.name: r for r in experiment.run(df, plan, scores, experiment.Study(methods=experiment.learner_study("boosted"))).collect()}
    assert set(got) == {"boosted_t0", "boosted_t1", "boosted_t2", "oof_positive"}
    z = got["oof_positive"]
    assert (z.accuracy, z.misclass, z.auroc, z.mcc) == (pytest.approx(4 / 7), pytest.approx(3 / 7), 0.5, 0.0)


def test_preselected_features_reach_the_model(spark):
    x, y, _ = data(150, 10)
    df = spark.createDataFrame([(k, float(y[k]), x[k].tolist()) for k in range(150)], "row_id long, label double, features array<double>")
    plan = splits.shuffle_split(df, [(0, 0.6, 0.3)], 2)
    chosen = experiment.preselect(df, plan, 3, "path")
    assert chosen.groupBy("split_idx").count().filter("count <= 3").count() == 2 and chosen.filter("feature = 0").count() == 2
    scores = spark.createDataFrame([(j, 0.5) for j in range(10)], "j int, score double")
    got = experiment.run(df, plan, scores, experiment.Study(cv=3, methods=[experiment.ridge()]), preselected=chosen)
    assert min(r.auroc for r in got.collect()) > 0.8


def plain_tree(bins, n_bins, g, h, depth, k, weights, rng, l2):
    """Every node's cut by its definition: the best gain over the features drawn for it."""
    node, cuts = np.zeros(len(bins), int), []
    for level in range(depth):
        m = 1 << level
        gs, hs = np.bincount(node, g, m), np.bincount(node, h, m)
        feat, cut = np.full(m, -1), np.zeros(m, int)
        for q in np.unique(node):
            best = 1e-9
            for j in np.sort(rng.choice(bins.shape[1], k, replace=False, p=weights / weights.sum())):
                gl, hl = (np.cumsum(np.bincount(bins[node == q, j], v[node == q], n_bins))[:-1] for v in (g, h))
                gain = gl**2 / (hl + l2) + (gs[q] - gl) ** 2 / (hs[q] - hl + l2) - gs[q] ** 2 / (hs[q] + l2)
                gain[(hl < 1) | (hs[q] - hl < 1)] = -1
                if gain.max() > best:
                    best, feat[q], cut[q] = gain.max(), j, gain.argmax()
        cuts.append((feat, cut))
        node = node * 2 + ((feat[node] >= 0) & (bins[np.arange(len(bins)), feat[node]] > cut[node]))
    return cuts, node


@pytest.mark.parametrize("l2", [1e-9, 1.0])
def test_a_tree_counts_a_row_for_drawn_features_alone(l2, monkeypatch):
    n, p, k, depth = 3000, 40, 5, 6
    rng = np.random.default_rng(11)
    bins, weights = rng.integers(0, 16, (n, p)), rng.uniform(0.1, 1, p)
    draw = rng.multinomial(n, np.full(n, 1 / n)).astype(float)
    g = -draw * (bins[:, 3] + rng.integers(0, 9, n) > 12)
    want, leaf = plain_tree(bins, 16, g, draw, depth, k, weights, np.random.default_rng(5), l2)
    counted, count = [], np.bincount
    monkeypatch.setattr(kernels.np, "bincount", lambda x, *a, **kw: (counted.append(len(x)), count(x, *a, **kw))[1])
    got = kernels.Tree(depth, k / p, weights, np.random.default_rng(5), l2=l2).fit(bins, 16, g, draw)
    assert sum(counted) <= (depth + 1) * n * (2 * k + 3)
    for (f, c), gf, gc in zip(want, got.feature, got.cut):
        assert f.tolist() == gf.tolist() and c.tolist() == gc.tolist()
    assert got.node.tolist() == leaf.tolist()


def test_boosting_takes_leaves_from_the_fit(monkeypatch):
    x, y, _ = data()
    monkeypatch.setattr(kernels.Tree, "predict", None)  # a second walk of the training rows
    m = kernels.Boosted(rounds=3).fit(x, y)
    monkeypatch.undo()
    assert all(t.node is None for t in m.trees) and m._bins(x).dtype == np.uint8
    assert meta.score("auroc", y, m.predict(x)) > 0.8


@pytest.mark.parametrize("task", ["binary", "regression"])
def test_random_features_are_made_by_blocks(task):
    """Many blocks give what one gives, and 20,000 rows of 513 features (82 MB) are never held at once."""
    import tracemalloc

    x, y, _ = data(700, task=task)
    one, many = kernels.Kernel(task, exact=0), kernels.Kernel(task, exact=0)
    one.block, many.block = 700, 64
    assert np.allclose(one.fit(x, y).predict(x), many.fit(x, y).predict(x), rtol=1e-6, atol=1e-8)
    x, y, _ = data(20000, task=task)
    tracemalloc.start()
    kernels.Kernel(task, steps=1).fit(x, y).predict(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75e6
