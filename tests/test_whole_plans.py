"""Queries run every method they stand for."""

from priorforge.plans import experiment, queries


def test_queries_take_all_methods(monkeypatch):
    monkeypatch.setattr(queries, "_study", lambda spark, d, methods, n_splits=1: methods)
    run = lambda name: queries.QUERIES[name](None, "")
    assert run("baselines") == [*experiment.baselines(), experiment.prior_lasso(), experiment.no_prior_stack()]
    for a in ("lasso", "boosted", "forest", "kernel"):
        assert run(f"{a}_fit") == experiment.learner_study(a)
    for m in [*run("stack_base"), *run("stack_variants")]:
        assert {x.learner for x in m.members} == {"lasso", "boosted", "forest", "kernel"}


def test_folds_take_the_form_of_the_final_kernel(monkeypatch):
    import numpy as np

    from priorforge.functions import kernels

    forms, fit = [], kernels.Kernel.fit
    monkeypatch.setattr(kernels.Kernel, "fit", lambda self, *a: (fit(self, *a), forms.append(self.train is None))[0])
    x = np.random.default_rng(1).standard_normal((120, 4))
    for exact, approximate in ((100, True), (120, False)):
        forms.clear()
        kernels.fit_out_of_fold("kernel", "binary", x, (x[:, 0] > 0).astype(float), np.arange(120) % 3, exact=exact)
        assert forms == [approximate] * 4


def test_methods_share_the_fits_of_their_members(monkeypatch):
    """One task for each fold of each member: 3 lassos in one pass each, 9 others with 5 folds and all rows."""
    monkeypatch.setattr(queries, "_study", lambda spark, d, methods, n_splits=1: methods)
    base, variants = (experiment._units(queries.QUERIES[q](None, ""), 5) for q in ("stack_base", "stack_variants"))
    assert len(base[0]) == len(set(base[0])) == 3 + 9 * 6 and base[0] == variants[0]
    assert len(base[1]) == len(base[0]) and sorted(variants[1]) == [(k, u) for k in range(5) for u in range(len(base[0]))]


def test_fits_in_tasks_equal_a_fit_of_the_whole_cell(spark):
    import numpy as np

    from priorforge.functions import meta
    from priorforge.plans.experiment import Member

    rng = np.random.default_rng(3)
    x = rng.standard_normal((130, 5)).astype(np.float32)
    y = (x[:, 0] + rng.standard_normal(130) > 0).astype(float)
    df = spark.createDataFrame([(k, float(y[k]), x[k].tolist()) for k in range(130)], "row_id long, label double, features array<float>")
    cells = [(0, 0.6, 0), (0, 0.6, 1), (1, 0.3, 0)]
    plan = [(*c, k, "test" if (k + c[2]) % 5 == 0 else "train") for c in cells for k in range(130) if c[0] == 0 or k % 5 < 3]
    prior = np.linspace(0.2, 1, 5)
    small = tuple(Member(a, p, o) for a, o in (("lasso", (("n_lambda", 5),)), ("forest", (("trees", 3),)), ("boosted", (("rounds", 3),)), ("kernel", (("exact", 50),))) for p in (None, experiment.PriorConfig(1.0)))
    methods = [experiment.Method(k, small, stack=k) for k in (meta.BASE, meta.GREEDY, meta.STRATIFIED)] + [experiment.Method("one", small[2:3])]
    scores = spark.createDataFrame([(j, float(p)) for j, p in enumerate(prior)], "j int, score double")
    got = {(r.name, r.ratio_idx, r.split_idx): r for r in experiment.run(df, spark.createDataFrame(plan, "ratio_idx int, train_ratio double, split_idx int, row_id long, part string"), scores, experiment.Study(methods=methods)).collect()}
    assert len(got) == len(methods) * len(cells)
    for ratio, share, split in cells:
        tr, te = ([r[3] for r in plan if (r[0], r[2], r[4]) == (ratio, split, part)] for part in ("train", "test"))
        at = 42 + 1000 * ratio + split
        for m in methods:
            z = experiment.run_cell(m, "binary", x[tr].astype(float), y[tr], x[te].astype(float), prior, experiment._folds(y[tr], "binary", 5, at), at)
            r = got[m.name, ratio, split]
            assert (r.train_ratio, r.accuracy, r.auroc, r.mcc) == (share, meta.score("accuracy", y[te], z), meta.score("auroc", y[te], z), meta.score("mcc", y[te], z))


def test_nearest_holds_blocks_and_ties_by_id():
    """3,000 queries against a batch of 10,000: their product alone would be 240 MB."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from priorforge.operators import scoring

    rng = np.random.default_rng(2)
    x = rng.standard_normal((10000, 8)).astype(np.float32)
    x[5000:] = x[rng.integers(0, 300, 5000)]  # copies, some of them more than k
    x[0] = 0
    docs = rng.permutation(10000)
    q = x[rng.integers(1, 10000, 3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(docs), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["doc_id", "embedding"])
    tracemalloc.start()
    got = [np.concatenate(c) for c in zip(*scoring.best_in_stream([batch.slice(0, 6000), batch.slice(6000)], np.arange(3000), q, 5, 256))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and len(got[0]) == 15000
    whole = x.astype(float)
    for k in range(0, 3000, 97):
        dot, a, b = (sum(u[..., j] * v[..., j] for j in range(8)) for u, v in ((q[k].astype(float), whole), (q[k].astype(float),) * 2, (whole, whole)))
        c = dot / np.maximum(np.sqrt(a) * np.sqrt(b), 1e-300)
        order = np.lexsort((docs, -c))[:5]
        at = np.flatnonzero(got[0] == k)
        assert sorted(zip(got[1][at], got[2][at])) == sorted(zip(docs[order], c[order]))


def test_baselines_fit_no_fold_that_no_stack_reads():
    """4 lassos in one pass each, 3 learners with 5 folds and all rows, and the slow booster on all rows alone."""
    methods = [*experiment.baselines(), experiment.prior_lasso(), experiment.no_prior_stack()]
    units, pairs = experiment._units(methods, 5)
    assert len(units) == 4 + 3 * 6 + 1 and len(pairs) == len(set(pairs))
    assert [f for m, f in units if m.options] == [experiment.WHOLE]
