"""Experiments (O1-O3, H1, H4-H6): every (method, ratio, split) cell is a row; tasks fit its members' folds, results resume."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import meta
from ..functions.kernels import BINARY, LEARNERS, fit_fold, fit_out_of_fold, fit_whole, held_out, scaler
from ..operators.prior import EXP, POWER, SQRT, PriorConfig
from ..operators.results import pending
from ..operators.selection import by_model

RESULT_DDL = "name string, display_name string, is_baseline boolean, ratio_idx int, train_ratio double, split_idx int, accuracy double, misclass double, auroc double, mcc double, mse double"


@dataclass(frozen=True)
class Member:
    learner: str
    prior: PriorConfig | None = None  # None: uniform
    options: tuple = ()


@dataclass(frozen=True)
class Method:
    """A named way from training rows to test predictions: one member, or a stack of several."""

    name: str
    members: tuple[Member, ...]
    stack: str = meta.BASE
    meta: str = meta.NONEG
    metric: str = "mcc"
    is_baseline: bool = False


@dataclass
class Study:
    task: str = BINARY
    cv: int = 5
    seed: int = 42
    methods: list[Method] = field(default_factory=list)


def ensemble(name: str = "ensemble", learners=("lasso", "forest", "boosted", "kernel"), temperatures=(1.0, 2.0), **kw) -> Method:
    """A base member of every learner, and one for each temperature."""
    members = [Member(a, None) for a in learners] + [Member(a, PriorConfig(t)) for a in learners for t in temperatures]
    return Method(name, tuple(members), **kw)


def baselines() -> list[Method]:
    """H1, H4: the learners with a uniform prior (shallow trees of rate 0.1 stand for the leaf-wise booster)."""
    slow = Member("boosted", None, (("rounds", 100), ("eta", 0.1)))
    return [Method(f"plain_{a}", (Member(a),), is_baseline=True) for a in ("lasso", "forest", "boosted")] + [Method("plain_slow_boosted", (slow,), is_baseline=True)]


def prior_lasso(temperatures=(0.5, 1.0, 2.0)) -> Method:
    """H5: the best lasso among temperatures, by accuracy."""
    return Method("prior_lasso", (Member("lasso"), *(Member("lasso", PriorConfig(t)) for t in temperatures)), meta.GREEDY, metric="accuracy", is_baseline=True)


def no_prior_stack(learners=("lasso", "forest", "boosted", "kernel")) -> Method:
    """H6: the stack without any prior."""
    return Method("stack_no_prior", tuple(Member(a) for a in learners), is_baseline=True)


def _importance(scores: np.ndarray, c: PriorConfig | None) -> tuple[np.ndarray, np.ndarray]:
    c = c or PriorConfig(0.0)
    t = c.temperature
    s = np.ones(len(scores)) if t == 0 else np.exp(c.exp_tau * t * scores) if c.feature_map == EXP else np.sqrt(scores + c.eps) ** t if c.feature_map == SQRT else (scores + c.eps) ** (t * (c.power if c.feature_map == POWER else 1))
    return s / (s.mean() + c.eps), (scores + c.eps) ** -t


def _weights(x: np.ndarray, importance: np.ndarray, c: PriorConfig | None) -> np.ndarray | None:
    if c is None or c.temperature == 0 or c.beta == 0:
        return None
    m, s = scaler(x)
    h = np.abs((x - m) / s) ** c.power
    cos = h @ importance / np.maximum(np.linalg.norm(importance) * np.linalg.norm(h, axis=1), 1e-12)
    w = (cos - cos.min()) / (cos.max() - cos.min() + c.eps)
    return w**c.beta if c.sample_map == POWER else np.exp(c.beta * w) if c.sample_map == EXP else 1 - c.beta + c.beta * w


def _combine(method: Method, task: str, y, folds, oof: list, tests: list) -> np.ndarray:
    """Test predictions of a method from its members' out-of-fold columns and test predictions."""
    if len(tests) == 1:
        return tests[0]
    w, b = meta.stack(np.stack(oof, 1), y, folds, [m.learner for m in method.members], [m.prior is None for m in method.members], method.stack, task, method.meta, method.metric)
    return np.full(len(tests[0]), b) + sum(v * t for v, t in zip(w, tests) if v)  # no member may have a weight


def _options(m: Member, x, scores) -> tuple:
    """(importance, penalty, row weights) of a member, as the learners take them."""
    importance, penalty = _importance(scores, m.prior)
    return importance if m.prior else None, penalty, _weights(x, importance, m.prior)


def run_cell(method: Method, task: str, x, y, test_x, scores, folds, seed: int) -> np.ndarray:
    """Test predictions: out-of-fold columns, stack weights, and a weighted sum of the members with a weight."""
    oof, tests = [], []
    for m in method.members:
        model, z = fit_out_of_fold(m.learner, task, x, y, folds, *_options(m, x, scores), seed, **dict(m.options))
        oof.append(z)
        tests.append(model.predict(test_x))
    return _combine(method, task, y, folds, oof, tests)


def preselect(data: DataFrame, splits: DataFrame, k: int, method: str = "boosted", task: str = BINARY, seed: int = 42) -> DataFrame:
    """F8: (ratio_idx, split_idx, rank, feature): the features that a selector takes on each cell's training rows."""
    rows = splits.filter("part = 'train'").join(data, "row_id")

    def pick(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        got = by_model(np.stack(pdf.features.to_list()).astype(float), pdf.label.to_numpy(float), k, method, task, seed)
        return pd.DataFrame({"ratio_idx": key[0], "split_idx": key[1], "rank": range(1, len(got) + 1), "feature": got})

    return rows.groupBy("ratio_idx", "split_idx").applyInPandas(pick, "ratio_idx int, split_idx int, rank int, feature int")


def ridge(name: str = "ridge_selected") -> Method:
    """the L2 model, for use on preselected features."""
    return Method(name, (Member("lasso", None, (("mix", 0.0), ("n_lambda", 20))),), is_baseline=True)


WHOLE = -1  # the unit that fits a member on all training rows and predicts the test rows
UNIT_DDL = "ratio_idx int, split_idx int, train_ratio double, unit int, z binary, test binary, y binary, test_y binary"
COST = {"lasso": 6, "kernel": 3, "boosted": 2, "forest": 1}  # of one unit, roughly: the longest start first


def _units(methods: list[Method], cv: int) -> tuple[list[tuple[Member, int]], list[tuple[int, int]]]:
    """((member, fold) units, (method, unit) pairs): methods that have a member in common share its units.

    A lasso finds its lambda and its out-of-fold predictions in one pass, so it is one unit.
    """
    wanted: dict[tuple[Member, int], list[int]] = {}
    for k, method in enumerate(methods):
        for m in dict.fromkeys(method.members):
            for f in [WHOLE, *(range(cv) if len(method.members) > 1 and m.learner != "lasso" else [])]:
                wanted.setdefault((m, f), []).append(k)
    units = sorted(wanted, key=lambda u: (-COST[u[0].learner] * dict(u[0].options).get("rounds", 50), u[1]))
    return units, [(k, i) for i, u in enumerate(units) for k in wanted[u]]


def _folds(y, task: str, cv: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    folds = np.zeros(len(y), int)
    for c in np.unique(y) if task == BINARY else [None]:
        at = np.flatnonzero(y == c) if c is not None else np.arange(len(y))
        folds[rng.permutation(at)] = np.arange(len(at)) % cv
    return folds


def _deal(df: DataFrame, name: str, count: int, *order: str) -> DataFrame:
    """A task for each of the ``count`` values of ``name`` in a cell, cells spread if there are few; sorted in groups."""
    spread = max(1, 2 * df.sparkSession.sparkContext.defaultParallelism // count)
    at = F.pmod(F.hash("ratio_idx", "split_idx"), F.lit(spread)) * count + F.col(name)
    return df.repartitionById(spread * count, at.cast("int")).sortWithinPartitions("ratio_idx", "split_idx", name, *order)


def _groups(batches, keys: list[str]):
    """(key, batches) of each group in a stream that is sorted by ``keys``."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for s, e in zip(cuts, cuts[1:]):
            key = tuple(k[s].tolist())
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(b.slice(s, e - s))
    if held:
        yield now, held


def _matrix(batches: list, keep: list[np.ndarray], some: list[int] | None) -> np.ndarray:
    """Rows of the column ``features`` that ``keep`` marks, as doubles."""
    out, at = None, 0
    for b, k in zip(batches, keep):
        v = b.column("features")
        width = np.unique(v.value_lengths().to_numpy(zero_copy_only=False))
        if v.null_count or len(width) > 1 or out is not None and width != wide:
            raise ValueError("features have to be vectors of one length")
        if out is None:
            wide = width
            out = np.empty((sum(map(np.count_nonzero, keep)), len(some or range(width[0]))), order="F")
        part = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)[k]
        out[at : at + len(part)] = part[:, some] if some else part
        at += len(part)
    return out


def run(data: DataFrame, splits: DataFrame, scores: DataFrame, study: Study, done: DataFrame | None = None, preselected: DataFrame | None = None) -> DataFrame:
    """Results of all cells that ``done`` lacks; with ``preselected`` (as of :func:`preselect`) on those features alone.

    data: (row_id, label, features: ARRAY of FLOAT or DOUBLE); splits: (ratio_idx, train_ratio, split_idx, row_id, part);
    scores: (j, score). A (ratio, split, member, fold) is fitted in one task, which has that split's rows in memory;
    members that several methods have are fitted once. Then each method of a cell is stacked and scored in one task, from
    its members' predictions.
    """
    import pyarrow as pa

    spark = data.sparkSession
    prior = np.array([r.score for r in scores.orderBy("j").select("score").collect()], float)
    task, cv, seed, methods = study.task, study.cv, study.seed, study.methods
    units, pairs = _units(methods, cv)
    need = F.broadcast(spark.createDataFrame([(methods[k].name, k, i) for k, i in pairs], "name string, method int, unit int"))
    cells = splits.select("ratio_idx", "train_ratio", "split_idx").distinct().crossJoin(F.broadcast(spark.createDataFrame([(m.name,) for m in methods], "name string")))
    if done is not None:
        cells = pending(cells, done)
    cells = cells.join(need, "name").select("ratio_idx", "split_idx", "method", "unit")
    whole = F.col("unit").isin([i for i, (_, f) in enumerate(units) if f == WHOLE])
    rows = splits.join(data, "row_id").join(F.broadcast(cells.select("ratio_idx", "split_idx", "unit").distinct()), ["ratio_idx", "split_idx"])
    rows = rows.filter((F.col("part") == "train") | whole).select("ratio_idx", "split_idx", "unit", "row_id", "train_ratio", (F.col("part") == "train").alias("train"), F.col("label").cast("double").alias("label"), "features")
    chosen: dict[tuple, list[int]] = {}
    for r in preselected.orderBy("rank").collect() if preselected is not None else []:  # names of a few cells
        chosen.setdefault((r.ratio_idx, r.split_idx), []).append(r.feature)
    cell_seed = lambda ratio_idx, split_idx: seed + 1000 * ratio_idx + split_idx
    unit_schema = pa.schema([("ratio_idx", pa.int32()), ("split_idx", pa.int32()), ("train_ratio", pa.float64()), ("unit", pa.int32()), *((c, pa.binary()) for c in ("z", "test", "y", "test_y"))])
    types = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}
    result_schema = pa.schema([(c, types[t]) for c, t in (f.split() for f in RESULT_DDL.split(", "))])

    def fit(batches):
        for (ratio_idx, split_idx, unit), held in _groups(batches, ["ratio_idx", "split_idx", "unit"]):
            member, fold = units[unit]
            train = [b.column("train").to_numpy(zero_copy_only=False) for b in held]
            labels = [b.column("label").to_numpy(zero_copy_only=False) for b in held]
            y, ty = (np.concatenate([v[k == want] for v, k in zip(labels, train)]) for want in (True, False))
            some = chosen.get((ratio_idx, split_idx))
            x = _matrix(held, train, some)
            tx = _matrix(held, [~k for k in train], some) if fold == WHOLE else None
            out = dict(ratio_idx=ratio_idx, split_idx=split_idx, train_ratio=held[0].column("train_ratio")[0].as_py(), unit=unit, z=None, test=None, y=None, test_y=None)
            held.clear()
            use, at = prior[some] if some else prior[: x.shape[1]], cell_seed(ratio_idx, split_idx)
            options, folds = _options(member, x, use), _folds(y, task, cv, at)
            if fold == WHOLE:
                model, z = fit_whole(member.learner, task, x, y, folds, *options, at, **dict(member.options))
                out |= dict(z=None if z is None else z.tobytes(), test=model.predict(tx).tobytes(), y=y.tobytes(), test_y=ty.tobytes())
            else:
                parts = held_out(task, y, folds, fold)
                if parts:
                    tr, te = parts
                    importance, penalty, weight = options
                    x, tx = x[tr], x[te]
                    out["z"] = fit_fold(member.learner, task, y, x, y[tr], tx, importance, penalty, None if weight is None else weight[tr], at, **dict(member.options)).tobytes()
            yield pa.RecordBatch.from_pylist([out], schema=unit_schema)

    def assemble(batches):
        for (ratio_idx, split_idx, k), held in _groups(batches, ["ratio_idx", "split_idx", "method"]):
            method = methods[k]
            got = {units[r["unit"]]: r for b in held for r in b.to_pylist()}
            array = lambda v: np.frombuffer(v, float)
            first = got[method.members[0], WHOLE]
            y, ty = array(first["y"]), array(first["test_y"])
            folds = _folds(y, task, cv, cell_seed(ratio_idx, split_idx))
            oof = []
            for m in method.members if len(method.members) > 1 else ():
                z = np.zeros(len(y))
                if m.learner == "lasso":
                    z = array(got[m, WHOLE]["z"])
                for f in range(cv) if m.learner != "lasso" else ():
                    if got[m, f]["z"] is not None:
                        z[folds == f] = array(got[m, f]["z"])
                oof.append(z)
            z = _combine(method, task, y, folds, oof, [array(got[m, WHOLE]["test"]) for m in method.members])
            out = dict(name=method.name, display_name=method.name, is_baseline=method.is_baseline, ratio_idx=ratio_idx, train_ratio=first["train_ratio"], split_idx=split_idx, accuracy=None, misclass=None, auroc=None, mcc=None, mse=None)
            if task == BINARY:
                acc = meta.score("accuracy", ty, z)
                out |= dict(accuracy=acc, misclass=1 - acc, auroc=meta.score("auroc", ty, z), mcc=meta.score("mcc", ty, z))
            else:
                out["mse"] = -meta.score("mse", ty, z)
            yield pa.RecordBatch.from_pylist([out], schema=result_schema)

    fitted = _deal(rows, "unit", len(units), "row_id").mapInArrow(fit, UNIT_DDL)
    parts = fitted.join(F.broadcast(cells), ["ratio_idx", "split_idx", "unit"]).select("ratio_idx", "split_idx", "method", "unit", "train_ratio", "z", "test", "y", "test_y")
    return _deal(parts, "method", len(methods)).mapInArrow(assemble, RESULT_DDL)


def learner_study(learner: str, temperatures=(0.0, 1.0, 2.0)) -> list[Method]:
    """O3: one learner under every prior, and their stack."""
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner}")
    ones = [Method(f"{learner}_t{t:g}", (Member(learner, PriorConfig(t) if t else None),)) for t in temperatures]
    return [*ones, Method("oof_positive", tuple(m.members[0] for m in ones))]
