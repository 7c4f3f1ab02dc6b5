"""Feature selection (F0-F9): each returns (rank, feature, score) rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .ranking import hash_order, top_k


def _ranked(df: DataFrame, k: int) -> DataFrame:
    best = top_k(df, k, F.desc("score"), F.col("feature"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature"))).select("rank", "feature", "score")


def by_score(scores: DataFrame, k: int) -> DataFrame:
    """The prior's best features."""
    return _ranked(scores.select("feature", "score"), k)


def at_random(names: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """F5."""
    picked = names.select("feature").withColumn("h", hash_order(seed, "feature"))
    return top_k(picked, k, F.col("h")).withColumn("rank", F.row_number().over(Window.orderBy("h"))).select("rank", "feature")


def binned(long: DataFrame, bins: int = 8) -> DataFrame:
    """(row_id, j, b): equal-width bins between each feature's least and greatest value."""
    span = long.groupBy("j").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    return long.join(F.broadcast(span), "j").select("row_id", "j", b.cast("int").alias("b"))


def _information(counts: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mutual information of a and b from cell counts n, by keys."""
    w = lambda *c: F.sum("n").over(Window.partitionBy(*keys, *c)).cast("double")
    p = F.col("n").cast("double")
    cells = counts.withColumn("t", p / w() * F.ln(p * w() / (w(a) * w(b))))
    return cells.groupBy(*keys).agg(F.sum("t").alias("score"))


def mutual_information(long: DataFrame, labels: DataFrame, bins: int = 8) -> DataFrame:
    """F2: (feature, score) in nats between each binned feature and the label (row_id, y)."""
    cells = binned(long, bins).join(labels, "row_id").groupBy("j", "b", "y").agg(F.count("*").alias("n"))
    return _information(cells, ["j"], "b", "y").withColumnRenamed("j", "feature")


def by_information(long: DataFrame, labels: DataFrame, k: int, bins: int = 8) -> DataFrame:
    return _ranked(mutual_information(long, labels, bins), k)


def redundancy(long: DataFrame, bins: int = 8) -> DataFrame:
    """(j1, j2, score): information between each two binned features, from one aggregation.

    A row gives the pairs of its own features, so tables are counted before the shuffle; the result has one row a pair.
    """
    rows = binned(long, bins).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("j", "b"))).alias("v"))
    pairs = rows.select(F.explode(F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["j"] > a["j"]), lambda b: F.struct(a["j"].alias("j1"), a["b"].alias("b1"), b["j"].alias("j2"), b["b"].alias("b2")))))).alias("p"))
    cells = pairs.select("p.*").groupBy("j1", "j2", "b1", "b2").agg(F.count("*").alias("n"))
    return _information(cells, ["j1", "j2"], "b1", "b2")


def mrmr(long: DataFrame, labels: DataFrame, k: int, bins: int = 8) -> DataFrame:
    """greedy: information with the label less the mean information with the features taken before.

    The two small tables (features, pairs of features) go to the driver; ties go to the lesser feature.
    """
    gain = {r.feature: r.score for r in mutual_information(long, labels, bins).collect()}
    both = {}
    for r in redundancy(long, bins).collect():
        both[r.j1, r.j2] = both[r.j2, r.j1] = r.score
    taken: list[tuple[int, int, float]] = []
    left = sorted(gain)
    while left and len(taken) < k:
        value = {j: gain[j] - (np.mean([both[j, t] for _, t, _ in taken]) if taken else 0.0) for j in left}
        best = max(left, key=lambda j: (round(value[j], 12), -j))
        taken.append((len(taken) + 1, best, float(value[best])))
        left.remove(best)
    return long.sparkSession.createDataFrame(taken, "rank int, feature int, score double")


def by_model(x: np.ndarray, y: np.ndarray, k: int, method: str = "boosted", task: str = "binary", seed: int = 42, step: int = 10) -> list[int]:
    """indices by split counts of boosted trees, by recursive elimination, or along the lasso path."""
    from ..functions.kernels import Boosted, Lasso, scaler

    if method == "boosted":
        gains = Boosted(task).fit(x, y, seed=seed).gains
        return np.lexsort((np.arange(len(gains)), -gains))[:k].tolist()
    m, s = scaler(x)
    z = (x - m) / s
    if method == "path":
        _, coefs, _ = Lasso(task).path(z, y, np.ones(x.shape[1]))
        some = [c for c in coefs if 0 < np.count_nonzero(c) <= k]
        return [] if not some else [int(j) for j in np.argsort(-np.abs(some[-1]), kind="stable") if some[-1][j]]
    left = np.arange(x.shape[1])
    while len(left) > k:
        _, coefs, _ = Lasso(task, mix=0.01, n_lambda=10).path(z[:, left], y, np.ones(len(left)))
        drop = np.argsort(np.abs(coefs[-1]), kind="stable")[: min(step, len(left) - k)]
        left = np.delete(left, drop)
    return left.tolist()
