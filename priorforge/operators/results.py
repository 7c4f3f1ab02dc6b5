"""The results table: summaries, win ratios, replacement, pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

METRICS = ("accuracy", "misclass", "auroc", "mcc", "mse")


def summary(results: DataFrame, metric: str, keys: tuple[str, ...] = ("name", "train_ratio"), order: str = "split_number") -> DataFrame:
    """Mean, sd, exact 10 % and 90 % quantiles, non-null count and 95 % interval of a metric; null groups stay.

    display_name and is_baseline are those of the group's first row in ``order``.
    """
    m = F.col(metric).cast("double")
    return results.groupBy(*keys).agg(
        F.avg(m).alias("mean"),
        F.stddev_samp(m).alias("sd"),
        F.percentile(m, F.lit(0.1)).alias("q10"),
        F.percentile(m, F.lit(0.9)).alias("q90"),
        F.min_by("display_name", order).alias("display_name"),
        F.min_by("is_baseline", order).alias("is_baseline"),
        F.count(m).alias("n"),
        (F.lit(1.96) * F.stddev_samp(m) / F.sqrt(F.count(m).cast("double"))).alias("ci95"),
    )


def aligned(results: DataFrame, metric: str, ours: str, theirs: list[str], keys: tuple[str, ...] = ("train_ratio", "split_number")) -> DataFrame:
    """One row for each cell, a column a method; cells that some method lacks go."""
    return results.filter(F.col("name").isin(ours, *theirs)).groupBy(*keys).pivot("name", [ours, *theirs]).agg(F.first(metric)).dropna()


def win_ratio(results: DataFrame, metric: str, ours: str, theirs: list[str], strict: bool = False, keys: tuple[str, ...] = ("train_ratio", "split_number")) -> DataFrame:
    """Share of cells where ours is as good or better (``strict``: better); for mse and misclass less is better."""
    wide = aligned(results, metric, ours, theirs, keys)
    sign = -1 if metric in ("mse", "misclass", "logloss") else 1
    a = F.col(f"`{ours}`") * sign
    better = lambda o: (a > F.col(f"`{o}`") * sign) if strict else (a >= F.col(f"`{o}`") * sign)
    return wide.agg(*[F.avg(better(o).cast("double")).alias(o) for o in theirs])


def replace_methods(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old rows of the methods that ``new`` has go, its rows come."""
    names = new.select("name").distinct()
    return old.join(names, "name", "left_anti").unionByName(new, allowMissingColumns=True)


def grid(methods: DataFrame, ratios: DataFrame, n_splits: int, seed: int = 42) -> DataFrame:
    """Every (method, ratio, split) cell with its seed. The frames hold names, so the product is small."""
    splits = methods.sparkSession.range(n_splits).select(F.col("id").cast("int").alias("split_idx"))
    cells = methods.crossJoin(F.broadcast(ratios)).crossJoin(F.broadcast(splits))
    return cells.withColumn("seed", F.lit(seed) + F.col("ratio_idx") * n_splits + F.col("split_idx"))


def pending(cells: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("name", "ratio_idx", "split_idx")) -> DataFrame:
    """Cells without a result."""
    return cells.join(done.select(*keys).distinct(), list(keys), "left_anti")


def error_column(metric: str) -> Column:
    return F.col(metric) if metric in ("mse", "misclass", "logloss") else -F.col(metric)
