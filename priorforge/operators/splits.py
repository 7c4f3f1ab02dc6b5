"""Deterministic splits, folds and resampling (C1-C8, J3, J4): every random choice is an md5 order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ranking import hash_order, rank_by_hash

RATIOS = tuple(round(0.1 * k, 1) for k in range(1, 9))


def split_plan(least_class: int, ratios=RATIOS, test_ratio: float = 0.2, size: int | None = None, n: int | None = None) -> list[tuple[int, float, float]]:
    """(ratio_idx, train_ratio, test_ratio) that leave four rows of the least class, cropped to ``size`` rows.

    Raises ValueError if none is left.
    """
    floor = 4 / least_class if least_class else float("inf")
    test = max(test_ratio, floor)
    crop = min(size / n, 1.0) if size and n else 1.0
    kept = [r for r in ratios if r >= floor and r > 0 and r + test <= 1 + 1e-12]
    if not kept:
        raise ValueError("no train ratio leaves four rows of every class")
    return [(k, r * crop, test * crop) for k, r in enumerate(kept)]


def shuffle_split(df: DataFrame, plan: list[tuple[int, float, float]], n_splits: int = 10, seed: int = 42, label: str | None = "label", key: str = "row_id") -> DataFrame:
    """(ratio_idx, train_ratio, split_idx, row_id, part): test first, then train, in hash order inside each class.

    The order depends on the split alone, so the ratios of a split share their test rows. Without ``label``: plain.
    """
    spark = df.sparkSession
    group = ["split_idx", "label"] if label else ["split_idx"]
    rows = df.select(F.col(key).alias("row_id"), *([F.col(label).alias("label")] if label else []))
    rows = rows.withColumn("split_idx", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    ranked = rank_by_hash(rows.withColumn("__h", hash_order(seed, "split_idx", "row_id")), group, "__h")
    grid = spark.createDataFrame(plan, "ratio_idx int, train_ratio double, test_ratio double")
    cut = ranked.crossJoin(F.broadcast(grid))  # a few ratios
    n_test = F.floor(F.col("size") * F.col("test_ratio") + 1e-9)
    n_train = F.floor(F.col("size") * F.col("train_ratio") + 1e-9)
    part = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_train, "train")
    return cut.withColumn("part", part).filter("part is not null").select("ratio_idx", "train_ratio", "split_idx", "row_id", "part")


def fold_count(cv: int, n: int, least_class: int | None = None) -> int:
    """min(cv, max(n // 10, 2)), and no more than the least class has rows."""
    k = min(cv, max(n // 10, 2))
    return max(2, min(k, least_class)) if least_class is not None else k


def k_fold(df: DataFrame, k: int, seed: int = 42, label: str | None = "label", key: str = "row_id") -> DataFrame:
    """(row_id, fold): dealt round in hash order, inside each class if ``label`` is given."""
    rows = df.select(F.col(key).alias("row_id"), *([F.col(label).alias("label")] if label else []))
    ranked = rank_by_hash(rows.withColumn("__h", hash_order(seed, "row_id")), ["label"] if label else [], "__h") if label else _plain(rows, seed)
    return ranked.select("row_id", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int").alias("fold"))


def _plain(rows: DataFrame, seed: int) -> DataFrame:
    return rank_by_hash(rows.withColumn("__h", hash_order(seed, "row_id")).withColumn("__all", F.lit(0)), ["__all"], "__h")


def oversample(df: DataFrame, label: str = "label", key: str = "row_id", seed: int = 42, limit: float = 2.0) -> DataFrame:
    """C4: the rows, and draws with replacement of each class until it has min(limit, max / n) times its rows.

    Draw d of a class takes the row whose hash rank is md5(seed:draw:class:d) modulo the class size.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    rate = F.least(F.lit(limit), F.max("__n").over(Window.partitionBy(F.lit(0))) / F.col("__n"))
    draws = counts.withColumn("__extra", (F.floor(F.col("__n") * rate) - F.col("__n")).cast("int")).filter("__extra > 0")
    draws = draws.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("__extra"))))
    pick = F.conv(F.substring(hash_order(seed, F.lit("draw"), label, "draw"), 1, 12), 16, 10).cast("long")
    draws = draws.select(F.col(label), F.col("draw"), (F.pmod(pick, F.col("__n")) + 1).alias("rank"))
    ranked = rank_by_hash(df.withColumn("__h", hash_order(seed, key)), [label], "__h").drop("size", "__h")
    return df.withColumn("draw", F.lit(0)).unionByName(ranked.join(draws, [label, "rank"]).drop("rank"))


def oversampled_folds(df: DataFrame, k: int, label: str = "label", key: str = "row_id", seed: int = 42) -> DataFrame:
    """(fold, part, rows...): both parts of each fold oversampled, seed + fold."""
    folds = k_fold(df, k, seed, label, key).withColumnRenamed("row_id", key)
    out = None
    for f in range(k):
        for part, cond in (("test", F.col("fold") == f), ("train", F.col("fold") != f)):
            some = oversample(df.join(folds.filter(cond).select(key), key, "left_semi"), label, key, seed + f).withColumn("part", F.lit(part)).withColumn("fold", F.lit(f))
            out = some if out is None else out.unionByName(some)
    return out


def oversample_features(scores: DataFrame, extra: int, seed: int = 42) -> DataFrame:
    """(draw, feature): ``extra`` draws with probability in proportion to the score; all zero: uniform.

    Scores are one row a feature. A uniform hash per draw falls into one interval of the running sum.
    """
    w = Window.orderBy("feature")
    mass = F.when(F.sum("score").over(Window.partitionBy(F.lit(0))) > 0, F.col("score")).otherwise(F.lit(1.0))
    bands = scores.withColumn("m", mass).withColumn("hi", F.sum("m").over(w)).withColumn("lo", F.col("hi") - F.col("m"))
    bands = bands.withColumn("total", F.sum("m").over(Window.partitionBy(F.lit(0))))
    u = F.conv(F.substring(hash_order(seed, F.lit("column"), "draw"), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    draws = scores.sparkSession.range(extra).withColumnRenamed("id", "draw").withColumn("u", u)
    # a band's upper bound is open; the last one takes what rounding leaves
    hit = (F.col("u") * F.col("total") >= F.col("lo")) & (F.col("u") * F.col("total") < F.col("hi"))
    return draws.join(F.broadcast(bands), hit).select("draw", "feature")


def permute(df: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """(name, permuted): the k-th name by value gets the k-th by hash. One row a feature."""
    a = df.select(F.col(name)).withColumn("k", F.row_number().over(Window.orderBy(name)))
    b = df.select(F.col(name).alias("permuted")).withColumn("k", F.row_number().over(Window.orderBy(hash_order(seed, F.col("permuted")))))
    return a.join(b, "k").drop("k")


def gather(data: DataFrame, splits: DataFrame, ratio_idx: int, split_idx: int, part: str, key: str = "row_id") -> DataFrame:
    """The rows of one part of one split."""
    some = splits.filter((F.col("ratio_idx") == ratio_idx) & (F.col("split_idx") == split_idx) & (F.col("part") == part)).select(F.col("row_id").alias(key))
    return data.join(some, key, "left_semi")


def crop(data: DataFrame, splits: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that some split uses, with a dense new_id in the order of the key."""
    used = splits.select(F.col("row_id").alias(key)).distinct()
    kept = data.join(used, key, "left_semi")
    bounds = kept.select(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if bounds.lo is None:
        return kept.withColumn("new_id", F.lit(0).cast("long"))
    width = max(1, (bounds.hi - bounds.lo + 1) // 256)
    cut = kept.withColumn("__b", F.floor((F.col(key) - bounds.lo) / width))
    counts = cut.groupBy("__b").agg(F.count("*").alias("__n"))  # some hundred rows
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    return cut.join(F.broadcast(counts), "__b").withColumn("new_id", (rank + F.col("__before")).cast("long")).drop("__b", "__before")
