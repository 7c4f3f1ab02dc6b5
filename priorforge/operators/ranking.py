"""Ranks and orders that don't put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hash_order(seed, *parts: Column | str) -> Column:
    """The library's random order: md5 of 'seed:part:...', the same in any SQL engine."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def rank_by_hash(df: DataFrame, group: list[str], key: str, out: str = "rank", digits: int = 2) -> DataFrame:
    """Rank from 1 in the order of an md5 column inside each group; ``size`` is the group's.

    Rows are ranked among those that share the hash's first digits, and shifted by the number of rows with lesser ones:
    a group that holds a third of all rows goes to 16^digits tasks. The counts are small: groups * 16^digits rows.
    """
    cut = df.withColumn("__cut", F.substring(key, 1, digits))
    counts = cut.groupBy(*group, "__cut").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("size", F.sum("__n").over(w)).withColumn(
        "__before", F.coalesce(F.sum("__n").over(w.orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "__cut"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    inner = Window.partitionBy(*[F.col(f"l.{c}") for c in [*group, "__cut"]]).orderBy(F.col(f"l.{key}"))
    ranked = cut.alias("l").join(counts.alias("r"), on)
    return ranked.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.row_number().over(inner) + F.col("r.__before")).alias(out), F.col("r.size").alias("size"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; each task sends k at most (W1, W2). Name a tie-break last."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of every group (W3); Spark's window group limit prunes before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def even_batches(df: DataFrame, order: str, batch_size: int) -> DataFrame:
    """n = ceil(F / B) batches of ceil(F / n) consecutive rows. For lists of features, so of bounded size."""
    n = df.count()
    batches = max(1, -(-n // batch_size))
    size = max(1, -(-n // batches))
    return df.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("int"))
