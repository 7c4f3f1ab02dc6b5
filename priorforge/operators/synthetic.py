"""Synthetic and adversarial data (V2-V4): hashed draws, so any task can make any row again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ranking import hash_order


def uniform(seed: int, *parts) -> Column:
    """Uniform number in (0, 1) from a hash of the parts."""
    u = F.conv(F.substring(hash_order(seed, *parts), 1, 12), 16, 10).cast("double")
    return (u + 0.5) / F.lit(float(16**12))


def normal(seed: int, *parts) -> Column:
    """Box-Muller from two hashes."""
    u, v = uniform(seed, F.lit("u"), *parts), uniform(seed, F.lit("v"), *parts)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * v)


def features(spark: SparkSession, n: int, p: int, seed: int = 42) -> DataFrame:
    """(row_id, j, x): n rows of p standard normal features."""
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    return rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).withColumn("x", normal(seed, "row_id", "j"))


def labelled(long: DataFrame, effective: int, signal: str = "linear", share: float = 0.5, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """(row_id, s, y): a signal of the first features, y = 1 above its (1 - share) quantile, and some labels flipped.

    signal: 'linear' (weighted sum), 'tanh' (of it) or 'featurewise' (sum of tanh of each).
    """
    w = F.when(F.col("j") < effective, F.lit(1.0) / (F.col("j") + 1)).otherwise(0.0)
    value = F.tanh("x") if signal == "featurewise" else F.col("x")
    s = F.sum(w * value)
    got = long.groupBy("row_id").agg((F.tanh(s) if signal == "tanh" else s).alias("s"))
    cut = got.agg(F.percentile("s", F.lit(1 - share)).alias("cut"))
    clean = (F.col("s") > F.col("cut")).cast("int")
    flip = uniform(seed, F.lit("flip"), "row_id") < noise
    return got.crossJoin(F.broadcast(cut)).select("row_id", "s", F.when(flip, 1 - clean).otherwise(clean).alias("y"))


def fake_names(names: DataFrame, registry: DataFrame, ratio: float = 0.5, seed: int = 42, top: DataFrame | None = None) -> DataFrame:
    """V2: (feature, new_name): a share of the names replaced by five letters that no registry (name) has.

    Which ones: the first by hash, or the first of ``top`` (feature, score). A made-up name that exists gets the next try.
    """
    n = int(names.count() * ratio)
    order = [F.desc("score"), F.col("feature")] if top is not None else [hash_order(seed, "feature")]
    chosen = (top if top is not None else names).orderBy(*order).limit(n).select("feature")
    letters = F.translate(F.substring(hash_order(seed, F.lit("name"), "feature", "try"), 1, 5), "0123456789", "GHIJKLMNOP")
    tries = chosen.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("new_name", F.upper(letters))
    free = tries.join(registry.select(F.upper("name").alias("new_name")).distinct(), "new_name", "left_anti")
    new = free.groupBy("feature").agg(F.min_by("new_name", "try").alias("new_name"))
    return names.select("feature").join(new, "feature", "left").withColumn("new_name", F.coalesce("new_name", "feature"))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """V4: counts by equal-width bin (0 and bins + 1 lie outside)."""
    return df.groupBy(F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
