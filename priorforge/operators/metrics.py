"""Metrics over (y, z) rows, z a logit or a prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def clipped_logit(p: Column, eps: float = 1e-8) -> Column:
    """B18."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def predicted_class(z: Column) -> Column:
    """1 above zero."""
    return F.when(z > 0, 1).otherwise(0)


def predicted_index(logits: Column) -> Column:
    """B19 for several classes: the place of the first greatest logit, from 0."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def classification(df: DataFrame, keys: list[str] | None = None, y: str = "y", z: str = "z") -> DataFrame:
    """Accuracy, misclass and mcc (0 where its denominator is 0), by one aggregation."""
    p = predicted_class(F.col(z))
    cell = lambda a, b: F.sum(((F.col(y) == a) & (p == b)).cast("double"))
    got = df.groupBy(*(keys or [])).agg(cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    acc = (tp + tn) / (tp + tn + fp + fn)
    return got.select(*(keys or []), acc.alias("accuracy"), (1 - acc).alias("misclass"), F.when(den == 0, 0.0).otherwise((tp * tn - fp * fn) / den).alias("mcc"))


def auroc(df: DataFrame, keys: list[str] | None = None, y: str = "y", z: str = "z", parts: int = 64) -> DataFrame:
    """Exact area under the ROC curve; ties count half. One class only: null.

    Scores are counted first, then ordered inside ``parts`` ranges of the score (cut at approximate quantiles), so no
    task orders them all; a range's lesser negatives are added from the ranges' counts.
    """
    keys = keys or []
    counts = df.groupBy(*keys, F.col(z).alias("z")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))
    cuts = df.agg(F.percentile_approx(F.col(z).cast("double"), [k / parts for k in range(1, parts)], 10000).alias("c")).first().c or []
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= F.col("z"))) if cuts else F.lit(0)
    counts = counts.withColumn("b", bucket)
    by_part = counts.groupBy(*keys, "b").agg(F.sum("neg").alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = by_part.withColumn("below", F.coalesce(F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = Window.partitionBy(*keys, "b").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(F.broadcast(below), [*keys, "b"]).withColumn("less", F.col("below") + F.coalesce(F.sum("neg").over(inner), F.lit(0)))
    u = F.sum(F.col("pos") * (F.col("less").cast("double") + F.col("neg").cast("double") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, u / pairs).alias("auroc"))


def mse(df: DataFrame, keys: list[str] | None = None, y: str = "y", z: str = "z") -> DataFrame:
    """E4."""
    return df.groupBy(*(keys or [])).agg(F.avg((F.col(y) - F.col(z)) * (F.col(y) - F.col(z))).alias("mse"))


def log_loss(df: DataFrame, keys: list[str] | None = None, y: str = "y", z: str = "z") -> DataFrame:
    """Mean binomial deviance / 2 of logits, without overflow."""
    v, t = F.col(z), F.col(y).cast("double")
    loss = F.greatest(v, F.lit(0.0)) - v * t + F.log1p(F.exp(-F.abs(v)))
    return df.groupBy(*(keys or [])).agg(F.avg(loss).alias("logloss"))


def cv_error(metric: str, value: Column) -> Column:
    """E5: what the ensemble minimises."""
    return value if metric in ("mse", "logloss") else -value
