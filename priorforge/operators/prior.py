"""Feature priors: scores become importances, penalties and sample weights."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

IDENTITY, SQRT, POWER, EXP = "identity", "sqrt", "power", "exp"


@dataclass(frozen=True)
class PriorConfig:
    """One functional form of a prior. ``temperature`` 0 makes any prior uniform."""

    temperature: float = 1.0
    beta: float = 0.0
    feature_map: str = IDENTITY
    sample_map: str = IDENTITY
    power: float = 1.0
    exp_tau: float = 1.0
    eps: float = 1e-4


@dataclass(frozen=True)
class PriorSweep:
    """Temperatures and betas; betas only for learners that use sample weights."""

    temperatures: tuple[float, ...] = (0.0, 1.0, 2.0)
    betas: tuple[float, ...] = (0.0,)
    base: PriorConfig = field(default_factory=PriorConfig)

    def configs(self, sample_weights: bool = False) -> list[PriorConfig]:
        from dataclasses import replace

        betas = self.betas if sample_weights else (0.0,)
        out = [replace(self.base, temperature=0.0, beta=0.0)] if 0.0 in self.temperatures else []
        return out + [replace(self.base, temperature=t, beta=b) for t in self.temperatures if t > 0 for b in betas]

    def table(self, spark: SparkSession, sample_weights: bool = False) -> DataFrame:
        rows = [(k, c.temperature, c.beta) for k, c in enumerate(self.configs(sample_weights))]
        return spark.createDataFrame(rows, "config int, temperature double, beta double")


def uniform_scores(names: DataFrame, feature: str = "feature") -> DataFrame:
    """P1."""
    return names.select(F.col(feature).alias("feature"), F.lit(1.0).alias("score"))


def raw_importance(score: Column, c: PriorConfig) -> Column:
    if c.temperature == 0:
        return F.lit(1.0)
    p = score + F.lit(c.eps)
    if c.feature_map == EXP:
        return F.exp(F.lit(c.exp_tau * c.temperature) * score)
    if c.feature_map == SQRT:
        return F.pow(F.sqrt(p), F.lit(c.temperature))
    return F.pow(p, F.lit(c.temperature * (c.power if c.feature_map == POWER else 1.0)))


def importance(scores: DataFrame, c: PriorConfig) -> DataFrame:
    """(feature, importance), divided by the mean plus eps. One row a feature."""
    raw = scores.withColumn("s", raw_importance(F.col("score"), c))
    mean = raw.agg(F.avg("s").alias("m"))
    return raw.crossJoin(F.broadcast(mean)).select("feature", (F.col("s") / (F.col("m") + F.lit(c.eps))).alias("importance"))


def penalty(scores: DataFrame, c: PriorConfig) -> DataFrame:
    """(feature, penalty) = (score + eps) ^ -temperature, whatever the feature map."""
    return scores.select("feature", F.pow(F.col("score") + F.lit(c.eps), F.lit(-c.temperature)).alias("penalty"))


def normalised_penalty(scores: DataFrame, c: PriorConfig) -> DataFrame:
    """Penalties that add up to 1."""
    p = penalty(scores, c)
    total = p.agg(F.sum("penalty").alias("t"))
    return p.crossJoin(F.broadcast(total)).select("feature", (F.col("penalty") / F.col("t")).alias("penalty"))


def sample_weights(z: DataFrame, scores: DataFrame, c: PriorConfig) -> DataFrame:
    """P5: (row_id, weight) from standardised values (row_id, feature, z).

    The cosine of |z|^power with the importances, rescaled to 0..1 over all rows, then mapped by beta. A row that is at
    every feature's mean has no direction: its cosine is 0.
    """
    if c.sample_map == SQRT:
        raise ValueError("sample weights have no square-root map")
    s = importance(scores, c)
    h = F.abs("z") if c.power == 1 else F.pow(F.abs("z"), F.lit(c.power))
    got = z.join(F.broadcast(s), "feature").groupBy("row_id").agg(F.sum(F.col("importance") * h).alias("dot"), F.sqrt(F.sum(h * h)).alias("hn"))
    norm = s.agg(F.sqrt(F.sum(F.col("importance") * F.col("importance"))).alias("sn"))
    cos = got.crossJoin(F.broadcast(norm)).select("row_id", F.coalesce(F.try_divide("dot", F.col("sn") * F.col("hn")), F.lit(0.0)).alias("cos"))
    span = cos.agg(F.min("cos").alias("lo"), F.max("cos").alias("hi"))
    w = (F.col("cos") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(c.eps))
    mapped = {IDENTITY: (1 - F.lit(c.beta)) + F.lit(c.beta) * w, POWER: F.pow(w, F.lit(c.beta)), EXP: F.exp(F.lit(c.beta) * w)}[c.sample_map]
    if c.temperature == 0:
        mapped = F.lit(1.0)
    return cos.crossJoin(F.broadcast(span)).select("row_id", mapped.alias("weight"))


def one_minus(scores: DataFrame) -> DataFrame:
    """P8."""
    return scores.select("feature", (1 - F.col("score")).alias("score"))


def inverse(scores: DataFrame) -> DataFrame:
    """P8."""
    return scores.select("feature", (1 / (F.col("score") + F.lit(1e-3))).alias("score"))


def permuted_scores(scores: DataFrame, seed: int = 42) -> DataFrame:
    """Every feature gets the score of the feature that the permutation names."""
    from .splits import permute

    names = permute(scores.select("feature"), "feature", seed)
    return names.join(scores.withColumnRenamed("feature", "permuted"), "permuted").select("feature", "score")


def restrict(scores: DataFrame, preselected: DataFrame, keys: list[str]) -> DataFrame:
    """The scores of each split's features, joined by name."""
    return preselected.select(*keys, "feature").join(scores, "feature").select(*keys, "feature", "score")
