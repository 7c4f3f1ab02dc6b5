"""Dataset preparation: encoding, renaming, imputing, filtering, transposing, grouping (B, G, J, S)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def long_features(df: DataFrame, row: str, array: str) -> DataFrame:
    """(row_id, j, x): one row for each value of an array column."""
    return df.select(F.col(row).alias("row_id"), F.posexplode(array).alias("j", "x")).select("row_id", "j", F.col("x").cast("double").alias("x"))


def wide_features(long: DataFrame, names: list) -> DataFrame:
    """Back to one column a feature."""
    return long.groupBy("row_id").pivot("j", names).agg(F.first("x"))


def categories(df: DataFrame, col: str) -> DataFrame:
    """(value, code): sorted distinct values from 0, nulls left out (B2). The values of a categorical column are few."""
    values = df.select(F.col(col).alias("value")).dropna().distinct()
    return values.withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))


def category_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """B2: a column of codes by sorted value; null is -1."""
    codes = categories(df, col).withColumnRenamed("value", "__v").withColumnRenamed("code", "__code")
    got = df.join(codes, df[col] == codes["__v"], "left")
    return got.withColumn(out or f"{col}_code", F.coalesce("__code", F.lit(-1))).drop("__v", "__code")


def first_seen_codes(df: DataFrame, label: str, order: str) -> DataFrame:
    """(label, code): labels numbered by their first appearance."""
    first = df.groupBy(label).agg(F.min(order).alias("first_row"))
    return first.withColumn("code", (F.row_number().over(Window.orderBy("first_row")) - 1).cast("int"))


def strip_names(df: DataFrame) -> DataFrame:
    """B3."""
    return df.toDF(*[c.strip() for c in df.columns])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """B4."""
    return df.withColumnsRenamed(names)


def map_values(col: Column, mapping: dict) -> Column:
    """Values outside the mapping become null."""
    out = F.lit(None)
    for k, v in mapping.items():
        out = F.when(col == F.lit(k), F.lit(v)).otherwise(out)
    return out


def impute_marked(df: DataFrame, cols: list[str], marked=lambda c: c == 0, digits: int = 4) -> DataFrame:
    """Marked values become the mean of the others, rounded. One pass for all columns' means."""
    means = df.agg(*[F.round(F.avg(F.when(~marked(F.col(c)), F.col(c))), digits).alias(f"__m_{c}") for c in cols])
    got = df.crossJoin(F.broadcast(means))  # one row
    return got.select(*[F.when(marked(F.col(c)), F.col(f"__m_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def exclude_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Nulls and values with the prefix go."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).startswith(prefix))


def first_part(col: Column, separator: str) -> Column:
    """B11."""
    return F.split_part(col, F.lit(separator), F.lit(1))


def strip_suffix(col: Column, pattern: str = r"\..*$") -> Column:
    """B12."""
    return F.regexp_replace(col, pattern, "")


def keep_features(long: DataFrame, wanted: DataFrame, key: str = "j") -> DataFrame:
    """The rows of wanted features."""
    return long.join(wanted.select(key).distinct(), key, "left_semi")


def having_total(long: DataFrame, key: str, value: Column, least: float) -> DataFrame:
    """Totals by key that reach ``least``; values are rounded half to even first."""
    return long.groupBy(key).agg(F.sum(F.bround(value, 0).cast("long")).alias("total")).filter(F.col("total") >= least)


def fallback(df: DataFrame, names: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The mapped name, or the key itself."""
    return df.join(names, key, "left").withColumn(out, F.coalesce(value, key)).drop(value)


def standardise(long: DataFrame) -> DataFrame:
    """(row_id, j, z) with the population deviation; a constant feature has scale 1."""
    stats = long.groupBy("j").agg(F.avg("x").alias("__m"), F.stddev_pop("x").alias("__s"))
    scale = F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    return long.join(stats, "j").select("row_id", "j", ((F.col("x") - F.col("__m")) / scale).alias("z"))


def group_mean(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """G1."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def collapse_features(long: DataFrame, name: Column, how: str = "avg") -> DataFrame:
    """Features that share a name become one, by sum or mean."""
    return long.groupBy("row_id", name.alias("feature")).agg(getattr(F, how)("x").alias("x"))


def feature_variance(long: DataFrame) -> DataFrame:
    """Sample variance by feature."""
    return long.groupBy("j").agg(F.var_samp("x").alias("variance"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """G5."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def distinct_documents(df: DataFrame, content: str, metadata: str, rank: str) -> DataFrame:
    """One row for each content and metadata (a map, compared by its sorted entries): the least rank."""
    key = F.array_sort(F.map_entries(metadata))
    return df.groupBy(F.col(content), key.alias("metadata")).agg(F.min(rank).alias(rank))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """S1, A13."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """S3: rows of a, as a set, that b hasn't."""
    return a.distinct().join(b.distinct(), a.columns, "left_anti")
