"""Sources and sinks (A1-A5, A12-A15, A20-A27): text formats with declared schemas, Parquet tables with partitions."""

from __future__ import annotations

import dataclasses
import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.prep import category_codes, map_values, strip_names


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A1, A2."""
    return spark.read.schema(schema).option("sep", sep).csv(path, header=True)


def read_labelled_csv(spark: SparkSession, path: str, schema: str, label: str, mapping: dict | None = None, sep: str = ",") -> DataFrame:
    """Strings become codes, the label (as text, mapped if asked for) becomes ``label``."""
    df = strip_names(read_csv(spark, path, schema, sep))
    y = F.col(label).cast("string")
    df = df.withColumn("label", map_values(y, {str(k): v for k, v in mapping.items()}) if mapping else y)
    df = df.drop(label) if label != "label" else df
    for name, kind in df.dtypes:
        if kind == "string" and name != "label":
            df = category_codes(df, name, name + "__c").drop(name).withColumnRenamed(name + "__c", name)
    return df


def read_commented_tsv(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """A4."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path, header=True).select(*columns)


def read_sample_rows(spark: SparkSession, path: str, name: str, value: str, skip: str) -> DataFrame:
    """A5: files of (name, value) lines become one row a file: (file, map). Names that start with ``skip`` are summaries; of a repeated name the greatest value counts."""
    lines = spark.read.option("sep", "\t").option("comment", "#").csv(path, header=True).withColumn("file", F.input_file_name())
    some = lines.filter(~F.col(name).startswith(skip))
    one = some.groupBy("file", F.col(name).alias("name")).agg(F.max(F.col(value).cast("double")).alias("value"))
    return one.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("features"))


def save_dataset(path: str, data: DataFrame, splits: DataFrame, metadata: DataFrame) -> None:
    """Replaces what is there; splits are partitioned by ratio."""
    data.write.mode("overwrite").parquet(f"{path}/data")
    splits.write.mode("overwrite").partitionBy("train_ratio").parquet(f"{path}/splits")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A11."""
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("data", "splits", "metadata"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_or_preselected(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """The data, and the features of each split if the directory has them."""
    chosen = f"{path}/features_per_split"
    return spark.read.parquet(f"{path}/data"), spark.read.parquet(chosen) if exists(spark, chosen) else None


def memo(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built and written first if it isn't there."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def write_results(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Partitions of the methods that ``new`` has are replaced, others stay."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(path)


def append_trials(path: str, trials: DataFrame) -> None:
    """Successes and failures in one table, told by ``success``."""
    trials.write.mode("append").partitionBy("success").parquet(path)


def to_json(obj) -> str:
    """A23."""
    return json.dumps(dataclasses.asdict(obj), sort_keys=True)


def first_directory_with(base: str, name: str) -> str | None:
    """The first directory, depth first in name order, that holds a file."""
    for root, dirs, files in os.walk(base):
        dirs.sort()
        if name in files:
            return root
    return None
