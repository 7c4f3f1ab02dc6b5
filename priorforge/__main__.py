"""Command line (O4): build a dataset from a CSV file, study one learner, or compare methods.

    python -m priorforge build data.csv out --schema "age int, job string, y string" --label y
    python -m priorforge study out --learner lasso --results results
    python -m priorforge compare out --results results
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import prep, splits
    from .sources import files

    raw = files.read_labelled_csv(spark, a.csv, a.schema, a.label, sep=a.sep).withColumn("row_id", F.monotonically_increasing_id())
    names = [c for c in raw.columns if c not in ("label", "row_id")]
    codes = prep.first_seen_codes(raw, "label", "row_id").select(F.col("label").alias("name"), F.col("code").cast("double").alias("label"))
    data = raw.withColumnRenamed("label", "name").join(F.broadcast(codes), "name").select("row_id", "label", F.array(*[F.col(c).cast("double") for c in names]).alias("features"))
    least = prep.class_counts(data, "label").agg(F.min("n")).first()[0]
    plan = splits.split_plan(least, size=a.size, n=data.count() if a.size else None)
    metadata = codes.withColumn("features", F.array(*[F.lit(c) for c in names]))
    files.save_dataset(a.out, data, splits.shuffle_split(data, plan, a.splits, a.seed), metadata)


def _run(spark: SparkSession, a: argparse.Namespace, methods) -> None:
    from .operators.results import summary
    from .plans import experiment
    from .sources import files

    data, plan, meta = files.load_dataset(spark, a.dataset)
    names = meta.first()["features"]
    if a.scores:
        found = {r.feature: r.score for r in spark.read.parquet(a.scores).collect()}
        scores = spark.createDataFrame([(j, float(found[n])) for j, n in enumerate(names)], "j int, score double")
    else:
        scores = spark.createDataFrame([(j, 1.0) for j in range(len(names))], "j int, score double")
    done = spark.read.parquet(a.results) if files.exists(spark, a.results) else None
    new = experiment.run(data, plan, scores, experiment.Study(seed=a.seed, methods=methods), done=done)
    new.write.mode("append").parquet(a.results)
    summary(spark.read.parquet(a.results), "auroc", order="split_idx").orderBy("name", "train_ratio").show(200, False)


def main(argv: list[str] | None = None) -> None:
    from .plans import experiment

    p = argparse.ArgumentParser(prog="priorforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("csv")
    b.add_argument("out")
    b.add_argument("--schema", required=True)
    b.add_argument("--label", required=True)
    b.add_argument("--sep", default=",")
    b.add_argument("--size", type=int)
    b.add_argument("--splits", type=int, default=10)
    b.add_argument("--seed", type=int, default=42)
    for name in ("study", "compare"):
        c = sub.add_parser(name)
        c.add_argument("dataset")
        c.add_argument("--results", required=True)
        c.add_argument("--scores", help="Parquet table (feature, score)")
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--learner", default="lasso") if name == "study" else c.add_argument("--learners", nargs="+", default=["lasso", "kernel"])
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("priorforge").getOrCreate()
    if a.command == "build":
        build(spark, a)
    elif a.command == "study":
        _run(spark, a, experiment.learner_study(a.learner))
    else:
        _run(spark, a, [experiment.ensemble(learners=tuple(a.learners)), experiment.prior_lasso(), experiment.no_prior_stack(tuple(a.learners)), *experiment.baselines()])


if __name__ == "__main__":
    main()
