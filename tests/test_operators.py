"""Splits, priors, files, scoring and selection: properties that SQL doesn't show."""

import os

import pytest
from pyspark.sql import functions as F

from priorforge.operators import metrics, prep, prior, ranking, results, scoring, selection, splits, synthetic
from priorforge.sources import files


def rows(spark, n=200, classes=3):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % classes).cast("int").alias("label"))


def test_splits_are_disjoint_and_stratified(spark):
    df = rows(spark)
    got = splits.shuffle_split(df, [(0, 0.1, 0.2), (1, 0.8, 0.2)], 3).join(df, "row_id")
    assert got.groupBy("ratio_idx", "split_idx", "row_id").count().filter("count > 1").count() == 0
    sizes = got.groupBy("ratio_idx", "split_idx", "part", "label").count().collect()
    for r in sizes:
        n = sum(1 for k in range(200) if k % 3 == r.label)
        assert r["count"] == int(n * {("test", 0): 0.2, ("test", 1): 0.2, ("train", 0): 0.1, ("train", 1): 0.8}[r.part, r.ratio_idx] + 1e-9)
    tests = {(r.split_idx, r.ratio_idx): set() for r in sizes}
    for r in got.filter("part = 'test'").collect():
        tests[r.split_idx, r.ratio_idx].add(r.row_id)
    assert all(tests[s, 0] == tests[s, 1] for s in range(3)) and tests[0, 0] != tests[1, 0]


def test_folds_partition_the_rows(spark):
    got = splits.k_fold(rows(spark), 5).join(rows(spark), "row_id")
    assert got.count() == 200
    for label in range(3):
        n = [r["count"] for r in got.filter(F.col("label") == label).groupBy("fold").count().collect()]
        assert len(n) == 5 and max(n) - min(n) <= 1
    assert splits.fold_count(5, 40, 3) == 3 and splits.fold_count(5, 15) == 2 and splits.fold_count(10, 1000) == 10


def test_split_plan():
    assert [r for _, r, _ in splits.split_plan(400)] == pytest.approx(list(splits.RATIOS))
    assert [r for _, r, _ in splits.split_plan(10)] == pytest.approx([0.4, 0.5, 0.6])
    assert splits.split_plan(100, size=50, n=100)[0][1:] == pytest.approx((0.05, 0.1))
    with pytest.raises(ValueError):
        splits.split_plan(3)


def test_rank_by_hash_is_dense(spark):
    df = rows(spark).withColumn("h", ranking.hash_order(1, "row_id"))
    for r in ranking.rank_by_hash(df, ["label"], "h").groupBy("label").agg(F.collect_set("rank").alias("k"), F.first("size").alias("n")).collect():
        assert sorted(r.k) == list(range(1, r.n + 1))


def test_oversampling(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") < 10, 1).when(F.col("id") < 40, 2).otherwise(0).alias("label"))
    n = {r.label: r["count"] for r in splits.oversample(df).groupBy("label").count().collect()}
    assert n == {0: 60, 1: 20, 2: 60}
    drawn = splits.oversample_features(spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 3.0)], "feature string, score double"), 400).groupBy("feature").count().collect()
    got = {r.feature: r["count"] for r in drawn}
    assert set(got) == {"b", "c"} and 240 < got["c"] < 360 and sum(got.values()) == 400


def test_priors(spark):
    s = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "feature string, score double")
    assert [r.importance for r in prior.importance(s, prior.PriorConfig(0.0)).collect()] == pytest.approx([1 / 1.0001] * 2)
    assert sum(r.penalty for r in prior.normalised_penalty(s, prior.PriorConfig(2.0)).collect()) == pytest.approx(1)
    assert [(c.temperature, c.beta) for c in prior.PriorSweep((0.0, 1.0), (0.1, 0.2)).configs()] == [(0.0, 0.0), (1.0, 0.0)]
    assert len(prior.PriorSweep((0.0, 1.0), (0.1, 0.2)).configs(True)) == 3
    z = prep.standardise(spark.createDataFrame([(r, f, float(r * f)) for r in range(6) for f in (0, 1)], "row_id int, j int, x double")).withColumnRenamed("j", "feature")
    flat = spark.createDataFrame([(0, 0.5), (1, 0.5)], "feature int, score double")
    assert {r.weight for r in prior.sample_weights(z, flat, prior.PriorConfig(0.0)).collect()} == {1.0}
    with pytest.raises(ValueError):
        prior.sample_weights(z, flat, prior.PriorConfig(sample_map=prior.SQRT))
    assert sorted(r.score for r in prior.permuted_scores(s).collect()) == [0.1, 0.9]


def test_auroc_has_ties_and_null_for_one_class(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.1), (1, 0.5), (0, 0.4)], "y int, z double")
    assert metrics.auroc(df).first().auroc == pytest.approx((0.5 + 0 + 1 + 1) / 4)
    assert metrics.auroc(df.filter("y = 1")).first().auroc is None
    assert metrics.classification(df.filter("y = 1")).first().mcc == 0.0


def test_category_codes_keep_order_and_nulls(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    assert sorted((r.c or "", r.c_code) for r in prep.category_codes(df, "c").collect()) == [("", -1), ("a", 0), ("b", 1), ("b", 1)]


def test_files(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text(" age ;job;y\n1;x;yes\n2;;no\n3;w;maybe\n")
    df = files.read_labelled_csv(spark, str(p), "age int, job string, y string", "y", {"yes": "good", "no": "bad"}, ";")
    assert sorted((r.age, r.job, r.label) for r in df.collect()) == [(1, 1, "good"), (2, -1, "bad"), (3, 0, None)]
    t = tmp_path / "g.tsv"
    t.write_text("#comment\nprobe\tname\tmore\np1\tG1\tx\n")
    assert files.read_commented_tsv(spark, str(t), "probe string, name string, more string", ["probe", "name"]).collect()[0].name == "G1"
    out = str(tmp_path / "results")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    files.write_results(spark, out, one)
    files.write_results(spark, out, spark.createDataFrame([("a", 9)], "name string, v int"))
    assert sorted((r.name, r.v) for r in spark.read.parquet(out).collect()) == [("a", 9), ("b", 2)]
    calls = []
    for _ in range(2):
        assert files.memo(spark, str(tmp_path / "memo"), lambda: calls.append(1) or one).count() == 2
    assert len(calls) == 1
    data = rows(spark)
    files.save_dataset(str(tmp_path / "set"), data, splits.shuffle_split(data, [(0, 0.1, 0.2)], 2), one)
    loaded, parts, _ = files.load_dataset(spark, str(tmp_path / "set"))
    assert loaded.count() == 200 and parts.select("train_ratio").distinct().count() == 1
    assert files.load_or_preselected(spark, str(tmp_path / "set"))[1] is None
    (tmp_path / "x/y").mkdir(parents=True)
    (tmp_path / "x/y/f.txt").touch()
    assert files.first_directory_with(str(tmp_path / "x"), "f.txt") == os.path.join(str(tmp_path), "x", "y")
    sample = tmp_path / "s.tsv"
    sample.write_text("gene\tcount\nN_x\t1\ng1\t5\ng2\t6\n")
    assert files.read_sample_rows(spark, str(sample), "gene", "count", "N_").first().features == {"g1": 5.0, "g2": 6.0}


def test_json_objects_nested_and_malformed(spark):
    df = spark.createDataFrame([('x {"a": {"b": 1}} {bad {"c": 2}',), (None,)], "t string")
    assert [r.objects for r in scoring.json_objects(df, "t").collect()] == [['{"a": {"b": 1}}', '{"b": 1}', '{"c": 2}'], []]


def test_results(spark):
    cells = results.grid(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([(0,), (1,)], "ratio_idx int"), 3)
    assert cells.count() == 12 and cells.agg(F.max("seed")).first()[0] == 42 + 3 + 2
    assert results.pending(cells, cells.limit(5)).count() == 7
    r = spark.createDataFrame([("u", 1, 1, 0.5), ("v", 1, 1, 0.5), ("u", 1, 2, 0.9), ("v", 1, 2, 0.1), ("u", 1, 3, 0.9)], "name string, train_ratio int, split_number int, auroc double")
    assert results.win_ratio(r, "auroc", "u", ["v"]).first().v == 1.0
    assert results.win_ratio(r, "auroc", "u", ["v"], strict=True).first().v == 0.5


def test_run_trials_stops_at_a_failure(spark):
    make = lambda t: spark.createDataFrame([(t != 2,)], "success boolean")
    assert [r.first().trial for r in scoring.run_trials(make, {0}, 5)] == [1, 2]


def test_selection_and_synthetic_data(spark):
    long = synthetic.features(spark, 400, 6)
    y = synthetic.labelled(long, 1, "linear", 0.5, 0.0).select("row_id", "y")
    assert y.agg(F.sum("y")).first()[0] == 200
    assert selection.by_information(long, y, 1).first().feature == 0
    assert selection.mrmr(long, y, 3).first().feature == 0
    names = spark.createDataFrame([(f"n{k}",) for k in range(10)], "feature string")
    fake = synthetic.fake_names(names, names.withColumnRenamed("feature", "name"), 0.5).collect()
    assert sum(r.feature != r.new_name for r in fake) == 5 and len({r.new_name for r in fake}) == 10


def test_command_line(spark, tmp_path, capsys):
    from priorforge.__main__ import main

    csv = tmp_path / "d.csv"
    csv.write_text("a,b,y\n" + "".join(f"{k % 7},{(k * 37) % 11},{'p' if k % 7 > 2 else 'n'}\n" for k in range(120)))
    main(["build", str(csv), str(tmp_path / "set"), "--schema", "a int, b int, y string", "--label", "y", "--splits", "1"])
    main(["study", str(tmp_path / "set"), "--results", str(tmp_path / "res")])
    got = spark.read.parquet(str(tmp_path / "res"))
    assert {r.name for r in got.select("name").distinct().collect()} == {"lasso_t0", "lasso_t1", "lasso_t2", "oof_positive"}
    n = got.count()
    main(["study", str(tmp_path / "set"), "--results", str(tmp_path / "res")])
    assert spark.read.parquet(str(tmp_path / "res")).count() == n
