"""Rows that used to stop a job."""

import json

from priorforge.operators import prior, scoring
from priorforge.sources import files


def test_a_row_at_the_mean_has_a_weight(spark):
    z = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (2, "a", 1.0), (2, "b", 0.5)], "row_id long, feature string, z double")
    scores = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "feature string, score double")
    got = {r.row_id: r.weight for r in prior.sample_weights(z, scores, prior.PriorConfig(sample_map=prior.IDENTITY)).collect()}
    assert set(got) == {1, 2} and got[1] is not None and got[1] <= got[2]


def test_deep_json_is_left_out(spark):
    df = spark.createDataFrame([("{\"a\": " * 12000 + " {\"b\": 1}",), (None,), ("x {\"c\": {}} y",)], "t string")
    got = [r.objects for r in scoring.json_objects(df, "t").collect()]
    assert [json.loads(x) for x in got[0]] == [{"b": 1}] and got[1] == [] and got[2] == ['{"c": {}}', "{}"]


def test_the_first_valid_object_counts(spark):
    class Said:
        def ask(self, prompts):
            return prompts.withColumn("attempt", scoring.F.lit(0)).withColumn("answer", scoring.F.lit('draft {"scores": {"x": 1}} then {"scores": {"A": 0.5, "b": 0.25}}'))

    prompts = spark.createDataFrame([("p", ["a", "B"])], "prompt_key string, names array<string>")
    (r,) = scoring.structured_calls(prompts, Said()).collect()
    assert r.success and r.scores == {"a": 0.5, "B": 0.25}


def test_null_vectors_are_like_nothing(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 1.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id long, embedding array<double>")
    assert [(r.query_id, r.doc_id) for r in scoring.nearest(asked, store, 5).orderBy("rank").collect()] == [(7, 1), (7, 4)]


def test_repeated_names_in_a_sample_file(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("gene\tn\nA\t1\nA\t3\nB\t2\n__sum\t9\n")
    (r,) = files.read_sample_rows(spark, str(tmp_path / "s.tsv"), "gene", "n", "__").collect()
    assert r.features == {"A": 3.0, "B": 2.0}
