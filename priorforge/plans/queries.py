"""Queries over the driver's tables for every operator, with DuckDB SQL beside them where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import metrics, prep, prior, ranking, results, scoring, selection, splits, synthetic
from ..operators.prior import PriorConfig
from . import experiment

QUERIES: dict = {}
ORACLES: dict = {}

#: Feature scores stand in for a language model's.
SCORE_SQL = "0.1 + 0.9 * (j % 10) / 9.0"
LONG = "SELECT vec_id AS row_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS x, label FROM embeddings"
SCORES = "SELECT j, 0.1::DOUBLE + 0.9::DOUBLE * (j % 10)::DOUBLE / 9.0::DOUBLE AS score FROM generate_series(0, 63) t(j)"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(spark, d) -> DataFrame:
    return prep.long_features(read(spark, d, "embeddings"), "vec_id", "embedding")


def rows(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") < 5).cast("int").alias("label"))


def scores(spark, key: str = "feature") -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias(key), (F.lit(0.1) + F.lit(0.9) * (F.col("id") % 10).cast("double") / F.lit(9.0)).alias("score"))


def rounded(df: DataFrame, *cols: str, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- preparation

@query("cat_codes_lineitem", """
WITH f AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem WHERE l_returnflag IS NOT NULL)),
s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT l_linestatus AS v FROM lineitem WHERE l_linestatus IS NOT NULL))
SELECT coalesce(f.c, -1)::INTEGER AS flag_code, coalesce(s.c, -1)::INTEGER AS status_code, count(*) AS n
FROM lineitem LEFT JOIN f ON l_returnflag = f.v LEFT JOIN s ON l_linestatus = s.v GROUP BY 1, 2""")
def cat_codes(spark, d):
    df = prep.category_codes(prep.category_codes(read(spark, d, "lineitem").select("l_returnflag", "l_linestatus"), "l_returnflag", "flag_code"), "l_linestatus", "status_code")
    return df.groupBy("flag_code", "status_code").agg(F.count("*").alias("n"))


@query("label_first_seen", """
SELECT o_orderpriority, min(o_orderkey) AS first_row, (row_number() OVER (ORDER BY min(o_orderkey)) - 1)::INTEGER AS code FROM orders GROUP BY o_orderpriority""")
def label_first_seen(spark, d):
    return prep.first_seen_codes(read(spark, d, "orders"), "o_orderpriority", "o_orderkey")


@query("zero_impute", """
WITH m AS (SELECT round(avg(value) FILTER (WHERE value >= 20), 4) AS v FROM events)
SELECT event_id, CASE WHEN value < 20 THEN m.v ELSE value END AS value FROM events, m""")
def zero_impute(spark, d):
    return prep.impute_marked(read(spark, d, "events").select("event_id", "value"), ["value"], lambda c: c < 20)


@query("label_map", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status FROM orders""")
def label_map(spark, d):
    return read(spark, d, "orders").select("o_orderkey", prep.map_values(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"))


@query("prefix_exclude", "SELECT p_partkey, p_brand FROM part WHERE p_brand IS NOT NULL AND NOT starts_with(p_brand, 'Brand#1')")
def prefix_exclude(spark, d):
    return prep.exclude_prefix(read(spark, d, "part"), "p_brand", "Brand#1").select("p_partkey", "p_brand")


@query("split_first", "SELECT p_partkey, split_part(p_type, ' ', 1) AS first_word FROM part")
def split_first(spark, d):
    return read(spark, d, "part").select("p_partkey", prep.first_part(F.col("p_type"), " ").alias("first_word"))


@query("regex_strip", "SELECT c_custkey, regexp_replace(c_name, '#.*$', '') AS name FROM customer")
def regex_strip(spark, d):
    return read(spark, d, "customer").select("c_custkey", prep.strip_suffix(F.col("c_name"), "#.*$").alias("name"))


@query("rename_strip_cast", """SELECT s_suppkey AS key, s_name AS name, s_nationkey::DOUBLE AS nation, s_acctbal::VARCHAR IS NOT NULL AS has_balance FROM supplier""")
def rename_strip_cast(spark, d):
    df = prep.strip_names(read(spark, d, "supplier").withColumnRenamed("s_suppkey", " s_suppkey "))
    df = prep.rename(df, {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation"})
    return df.select("key", "name", F.col("nation").cast("double").alias("nation"), F.col("s_acctbal").isNotNull().alias("has_balance"))


@query("equality_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def equality_filter(spark, d):
    return read(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_totalprice")


@query("group_mean_join", """
SELECT c_mktsegment, round(avg(o_totalprice), 6) AS mean_o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def group_mean_join(spark, d):
    joined = read(spark, d, "orders").select("o_custkey", "o_totalprice").join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rounded(prep.group_mean(joined, ["c_mktsegment"], ["o_totalprice"]), "mean_o_totalprice", digits=6)


@query("fallback_lookup", """
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'nation ' || n_nationkey END AS display FROM nation""")
def fallback_lookup(spark, d):
    nation = read(spark, d, "nation")
    keyed = nation.select("n_nationkey", F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("k"))
    names = nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("k"), F.col("n_name").alias("v"))
    return prep.fallback(keyed, names, "k", "v", "display").select("n_nationkey", "display")


@query("transpose_group_mean", f"""
SELECT row_id, j % 16 AS feature, round(avg(x), 8) AS x FROM ({LONG}) GROUP BY 1, 2""")
def transpose_group_mean(spark, d):
    return rounded(prep.collapse_features(long(spark, d), (F.col("j") % 16).cast("long")), "x")


@query("pivot_wide", """SELECT vec_id AS row_id, embedding[1]::DOUBLE AS "0", embedding[2]::DOUBLE AS "1" FROM embeddings""")
def pivot_wide(spark, d):
    return prep.wide_features(long(spark, d).filter("j < 2"), [0, 1])


@query("pivot_wide_all", "SELECT vec_id AS row_id, " + ", ".join(f'embedding[{j + 1}]::DOUBLE AS "{j}"' for j in range(64)) + " FROM embeddings")
def pivot_wide_all(spark, d):
    """All 64 features; pivot_wide and its SQL have the first two."""
    return prep.wide_features(long(spark, d), list(range(64)))


@query("having_min_total", """
SELECT l_partkey, sum(round_even(l_quantity, 0)::BIGINT)::BIGINT AS total FROM lineitem GROUP BY 1 HAVING total >= 800""")
def having_min_total(spark, d):
    return prep.having_total(read(spark, d, "lineitem"), "l_partkey", F.col("l_quantity"), 800)


@query("feature_variance_topk", f"""
SELECT j::INTEGER AS feature, round(var_samp(x), 8) AS variance FROM ({LONG}) GROUP BY j ORDER BY var_samp(x) DESC, j LIMIT 10""")
def feature_variance_topk(spark, d):
    best = ranking.top_k(prep.feature_variance(long(spark, d)), 10, F.desc("variance"), F.col("j"))
    return best.select(F.col("j").alias("feature"), F.round("variance", 8).alias("variance"))


STANDARD = f"""l AS ({LONG}), st AS (SELECT j, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY j),
z AS (SELECT row_id, l.j, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM l JOIN st USING (j))"""


@query("standardise", f"WITH {STANDARD} SELECT row_id, j::INTEGER AS j, round(z, 7) AS z FROM z")
def standardise(spark, d):
    return rounded(prep.standardise(long(spark, d)), "z", digits=7)


@query("keep_features", f"SELECT row_id, j::INTEGER AS j, x FROM ({LONG}) WHERE j IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def keep_features(spark, d):
    return prep.keep_features(long(spark, d), read(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("j")))


@query("class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(spark, d):
    return prep.class_counts(read(spark, d, "embeddings"), "label")


@query("dedup_docs", """
WITH m AS (SELECT doc_id, length(text) % 50 AS content, lang, source FROM documents)
SELECT content, lang, source, min(doc_id) AS doc_id FROM m GROUP BY 1, 2, 3""")
def dedup_docs(spark, d):
    docs = read(spark, d, "documents").select("doc_id", (F.length("text") % 50).cast("long").alias("content"), F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("meta"))
    got = prep.distinct_documents(docs, "content", "meta", "doc_id")
    value = lambda k: F.filter("metadata", lambda e: e["key"] == k)[0]["value"]
    return got.select("content", value("lang").alias("lang"), value("source").alias("source"), "doc_id")


@query("dedup_docs_text", """
SELECT text AS content, lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2, 3""")
def dedup_docs_text(spark, d):
    """G11 over the whole text; dedup_docs and its SQL stand for it with the length modulo 50."""
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("meta"))
    got = prep.distinct_documents(docs, "content", "meta", "doc_id")
    value = lambda k: F.filter("metadata", lambda e: e["key"] == k)[0]["value"]
    return got.select("content", value("lang").alias("lang"), value("source").alias("source"), "doc_id")


@query("union_difference", """
SELECT 'u' AS part, count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer)
UNION ALL SELECT 'd', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")
def union_difference(spark, d):
    s, c = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), read(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return prep.union_all([prep.union_all([s, c]).agg(F.lit("u").alias("part"), F.count("*").alias("n")), prep.difference(n, s).agg(F.lit("d").alias("part"), F.count("*").alias("n"))])


# ---- splits

@query("split_config", """
WITH c AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)),
r AS (SELECT k, (k + 1) / 10.0::DOUBLE AS ratio FROM generate_series(0, 7) t(k))
SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS ratio_idx, round(ratio, 6) AS train_ratio, round(greatest(0.2, 4.0 / least), 6) AS test_ratio
FROM r, c WHERE ratio >= 4.0 / least AND ratio + greatest(0.2, 4.0 / least) <= 1 + 1e-12""")
def split_config(spark, d):
    least = prep.class_counts(read(spark, d, "embeddings"), "label").agg(F.min("n")).first()[0]
    return rounded(spark.createDataFrame(splits.split_plan(least), "ratio_idx int, train_ratio double, test_ratio double"), "train_ratio", "test_ratio", digits=6)


PLAN = [(0, 0.2, 0.2), (1, 0.5, 0.2)]
SPLIT = """
WITH r AS (SELECT {key} AS row_id, {label} AS label FROM {table}), s AS (SELECT * FROM r, generate_series(0, {last}) t(split_idx)),
o AS (SELECT *, row_number() OVER (PARTITION BY split_idx, label ORDER BY md5('42:' || split_idx || ':' || row_id)) AS k, count(*) OVER (PARTITION BY split_idx, label) AS n FROM s),
p(ratio_idx, train_ratio, test_ratio) AS (VALUES (0, 0.2::DOUBLE, 0.2::DOUBLE), (1, 0.5::DOUBLE, 0.2::DOUBLE)),
sp AS (SELECT ratio_idx::INTEGER AS ratio_idx, train_ratio, split_idx::INTEGER AS split_idx, row_id,
  CASE WHEN k <= floor(n * test_ratio + 1e-9) THEN 'test' WHEN k <= floor(n * test_ratio + 1e-9) + floor(n * train_ratio + 1e-9) THEN 'train' END AS part FROM o, p)"""
STRATIFIED = SPLIT.format(key="vec_id", label="(label < 5)::INTEGER", table="embeddings", last=2)


@query("stratified_split", STRATIFIED + " SELECT * FROM sp WHERE part IS NOT NULL")
def stratified_split(spark, d):
    return splits.shuffle_split(rows(spark, d), PLAN, 3)


@query("shuffle_split", SPLIT.format(key="o_orderkey", label="0", table="orders", last=1) + " SELECT * FROM sp WHERE part IS NOT NULL")
def shuffle_split(spark, d):
    return splits.shuffle_split(read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")), PLAN, 2, label=None)


FOLD = "SELECT {key} AS row_id, ((row_number() OVER ({by} ORDER BY md5('42:' || {key})) - 1) % 5)::INTEGER AS fold FROM {table}"


@query("kfold_stratified", FOLD.format(key="vec_id", by="PARTITION BY label < 5", table="embeddings"))
def kfold_stratified(spark, d):
    return splits.k_fold(rows(spark, d), 5)


@query("kfold_plain", FOLD.format(key="o_orderkey", by="", table="orders"))
def kfold_plain(spark, d):
    return splits.k_fold(read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")), 5, label=None)


@query("train_test_gather", STRATIFIED + " SELECT e.vec_id AS row_id, e.label FROM embeddings e JOIN sp ON sp.row_id = e.vec_id WHERE ratio_idx = 1 AND split_idx = 2 AND part = 'train'")
def train_test_gather(spark, d):
    data = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    return splits.gather(data, splits.shuffle_split(rows(spark, d), PLAN, 3), 1, 2, "train")


@query("crop_remap", STRATIFIED + """ SELECT e.vec_id AS row_id, (row_number() OVER (ORDER BY e.vec_id) - 1) AS new_id FROM embeddings e
WHERE e.vec_id IN (SELECT row_id FROM sp WHERE part IS NOT NULL AND ratio_idx = 0 AND split_idx = 0)""")
def crop_remap(spark, d):
    data = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"))
    return splits.crop(data, splits.shuffle_split(rows(spark, d), PLAN[:1], 1))


@query("oversample_rows")
def oversample_rows(spark, d):
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    return splits.oversample(labels).groupBy("label", (F.col("draw") > 0).alias("drawn")).agg(F.count("*").alias("n"))


@query("oversampled_folds")
def oversampled_folds(spark, d):
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    return splits.oversampled_folds(labels, 3).groupBy("fold", "part", "label").agg(F.count("*").alias("n"))


@query("oversample_columns")
def oversample_columns(spark, d):
    return splits.oversample_features(scores(spark), 32)


# ---- priors

def _importance_sql(raw: str) -> str:
    return f"WITH sc AS ({SCORES}), r AS (SELECT j, {raw} AS s FROM sc) SELECT j::INTEGER AS feature, round(s / (avg(s) OVER () + 1e-4), 8) AS importance FROM r"


for _name, _config, _raw in (
    ("identity", PriorConfig(2.0), "pow(score + 1e-4, 2.0)"),
    ("sqrt", PriorConfig(2.0, feature_map=prior.SQRT), "pow(sqrt(score + 1e-4), 2.0)"),
    ("power", PriorConfig(1.5, feature_map=prior.POWER, power=2.0), "pow(score + 1e-4, 3.0)"),
    ("exp", PriorConfig(1.0, feature_map=prior.EXP, exp_tau=2.0), "exp(2.0::DOUBLE * score)"),
    ("uniform", PriorConfig(0.0), "1.0::DOUBLE"),
):
    query(f"prior_scores_{_name}", _importance_sql(_raw))(lambda spark, d, c=_config: rounded(prior.importance(scores(spark), c), "importance"))


@query("prior_penalty", f"SELECT j::INTEGER AS feature, round(pow(score + 1e-4, -2.0), 8) AS penalty FROM ({SCORES})")
def prior_penalty(spark, d):
    return rounded(prior.penalty(scores(spark), PriorConfig(2.0)), "penalty")


@query("penalty_norm", f"SELECT j::INTEGER AS feature, round(pow(score + 1e-4, -1.0) / sum(pow(score + 1e-4, -1.0)) OVER (), 8) AS penalty FROM ({SCORES})")
def penalty_norm(spark, d):
    return rounded(prior.normalised_penalty(scores(spark), PriorConfig(1.0)), "penalty")


def _weights_sql(mapped: str) -> str:
    return f"""WITH {STANDARD}, sc AS ({SCORES}), s AS (SELECT j, (score + 1e-4) / (avg(score + 1e-4) OVER () + 1e-4) AS s FROM sc),
c AS (SELECT row_id, sum(s * abs(z)) / (sqrt(sum(s * s)) * sqrt(sum(z * z))) AS c FROM z JOIN s USING (j) GROUP BY row_id),
w AS (SELECT row_id, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER () + 1e-4) AS w FROM c)
SELECT row_id, round({mapped}, 7) AS weight FROM w"""


for _name, _map, _sql in (("identity", prior.IDENTITY, "0.5 + 0.5 * w"), ("power", prior.POWER, "pow(w, 0.5)"), ("exp", prior.EXP, "exp(0.5 * w)")):
    query(f"sample_weights_{_name}", _weights_sql(_sql))(
        lambda spark, d, m=_map: rounded(
            prior.sample_weights(prep.standardise(long(spark, d)).withColumnRenamed("j", "feature"), scores(spark), PriorConfig(1.0, 0.5, sample_map=m)), "weight", digits=7
        )
    )


@query("adv_one_minus", f"SELECT j::INTEGER AS feature, round(1 - score, 8) AS score FROM ({SCORES})")
def adv_one_minus(spark, d):
    return rounded(prior.one_minus(scores(spark)), "score")


@query("adv_inverse", f"SELECT j::INTEGER AS feature, round(1 / (score + 1e-3), 8) AS score FROM ({SCORES})")
def adv_inverse(spark, d):
    return rounded(prior.inverse(scores(spark)), "score")


PERMUTED = """p AS (SELECT a.f AS feature, b.f AS permuted FROM (SELECT f, row_number() OVER (ORDER BY f) AS k FROM n) a JOIN (SELECT f, row_number() OVER (ORDER BY md5('42:' || f)) AS k FROM n) b USING (k))"""


@query("adv_permute_scores", f"WITH sc AS ({SCORES}), n AS (SELECT j::INTEGER AS f FROM sc), {PERMUTED} SELECT feature, round(score, 8) AS score FROM p JOIN sc ON permuted = j")
def adv_permute_scores(spark, d):
    return rounded(prior.permuted_scores(scores(spark)), "score")


@query("adv_permute_names", f"WITH n AS (SELECT n_name AS f FROM nation), {PERMUTED} SELECT feature AS n_name, permuted FROM p")
def adv_permute_names(spark, d):
    return splits.permute(read(spark, d, "nation"), "n_name")


@query("adv_fake_names")
def adv_fake_names(spark, d):
    names = read(spark, d, "nation").select(F.col("n_name").alias("feature"))
    return synthetic.fake_names(names, names.select(F.col("feature").alias("name")), 0.4)


@query("prior_restrict", f"""
WITH sc AS ({SCORES}) SELECT n_regionkey AS split_idx, n_nationkey AS feature, round(score, 8) AS score FROM nation JOIN sc ON n_nationkey = j""")
def prior_restrict(spark, d):
    chosen = read(spark, d, "nation").select(F.col("n_regionkey").alias("split_idx"), F.col("n_nationkey").alias("feature"))
    return rounded(prior.restrict(scores(spark), chosen, ["split_idx"]), "score")


@query("sweep_grid", """
SELECT (row_number() OVER (ORDER BY temperature, beta) - 1)::INTEGER AS config, temperature, beta FROM (
SELECT 0.0::DOUBLE AS temperature, 0.0::DOUBLE AS beta UNION ALL SELECT t, b FROM (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) x(t), (VALUES (0.25::DOUBLE), (0.5::DOUBLE)) y(b))""")
def sweep_grid(spark, d):
    return prior.PriorSweep((0.0, 1.0, 2.0), (0.25, 0.5)).table(spark, True)


# ---- metrics

LINEAR = f"pr AS (SELECT row_id, any_value(label < 5)::INTEGER AS y, sum(x * s.score) AS z FROM ({LONG}) l JOIN ({SCORES}) s USING (j) GROUP BY row_id)"


def linear(spark, d) -> DataFrame:
    """z = sum of score * x for every row."""
    z = long(spark, d).join(F.broadcast(scores(spark, "j")), "j").groupBy("row_id").agg(F.sum(F.col("x") * F.col("score")).alias("z"))
    return z.join(rows(spark, d).withColumnRenamed("label", "y"), "row_id")


@query("metric_accuracy_mcc", f"""
WITH {LINEAR}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND z > 0)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND z <= 0)::DOUBLE AS tn,
count(*) FILTER (WHERE y = 0 AND z > 0)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND z <= 0)::DOUBLE AS fn FROM pr)
SELECT round((tp + tn) / (tp + tn + fp + fn), 8) AS accuracy, round(1 - (tp + tn) / (tp + tn + fp + fn), 8) AS misclass,
round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 8) AS mcc FROM c""")
def metric_accuracy_mcc(spark, d):
    return rounded(metrics.classification(linear(spark, d)), "accuracy", "misclass", "mcc")


@query("metric_auroc", f"""
WITH {LINEAR}, r AS (SELECT y, rank() OVER (ORDER BY round(z, 9)) + (count(*) OVER (PARTITION BY round(z, 9)) - 1) / 2.0::DOUBLE AS r FROM pr)
SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 8) AS auroc FROM r""")
def metric_auroc(spark, d):
    return rounded(metrics.auroc(rounded(linear(spark, d), "z", digits=9)), "auroc")


@query("metric_auroc_grouped", """
WITH r AS (SELECT event_type, (user_id % 2)::INTEGER AS y, rank() OVER (PARTITION BY event_type ORDER BY round(value, 1)) + (count(*) OVER (PARTITION BY event_type, round(value, 1)) - 1) / 2.0::DOUBLE AS r FROM events)
SELECT event_type, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 8) AS auroc FROM r GROUP BY event_type""")
def metric_auroc_grouped(spark, d):
    df = read(spark, d, "events").select("event_type", (F.col("user_id") % 2).cast("int").alias("y"), F.round("value", 1).alias("z"))
    return rounded(metrics.auroc(df, ["event_type"]), "auroc")


@query("metric_mse", "SELECT o_orderpriority, round(avg((o_totalprice / 1000 - o_custkey % 100) ** 2), 6) AS mse FROM orders GROUP BY 1")
def metric_mse(spark, d):
    df = read(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_custkey") % 100).alias("z"))
    return rounded(metrics.mse(df, ["o_orderpriority"]), "mse", digits=6)


@query("metric_logloss", f"WITH {LINEAR} SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 8) AS logloss FROM pr")
def metric_logloss(spark, d):
    return rounded(metrics.log_loss(linear(spark, d)), "logloss")


@query("cv_errors", f"WITH {LINEAR} SELECT round(-avg((((z > 0)::INTEGER) = y)::INTEGER::DOUBLE), 8) AS accuracy_error, round(avg((y - z) ** 2), 6) AS mse_error FROM pr")
def cv_errors(spark, d):
    z = linear(spark, d)
    a = metrics.classification(z).select(F.round(metrics.cv_error("accuracy", F.col("accuracy")), 8).alias("accuracy_error"))
    return a.crossJoin(metrics.mse(z).select(F.round(metrics.cv_error("mse", F.col("mse")), 6).alias("mse_error")))


@query("logit_class", """
SELECT event_id, round(ln(p / (1 - p)), 8) AS z, (p > 0.5)::INTEGER AS c FROM (SELECT event_id, greatest(1e-8, least(1 - 1e-8, value / 100)) AS p FROM events)""")
def logit_class(spark, d):
    z = metrics.clipped_logit(F.col("value") / 100)
    return read(spark, d, "events").select("event_id", F.round(z, 8).alias("z"), metrics.predicted_class(z).alias("c"))


@query("argmax_class", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS c FROM embeddings")
def argmax_class(spark, d):
    return read(spark, d, "embeddings").select("vec_id", metrics.predicted_index(F.col("embedding")).alias("c"))


# ---- stacking

MEMBER_Z = f"""mz AS (SELECT j % 4 AS member, row_id, any_value(label < 5)::INTEGER AS y, sum(x * sc.score) AS z FROM ({LONG}) l JOIN ({SCORES}) sc USING (j) GROUP BY 1, 2)"""


def members(spark, d) -> DataFrame:
    z = long(spark, d).join(F.broadcast(scores(spark, "j")), "j").groupBy((F.col("j") % 4).alias("member"), "row_id").agg(F.sum(F.col("x") * F.col("score")).alias("z"))
    return z.join(rows(spark, d).withColumnRenamed("label", "y"), "row_id")


@query("stack_predict", f"""
WITH {MEMBER_Z}, w(member, w) AS (VALUES (0, 0.5::DOUBLE), (1, 0.25::DOUBLE), (2, 0.0::DOUBLE), (3, 0.25::DOUBLE)) SELECT row_id, round(sum(w * z), 8) AS z FROM mz JOIN w USING (member) WHERE w > 0 GROUP BY row_id""")
def stack_predict(spark, d):
    w = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.0), (3, 0.25)], "member int, w double").filter("w > 0")
    return rounded(members(spark, d).join(F.broadcast(w), "member").groupBy("row_id").agg(F.sum(F.col("w") * F.col("z")).alias("z")), "z")


@query("stack_greedy", f"WITH {MEMBER_Z}, e AS (SELECT member, -avg(((z > 0)::INTEGER = y)::INTEGER::DOUBLE) AS e FROM mz GROUP BY member) SELECT member::INTEGER AS member, round(e, 8) AS cv_error FROM e ORDER BY e.e, member LIMIT 1")
def stack_greedy(spark, d):
    e = metrics.classification(members(spark, d), ["member"]).select("member", (-F.col("accuracy")).alias("cv_error"))
    best = e.agg(F.min(F.struct("cv_error", "member")).alias("b"))
    return best.select(F.col("b.member").alias("member"), F.round("b.cv_error", 8).alias("cv_error"))


@query("stack_topm", f"WITH {MEMBER_Z}, e AS (SELECT member, -avg(((z > 0)::INTEGER = y)::INTEGER::DOUBLE) AS e FROM mz GROUP BY member) SELECT member::INTEGER AS member, row_number() OVER (ORDER BY e.e, member)::INTEGER AS rank FROM e QUALIFY rank <= 2")
def stack_topm(spark, d):
    e = metrics.classification(members(spark, d), ["member"]).withColumn("g", F.lit(0))
    return ranking.top_k_per_group(e, ["g"], 2, -F.col("accuracy"), F.col("member")).select("member", "rank")


# ---- results

RESULT = "SELECT event_type AS name, upper(event_type) AS display_name, event_type < 'm' AS is_baseline, (1 + user_id % 8) / 10.0::DOUBLE AS train_ratio, event_id AS split_number, CASE WHEN event_id % 17 <> 0 THEN value END AS auroc FROM events"


def result_rows(spark, d) -> DataFrame:
    return read(spark, d, "events").select(
        F.col("event_type").alias("name"), F.upper("event_type").alias("display_name"), (F.col("event_type") < "m").alias("is_baseline"), ((1 + F.col("user_id") % 8) / 10.0).alias("train_ratio"),
        F.col("event_id").alias("split_number"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("auroc"),
    )


@query("results_summary", f"""
SELECT name, train_ratio, round(avg(auroc), 7) AS mean, round(stddev_samp(auroc), 7) AS sd, round(quantile_cont(auroc, 0.1), 7) AS q10, round(quantile_cont(auroc, 0.9), 7) AS q90,
arg_min(display_name, split_number) AS display_name, arg_min(is_baseline, split_number) AS is_baseline, count(auroc) AS n, round(1.96 * stddev_samp(auroc) / sqrt(count(auroc)), 7) AS ci95
FROM ({RESULT}) GROUP BY 1, 2""")
def results_summary(spark, d):
    return rounded(results.summary(result_rows(spark, d), "auroc"), "mean", "sd", "q10", "q90", "ci95", digits=7)


CELLS = "SELECT event_type AS name, user_id AS split_number, 1 AS train_ratio, max(round(value, 0)) AS auroc FROM events GROUP BY 1, 2"


def _win(strict: bool) -> str:
    op = ">" if strict else ">="
    return f"""WITH c AS ({CELLS}), w AS (SELECT split_number, max(auroc) FILTER (WHERE name = 'click') AS a, max(auroc) FILTER (WHERE name = 'view') AS b, max(auroc) FILTER (WHERE name = 'purchase') AS c FROM c GROUP BY 1)
SELECT round(avg((a {op} b)::INTEGER::DOUBLE), 8) AS "view", round(avg((a {op} c)::INTEGER::DOUBLE), 8) AS purchase FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"""


def _cells(spark, d) -> DataFrame:
    return read(spark, d, "events").groupBy(F.col("event_type").alias("name"), F.col("user_id").alias("split_number")).agg(F.max(F.round("value", 0)).alias("auroc")).withColumn("train_ratio", F.lit(1))


@query("win_ratio", _win(False))
def win_ratio(spark, d):
    return rounded(results.win_ratio(_cells(spark, d), "auroc", "click", ["view", "purchase"]), "view", "purchase")


@query("win_ratio_strict", _win(True))
def win_ratio_strict(spark, d):
    return rounded(results.win_ratio(_cells(spark, d), "auroc", "click", ["view", "purchase"], strict=True), "view", "purchase")


@query("results_replace", f"""
WITH r AS ({RESULT}), new AS (SELECT * REPLACE (-1.0::DOUBLE AS auroc) FROM r WHERE name = 'click' AND split_number % 10 = 0)
SELECT name, count(*) AS n, round(sum(auroc), 4) AS total FROM (SELECT * FROM r WHERE name NOT IN (SELECT name FROM new) UNION ALL SELECT * FROM new) GROUP BY name""")
def results_replace(spark, d):
    old = result_rows(spark, d)
    new = old.filter("name = 'click' AND split_number % 10 = 0").withColumn("auroc", F.lit(-1.0))
    return rounded(results.replace_methods(old, new).groupBy("name").agg(F.count("*").alias("n"), F.sum("auroc").alias("total")), "total", digits=4)


@query("experiment_grid_pending", """
WITH g AS (SELECT m.name, ratio_idx, split_idx, 42 + ratio_idx * 10 + split_idx AS seed FROM (SELECT DISTINCT event_type AS name FROM events) m, generate_series(0, 7) r(ratio_idx), generate_series(0, 9) s(split_idx)),
done AS (SELECT DISTINCT event_type AS name, user_id % 8 AS ratio_idx, event_id % 10 AS split_idx FROM events WHERE event_id % 3 = 0 AND event_id < 600)
SELECT name, ratio_idx::INTEGER AS ratio_idx, split_idx::INTEGER AS split_idx, seed::INTEGER AS seed FROM g WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.name = g.name AND d.ratio_idx = g.ratio_idx AND d.split_idx = g.split_idx)""")
def experiment_grid_pending(spark, d):
    events = read(spark, d, "events")
    ratios = spark.range(8).select(F.col("id").cast("int").alias("ratio_idx"))
    cells = results.grid(events.select(F.col("event_type").alias("name")).distinct(), ratios, 10)
    done = events.filter("event_id % 3 = 0 AND event_id < 600").select(F.col("event_type").alias("name"), (F.col("user_id") % 8).alias("ratio_idx"), (F.col("event_id") % 10).alias("split_idx"))
    return results.pending(cells, done)


# ---- scores of a language model

@query("score_mean_trials", """
SELECT 'k' AS feature, round(avg(json_extract(props, '$.k')::DOUBLE), 8) AS score FROM events""")
def score_mean_trials(spark, d):
    trials = read(spark, d, "events").select(F.from_json("props", "MAP<STRING,DOUBLE>").alias("scores"))
    return rounded(scoring.mean_scores(trials), "score")


@query("merge_batches", """
SELECT user_id, bool_and(event_type <> 'error') AS success, arg_max(json_extract(props, '$.k')::DOUBLE, event_id) AS k FROM events GROUP BY user_id""")
def merge_batches(spark, d):
    batches = read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("success"), F.from_json("props", "MAP<STRING,DOUBLE>").alias("scores"))
    return scoring.merge_batches(batches, ["user_id"], "event_id").select("user_id", "success", F.col("scores")["k"].alias("k"))


@query("key_validation", """
SELECT coalesce(lower(w.name), lower(g.name)) AS key, w.name AS wanted, g.name AS got, CASE WHEN g.name IS NULL THEN 'missing' WHEN w.name IS NULL THEN 'extra' END AS problem
FROM (SELECT n_name AS name FROM nation WHERE n_nationkey < 20) w FULL OUTER JOIN (SELECT lower(n_name) AS name FROM nation WHERE n_nationkey >= 5) g ON lower(w.name) = lower(g.name)""")
def key_validation(spark, d):
    n = read(spark, d, "nation")
    return scoring.key_differences(n.filter("n_nationkey < 20").select(F.col("n_name").alias("name")), n.filter("n_nationkey >= 5").select(F.lower("n_name").alias("name")))


PRICES = [("user", 2.0, 8.0), ("assistant", 10.0, 40.0)]


@query("token_cost", """
WITH p(model, i, o) AS (VALUES ('user', 2.0::DOUBLE, 8.0::DOUBLE), ('assistant', 10.0::DOUBLE, 40.0::DOUBLE))
SELECT conv_id, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, round(sum(coalesce(i * length(text) / 1e6, 0)), 8) AS input_cost, round(sum(coalesce(o * turn / 1e6, 0)), 8) AS output_cost
FROM conversations LEFT JOIN p ON role = model GROUP BY conv_id""")
def token_cost(spark, d):
    calls = read(spark, d, "conversations").select("conv_id", F.col("role").alias("model"), F.length("text").cast("long").alias("input_tokens"), F.col("turn").cast("long").alias("output_tokens"))
    priced = scoring.token_costs(calls, spark.createDataFrame(PRICES, "model string, input_cost_per_1M double, output_cost_per_1M double"))
    return rounded(scoring.total_costs(priced, ["conv_id"]), "input_cost", "output_cost")


@query("batching", "SELECT n_name, ((row_number() OVER (ORDER BY n_name) - 1) // 9)::INTEGER AS batch FROM nation")
def batching(spark, d):
    return ranking.even_batches(read(spark, d, "nation").select("n_name"), "n_name", 10)


@query("template_fill", """
SELECT n_nationkey, 'Rate ' || n_name || ' in {{unit}} of ' || n_regionkey AS prompt, ['unit'] AS open FROM nation""")
def template_fill(spark, d):
    t = scoring.fill_template(F.lit("Rate {{name}} in {{unit}} of {{region}}"), {"name": F.col("n_name"), "region": F.col("n_regionkey").cast("string")})
    return read(spark, d, "nation").select("n_nationkey", t.alias("prompt")).withColumn("open", scoring.open_placeholders(F.col("prompt")))


@query("document_format", "SELECT doc_id, 'METADATA: ' || lang || '/' || source || E';\\nCONTENT: ' || text AS doc FROM documents")
def document_format(spark, d):
    return read(spark, d, "documents").select("doc_id", scoring.document_text(F.concat_ws("/", "lang", "source"), F.col("text")).alias("doc"))


@query("config_labels", "SELECT n_nationkey, 'region=' || n_regionkey || ', name=' || n_name AS label FROM nation")
def config_labels(spark, d):
    return read(spark, d, "nation").select("n_nationkey", scoring.config_label(region=F.col("n_regionkey"), name=F.col("n_name")).alias("label"))


@query("json_objects", """SELECT event_id, 1::INTEGER AS n, json_extract(props, '$.k')::DOUBLE AS k FROM events""")
def json_objects(spark, d):
    noisy = read(spark, d, "events").select("event_id", F.concat(F.lit("answer {broken "), "props", F.lit(" } done")).alias("t"))
    got = scoring.json_objects(noisy, "t")
    return got.select("event_id", F.size("objects").alias("n"), F.from_json(F.col("objects")[0], "MAP<STRING,DOUBLE>")["k"].alias("k"))


@query("structured_calls", "SELECT n_nationkey::INTEGER AS prompt_key, 2::BIGINT AS attempts, true AS success, round(n_nationkey / 10.0, 4)::DOUBLE AS score FROM nation")
def structured_calls(spark, d):
    n = read(spark, d, "nation")
    prompts = n.select(F.col("n_nationkey").cast("int").alias("prompt_key"), F.array("n_name").alias("names"))
    text = lambda name: F.concat(F.lit('ok {"scores": {"'), name, F.lit('": '), (F.col("n_nationkey") / 10).cast("string"), F.lit('}, "reasoning": {}} end'))
    first = n.select(F.col("n_nationkey").cast("int").alias("prompt_key"), F.lit(0).alias("attempt"), text(F.lit("other")).alias("answer"))
    second = n.select(F.col("n_nationkey").cast("int").alias("prompt_key"), F.lit(1).alias("attempt"), text(F.lower("n_name")).alias("answer"))
    got = scoring.structured_calls(prompts, scoring.FileProvider(first.unionByName(second)))
    return got.select("prompt_key", "attempts", "success", F.round(F.map_values("scores")[0], 4).alias("score"))


@query("prompt_batches", """
WITH b AS (SELECT n_name, ((row_number() OVER (ORDER BY n_name) - 1) // 9)::INTEGER AS k FROM nation)
SELECT k AS prompt_key, 'Score: ' || string_agg(n_name, ', ' ORDER BY n_name) AS prompt FROM b GROUP BY k""")
def prompt_batches(spark, d):
    return scoring.prompts_for(read(spark, d, "nation").select(F.col("n_name").alias("feature")), "Score: {{features}}", 10).select("prompt_key", "prompt")


@query("knn_topk", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT query_id, doc_id, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS c FROM q, e)
SELECT query_id, doc_id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def knn_topk(spark, d):
    e = read(spark, d, "embeddings")
    got = scoring.nearest(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding"), 5)
    return rounded(got, "similarity", digits=6)


# ---- selection, learners

BINNED = f"""l AS ({LONG}), sp AS (SELECT j, min(x) AS lo, max(x) AS hi FROM l GROUP BY j),
bn AS (SELECT row_id, l.j, label, CASE WHEN hi = lo THEN 0 ELSE least(7, floor((x - lo) / (hi - lo) * 8)) END AS b FROM l JOIN sp USING (j))"""


@query("mi_topk", f"""
WITH {BINNED}, c AS (SELECT j, b, label, count(*)::DOUBLE AS n FROM bn GROUP BY ALL),
t AS (SELECT j, n, sum(n) OVER (PARTITION BY j) AS a, sum(n) OVER (PARTITION BY j, b) AS nb, sum(n) OVER (PARTITION BY j, label) AS ny FROM c),
m AS (SELECT j::INTEGER AS feature, sum(n / a * ln(n * a / (nb * ny))) AS score FROM t GROUP BY j)
SELECT row_number() OVER (ORDER BY score DESC, feature)::INTEGER AS rank, feature, round(score, 8) AS score FROM m QUALIFY rank <= 10""")
def mi_topk(spark, d):
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"))
    return rounded(selection.by_information(long(spark, d), labels, 10), "score")


@query("mrmr")
def mrmr(spark, d):
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"))
    return rounded(selection.mrmr(long(spark, d), labels, 8), "score")


@query("score_topk", f"SELECT row_number() OVER (ORDER BY score DESC, j)::INTEGER AS rank, j::INTEGER AS feature, round(score, 8) AS score FROM ({SCORES}) QUALIFY rank <= 7")
def score_topk(spark, d):
    return rounded(selection.by_score(scores(spark), 7), "score")


@query("random_subset", "SELECT row_number() OVER (ORDER BY md5('42:' || n_name))::INTEGER AS rank, n_name AS feature FROM nation QUALIFY rank <= 6")
def random_subset(spark, d):
    return selection.at_random(read(spark, d, "nation").select(F.col("n_name").alias("feature")), 6)


@query("score_histogram", "SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10)::BIGINT + 1 END AS bin, count(*) AS n FROM events GROUP BY 1")
def score_histogram(spark, d):
    return synthetic.histogram(read(spark, d, "events"), "value", 0.0, 100.0, 10)


@query("synthetic_signal")
def synthetic_signal(spark, d):
    return synthetic.labelled(synthetic.features(spark, 300, 12), 4, "tanh", 0.5)


def _study(spark, d, methods, n_splits=1):
    data = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") < 5).cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("features"))
    sp = splits.shuffle_split(rows(spark, d), PLAN[1:], n_splits)
    return experiment.run(data, sp, scores(spark, "j"), experiment.Study(methods=methods))


for _learner in ("lasso", "boosted", "forest", "kernel"):
    query(f"{_learner}_fit")(lambda spark, d, a=_learner: _study(spark, d, experiment.learner_study(a)))


@query("stack_base")
def stack_base(spark, d):
    return _study(spark, d, [experiment.ensemble()])


@query("stack_variants")
def stack_variants(spark, d):
    from ..functions import meta

    kinds = (meta.GREEDY, meta.STRATIFIED, meta.PRESELECTED, meta.POSTSELECTED, meta.POSTSELECTED_STRATIFIED)
    return _study(spark, d, [experiment.ensemble(k, stack=k) for k in kinds])


@query("baselines")
def baseline_methods(spark, d):
    return _study(spark, d, [*experiment.baselines(), experiment.prior_lasso(), experiment.no_prior_stack()])


@query("preselected_features")
def preselected_features(spark, d):
    data = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") < 5).cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("features"))
    return experiment.preselect(data, splits.shuffle_split(rows(spark, d), PLAN, 2), 8, "path")


@query("ridge_selected")
def ridge_selected(spark, d):
    data = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") < 5).cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("features"))
    sp = splits.shuffle_split(rows(spark, d), PLAN[1:], 1)
    return experiment.run(data, sp, scores(spark, "j"), experiment.Study(cv=3, methods=[experiment.ridge()]), preselected=experiment.preselect(data, sp, 8, "path"))


#: The flagship: split, prior, a prior-weighted linear score, and the test metrics of every split.
FLAGSHIP = STRATIFIED + f""", l AS ({LONG}), pen AS (SELECT j, (score + 1e-4) / (avg(score + 1e-4) OVER () + 1e-4) AS s FROM ({SCORES})),
pr AS (SELECT row_id, any_value(label < 5)::INTEGER AS y, sum(x * s) AS z FROM l JOIN pen USING (j) GROUP BY row_id),
t AS (SELECT ratio_idx, split_idx, y, z FROM sp JOIN pr USING (row_id) WHERE part = 'test')
SELECT ratio_idx, split_idx, round(avg(((z > 0)::INTEGER = y)::INTEGER::DOUBLE), 8) AS accuracy, round(avg((y - z) ** 2), 7) AS mse FROM t GROUP BY 1, 2"""


@query("flagship", FLAGSHIP)
def flagship(spark, d):
    importance = prior.importance(scores(spark), PriorConfig(1.0)).withColumnRenamed("feature", "j")
    z = long(spark, d).join(F.broadcast(importance), "j").groupBy("row_id").agg(F.sum(F.col("x") * F.col("importance")).alias("z"))
    test = splits.shuffle_split(rows(spark, d), PLAN, 3).filter("part = 'test'").select("ratio_idx", "split_idx", "row_id")
    scored = test.join(z, "row_id").join(rows(spark, d).withColumnRenamed("label", "y"), "row_id")
    keys = ["ratio_idx", "split_idx"]
    got = metrics.classification(scored, keys).select(*keys, "accuracy").join(metrics.mse(scored, keys), keys)
    return got.select(*keys, F.round("accuracy", 8).alias("accuracy"), F.round("mse", 7).alias("mse"))
