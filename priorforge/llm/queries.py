"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, embedding_dedup, line_dedup, quality, sentencepiece_codec, sharding, simhash, token_store, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    space = quality.fit(docs, labels, lambda c: fold(c, 5) != 0)
    return quality.score_quality(docs, space, threshold=0.3).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sentencepiece_codec.encode_documents(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return got.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, lambda c: fold(c, 3) != 1)
    return toxicity.score_toxicity(docs, model, threshold=0.7).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.new_path(spark)
    token_store.write_tokens(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path)
    return token_store.read_tokens(spark, path)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.page_edges(pages)).drop("alias_of")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.col("found.item_id").alias("item_ids"), F.coalesce(F.array_max("found.share"), F.lit(0.0)).alias("share"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=40)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP2_SQL = """
WITH RECURSIVE judged AS (
  SELECT page_id, html, url,
    CASE WHEN coalesce(url, '') LIKE '%://%' THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN coalesce(url, '') LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
targets AS (
  SELECT host, path, unnest([
      regexp_extract(regexp_extract(html, '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is'), '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is'),
      regexp_extract(regexp_extract(html, '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is'), '\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is')]) AS t
  FROM judged WHERE html IS NOT NULL AND url IS NOT NULL AND (lower(html) LIKE '%canonical%' OR lower(html) LIKE '%refresh%')),
urls AS (
  SELECT host || path AS a, CASE WHEN t LIKE '%://%' THEN replace(t, '&amp;', '&') WHEN t LIKE '//%' THEN 'http:' || replace(t, '&amp;', '&') WHEN t LIKE '/%' THEN 'http://' || host || replace(t, '&amp;', '&') END AS u
  FROM targets),
pairs AS (
  SELECT a, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS b
  FROM urls WHERE u IS NOT NULL),
edges AS (SELECT a, b FROM pairs WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM pairs WHERE a <> '' AND b <> '' AND a <> b),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
nodes AS (SELECT DISTINCT b AS node, CASE WHEN strpos(b, '/') = 0 THEN b ELSE left(b, strpos(b, '/') - 1) END AS h, CASE WHEN strpos(b, '/') = 0 THEN '' ELSE substr(b, strpos(b, '/')) END AS p FROM reach),
fitted AS (
  SELECT node, rverdict, row_number() OVER (PARTITION BY node ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
  FROM nodes JOIN rules ON (h = rhost OR h LIKE '%.' || rhost) AND starts_with(p, rpath)),
spread AS (SELECT r.a AS node, max(CASE f.rverdict WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS v FROM reach r LEFT JOIN fitted f ON f.node = r.b AND f.k = 1 GROUP BY r.a),
own AS (
  SELECT j.page_id, j.host, j.path, r.rhost || r.rpath AS rule, r.rverdict AS verdict
  FROM judged j LEFT JOIN rules r ON r.rhost || r.rpath = (
    SELECT q.rhost || q.rpath FROM rules q WHERE j.host <> '' AND (j.host = q.rhost OR j.host LIKE '%.' || q.rhost) AND starts_with(j.path, q.rpath) ORDER BY length(q.rhost || q.rpath) DESC, 1 LIMIT 1))
SELECT o.page_id, o.host, o.path, o.rule, coalesce(o.verdict, CASE WHEN s.v = 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM own o LEFT JOIN spread s ON s.node = o.host || o.path
"""

OP10_SQL = """
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k, doc_id, text FROM texts),
lines AS (SELECT k, doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM keyed),
filled AS (SELECT k, i, trim(l, ' ') AS l FROM lines WHERE trim(l, ' ') <> ''),
wins AS (
  SELECT k, i AS s, lead(i, 2) OVER w AS e, l AS a, lead(l, 1) OVER w AS b, lead(l, 2) OVER w AS c
  FROM filled WINDOW w AS (PARTITION BY k ORDER BY i)),
full_wins AS (SELECT * FROM wins WHERE e IS NOT NULL),
firsts AS (SELECT a, b, c, arg_min(struct_pack(k := k, s := s, e := e), struct_pack(k := k, s := s)) AS f FROM full_wins GROUP BY a, b, c HAVING count(*) > 1),
later AS (SELECT w.k, w.s, w.e FROM full_wins w JOIN firsts f ON w.a = f.a AND w.b = f.b AND w.c = f.c WHERE NOT (w.k = f.f.k AND w.s <= f.f.e)),
gone AS (SELECT DISTINCT k, unnest(generate_series(s, e)) AS i FROM later),
cut AS (
  SELECT l.k, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.l END, chr(10) ORDER BY l.i), '') AS text
  FROM lines l LEFT JOIN gone g ON g.k = l.k AND g.i = l.i GROUP BY l.k)
SELECT d.doc_id, c.text, coalesce(c.n_lines, 0)::INTEGER AS n_lines, coalesce(c.n_removed, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN keyed k ON k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.text = d.text LEFT JOIN cut c ON c.k = k.k
"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_url_filter": op2_url_filter,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_token_store": op6_token_store,
    "op7_decontamination": op7_decontamination,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_sharding": op9_sharding,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES = {"op2_url_filter": OP2_SQL, "op10_line_dedup": OP10_SQL}
