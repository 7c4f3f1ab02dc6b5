"""Language-model scores as data: prompts, answers, trials, costs, retrieval (B20-B25, G8-G11, G13, Q1-Q10), offline."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import even_batches

SCORES_DDL = "scores MAP<STRING,DOUBLE>, reasoning MAP<STRING,STRING>"


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{{key}} becomes the value."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), v)
    return template


def open_placeholders(text: Column) -> Column:
    """The keys that a filled template still names."""
    return F.regexp_extract_all(text, F.lit(r"\{\{(\w+)\}\}"), F.lit(1))


def _objects(text: str | None) -> list[str]:
    out, at, read = [], 0, json.JSONDecoder()
    while text and (at := text.find("{", at)) >= 0:
        try:
            value, _ = read.raw_decode(text, at)
            out.append(json.dumps(value, sort_keys=True))
        except (ValueError, RecursionError):  # malformed, or nested beyond what Python reads
            pass
        at += 1
    return out


def json_objects(df: DataFrame, col: str, out: str = "objects") -> DataFrame:
    """Every JSON object in a text, nested ones too, in order of their opening brace; malformed ones are left out."""

    @F.pandas_udf("array<string>")
    def found(s: pd.Series) -> pd.Series:
        return s.map(_objects)

    return df.withColumn(out, found(F.col(col)))


def typed_answer(text: Column) -> Column:
    """Struct of scores and reasoning, null fields where the text has none."""
    return F.from_json(text, SCORES_DDL)


def key_differences(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """(key, wanted, got, problem): names by lower case; problem is 'missing', 'extra' or null; ``wanted`` is canonical."""
    w = wanted.select(F.lower("name").alias("key"), F.col("name").alias("wanted"))
    g = got.select(F.lower("name").alias("key"), F.col("name").alias("got"))
    return w.join(g, "key", "full_outer").withColumn("problem", F.when(F.col("got").isNull(), "missing").when(F.col("wanted").isNull(), "extra"))


def document_text(metadata: Column, content: Column) -> Column:
    """B25."""
    return F.concat(F.lit("METADATA: "), metadata, F.lit(";\nCONTENT: "), content)


def config_label(**parts: Column) -> Column:
    """B24: 'key=value' pairs joined by commas."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])


def mean_scores(trials: DataFrame) -> DataFrame:
    """(feature, score): mean over trials (maps)."""
    return trials.select(F.explode("scores").alias("feature", "score")).groupBy("feature").agg(F.avg("score").alias("score"))


def merge_batches(batches: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One map a trial; of a key that several batches have, the last batch's value; success if all succeeded."""
    ok = batches.groupBy(*keys).agg(F.bool_and("success").alias("success"))
    entries = batches.select(*keys, order, F.explode("scores").alias("feature", "score"))
    last = entries.groupBy(*keys, "feature").agg(F.max_by("score", order).alias("score"))
    maps = last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "score")))).alias("scores"))
    return ok.join(maps, keys, "left")


def token_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (model, input_tokens, output_tokens, ...) with costs; unknown models cost nothing."""
    got = calls.join(F.broadcast(prices), "model", "left")
    cost = lambda way: F.coalesce(F.col(f"{way}_cost_per_1M") * F.col(f"{way}_tokens") / F.lit(1e6), F.lit(0.0))
    return got.select(*calls.columns, cost("input").alias("input_cost"), cost("output").alias("output_cost"))


def total_costs(costs: DataFrame, keys: list[str]) -> DataFrame:
    """G9."""
    return costs.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "input_cost", "output_cost")])


def _matrix(column):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _norms(x):
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    return np.sqrt(total)


def _cosines(q, qn, x, xn):
    """Of rows one by one, summed from the first number to the last."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total / np.maximum(qn * xn, 1e-300)


def _merge(ids, sims, at, docs, sim):
    """The k best of each query, of those it has and the new pairs (at, docs, sim)."""
    some = np.unique(at)
    has_q, has_k = np.nonzero(sims[some] > -np.inf)
    q = np.concatenate([some[has_q], at])
    d, c = np.concatenate([ids[some[has_q], has_k], docs]), np.concatenate([sims[some[has_q], has_k], sim])
    order = np.lexsort((d, -c, q))
    q, d, c = q[order], d[order], c[order]
    k = ids.shape[1]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, d, c, place = (v[place < k] for v in (q, d, c, place))
    ids[q, place], sims[q, place] = d, c


def _fewer(docs, x, k: int):
    """Of equal vectors the k least ids: no other can be among the k best."""
    at = np.argsort(docs, kind="stable")
    rows = np.ascontiguousarray(x[at])
    same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(same, kind="stable")
    keep = order[np.arange(len(same)) - np.searchsorted(same[order], same[order]) < k]
    return docs[at[keep]], x[at[keep]]


def best_in_stream(batches: Iterator, names, q, k: int, block: int) -> Iterator[tuple]:
    """(query_id, doc_id, similarity) arrays: the k best of a stream of (doc_id, vector) batches for each row of q."""
    q = q.astype(np.float64)
    qn = _norms(q)
    unit = q / np.maximum(qn, 1e-300)[:, None]
    ids, sims = np.zeros((len(q), k), np.int64), np.full((len(q), k), -np.inf)
    for b in batches:
        for at in range(0, b.num_rows, block):
            part = b.slice(at, block)
            docs, x = _fewer(part.column(0).to_numpy(), _matrix(part.column(1)).astype(np.float64), k)
            xn = _norms(x)
            xu = (x / np.maximum(xn, 1e-300)[:, None]).T
            for s in range(0, len(q), block):
                sim = unit[s : s + block] @ xu
                least = sims[s : s + block, -1]
                if len(docs) > k and np.isneginf(least).any():
                    least = np.maximum(least, np.partition(sim, len(docs) - k, axis=1)[:, len(docs) - k])
                i, j = np.nonzero(sim >= (least - 1e-9)[:, None])
                for c in range(0, len(i), 1 << 16):
                    qi, dj = i[c : c + (1 << 16)] + s, j[c : c + (1 << 16)]
                    _merge(ids, sims, qi, docs[dj], _cosines(q[qi], qn[qi], x[dj], xn[dj]))
    have = sims > -np.inf
    out = [np.broadcast_to(names[:, None], have.shape)[have], ids[have], sims[have]]
    for s in range(0, len(out[0]), 1 << 16):
        yield tuple(v[s : s + (1 << 16)] for v in out)


def nearest(queries: DataFrame, store: DataFrame, k: int, vec: str = "embedding", block: int = 1024) -> DataFrame:
    """Q9: (query_id, doc_id, rank, similarity): the k documents most alike by cosine; ties by doc_id.

    Exact. Queries are collected and sent to every task (8 bytes a number); a task holds a block of them against a block of
    its documents and keeps its k best for each query before the shuffle. Products of blocks only leave pairs out, by a bound
    far wider than their rounding; the rest are computed number by number, so that equal vectors tie. Vectors that are null
    or hold a null are like nothing: they are left out.
    """
    import pyarrow as pa

    spark = queries.sparkSession
    whole = F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())

    asked = queries.filter(whole).select(F.col("query_id").cast("long"), vec).toArrow().combine_chunks()
    if not asked.num_rows:
        return spark.createDataFrame([], "query_id long, doc_id long, similarity double, rank int")
    sent = spark.sparkContext.broadcast((asked.column(0).to_numpy(), _matrix(asked.column(1).combine_chunks())))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        for got in best_in_stream(batches, *sent.value, k, block):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in got], schema=schema)

    spread = store.filter(whole).select(F.col("doc_id").cast("long"), vec).repartition(spark.sparkContext.defaultParallelism)
    best = spread.mapInArrow(run, "query_id long, doc_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class FileProvider:
    """Q1: answers from a table (prompt_key, attempt, answer), so that no network is needed."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def ask(self, prompts: DataFrame) -> DataFrame:
        return prompts.join(self.answers, "prompt_key", "left")


def structured_calls(prompts: DataFrame, provider, retries: int = 3) -> DataFrame:
    """Q2, Q3: for each prompt (prompt_key, names ARRAY<STRING>) its first attempt whose answer is valid; success null-safe.

    Valid: an object in the text has scores for exactly the names, whatever their case; they come back in canonical case.
    Of several such objects the first one counts.
    """
    tried = provider.ask(prompts).filter(F.col("attempt").isNull() | (F.col("attempt") < retries))
    parsed = json_objects(tried, "answer").withColumn("parsed", F.transform("objects", typed_answer))
    wanted = F.array_sort(F.transform("names", lambda k: F.lower(k)))
    fits = lambda p: F.coalesce(F.array_sort(F.transform(F.map_keys(p["scores"]), lambda k: F.lower(k))) == wanted, F.lit(False))
    rows = parsed.withColumn("parsed", F.get(F.filter("parsed", fits), F.lit(0))).withColumn("success", F.col("parsed").isNotNull())
    canonical = F.map_from_arrays("names", F.transform("names", lambda n: F.element_at(F.map_values(F.map_filter("parsed.scores", lambda k, _: F.lower(k) == F.lower(n))), 1)))
    rows = rows.withColumn("scores", F.when(F.col("success"), canonical))
    best = F.min_by(F.struct("attempt", "scores"), "attempt").alias("best")
    good = rows.filter("success").groupBy("prompt_key").agg(best)
    spent = rows.groupBy("prompt_key").agg(F.count("attempt").alias("attempts"))
    return spent.join(good, "prompt_key", "left").select("prompt_key", "attempts", F.col("best").isNotNull().alias("success"), F.col("best.scores").alias("scores"))


def prompts_for(features: DataFrame, template: str, batch_size: int = 40, context: str = "") -> DataFrame:
    """Q5, Q7: (prompt_key, names, prompt): even batches of features in one template each."""
    batched = even_batches(features, "feature", batch_size).groupBy("batch").agg(F.array_sort(F.collect_list("feature")).alias("names"))
    prompt = fill_template(F.lit(template), {"features": F.array_join("names", ", "), "context": F.lit(context)})
    return batched.select(F.col("batch").alias("prompt_key"), "names", prompt.alias("prompt"))


def run_trials(make: Callable[[int], DataFrame], done: set[int], n: int) -> Iterator[DataFrame]:
    """Q6: the trials not done yet, one after another, up to the first that fails."""
    for t in range(n):
        if t in done:
            continue
        rows = make(t).withColumn("trial", F.lit(t))
        yield rows
        if not rows.agg(F.bool_and("success")).first()[0]:
            return
