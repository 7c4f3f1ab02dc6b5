"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .arrow_text import slices
from .features import groups, mix, pairs

BITS = 20
#: A word's stem is its first so many bytes: inflected and compounded forms share it.
STEM = 6
#: Bytes of labelled texts of each class that a classifier is fitted on at most, besides the bound on their number.
SAMPLE_BYTES = 64 << 20


def gram_slots(w, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word, its stem, pair of neighbours, and pair that skips one or two words, hashed to 2^bits slots."""
    has = w.core != 0
    has[: w.old] = False
    got = [(w.row[has], w.core[has]), (w.row[has], mix(w.stem[has] + np.uint64(11)))] + [pairs(w, w.core, gap, gap) for gap in (1, 2, 3)]
    row = np.concatenate([r for r, _ in got])
    return row, (np.concatenate([h for _, h in got]) >> np.uint64(64 - bits)).astype(np.int64)


def _row_slots(col: pa.Array, bits: int) -> list[np.ndarray]:
    """Distinct slots of each text."""
    parts: list[list[np.ndarray]] = [[] for _ in range(len(col))]
    for w in groups(col, shapes=False, stem=STEM, carry=3):
        row, slot = gram_slots(w, bits)
        key = np.unique(row.astype(np.int64) << bits | slot)
        r = key >> bits
        cut = np.flatnonzero(np.diff(r)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(r)]):
            if e > s:
                parts[int(r[s])].append(key[s:e] & ((1 << bits) - 1))
    return [np.unique(np.concatenate(p)) if len(p) > 1 else p[0] if p else np.zeros(0, np.int64) for p in parts]


def fit_ftrl(slots: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = 10, alpha: float = 5.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, seed: int = 5):
    """(slots, weights, bias) that aren't zero. Features are present or absent; each coordinate has its own rate
    alpha / (beta + sqrt(sum of its squared gradients)) and is zero until the gradients outweigh ``l1``."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, bias_n = 0.0, 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(slots)):
            x = slots[k]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - labels[k]
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return at, w[at], bias


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, y, text) of at most ``per_class`` labelled documents of each class, in the order of a hash of the id, up to the
    document whose text reaches ``max_bytes`` together with those before it.

    A document labelled more than once has the mean of its labels, at least 0.5 for class 1; null labels don't count.
    Repeated rows of a document count once (the greatest text).
    """
    one = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).dropna().filter(allowed(F.col("id")))
    one = one.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        part = one.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = text.join(F.broadcast(picked), "id")  # at most 2 * per_class rows
    found = joined.groupBy("id", "y").agg(F.max("text").alias("text"))
    before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < max_bytes).drop("before")


def train(docs: DataFrame, labels: DataFrame, allowed, label: str = "toxic", per_class: int = 2500, bits: int = BITS, **cols):
    """Weights from at most ``per_class`` labelled documents of each class; the driver gets their slots, not texts."""
    sample = labelled_sample(docs, labels, label, per_class, allowed, **cols)
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("slots", pa.binary())])

    def run(batches):
        for b in slices(batches):
            rows = [s.astype(np.uint32).tobytes() for s in _row_slots(b.column(2), bits)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(rows, pa.binary())], schema=schema)

    rows = sample.select("id", "y", "text").mapInArrow(run, "id long, y int, slots binary").collect()
    rows.sort(key=lambda r: (r.id is None, r.id))
    slots = [np.frombuffer(r.slots, np.uint32).astype(np.int64) for r in rows]
    return fit_ftrl(slots, np.array([r.y for r in rows], float), bits)


def score_toxicity(docs: DataFrame, model, threshold: float = 0.7, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: probability of class 1 for every whole text.

    The weights that aren't zero are broadcast: no more than the sample's distinct slots. Null and empty texts get the
    bias alone; a score of just ``threshold`` is class 1. Whole texts, however long. Rows are scored one by one, so
    repeated rows agree; an empty table gives an empty one; other columns, whatever their names, aren't read.
    """
    at, weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights, bias))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        at, weights, bias = sent.value
        dense = np.zeros(1 << bits)
        dense[at] = weights
        for b in slices(batches):
            total = np.full(b.num_rows, bias)
            held = [np.zeros(0, np.int64)]
            for w in groups(b.column(1), shapes=False, stem=STEM, carry=3):
                row, slot = gram_slots(w, bits)
                on = dense[slot] != 0
                held.append(np.unique(row[on].astype(np.int64) << bits | slot[on]))
            key = np.unique(np.concatenate(held))
            np.add.at(total, key >> bits, dense[key & ((1 << bits) - 1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
