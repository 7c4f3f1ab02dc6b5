"""Quality by nearest-neighbour voting among labelled documents in a latent semantic space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import slices
from .features import groups, pairs
from .toxicity import labelled_sample

BITS = 15
RANK, NEIGHBOURS, PER_CLASS = 32, 25, 2000


def terms(w, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot): words, word shapes, pairs of neighbouring marks, and whether neighbours are the same word."""
    twice = np.zeros(len(w.row), np.uint64)
    if len(w.row) > 1:
        twice[1:] = (w.core[1:] == w.core[:-1]) & w.follows[1:]
    n = w.old
    got = [(w.row[n:], w.core[n:] ^ np.uint64(0x5851F42D4C957F2D)), (w.row[n:], w.shape[n:]), pairs(w, w.marks + twice, 1, 7)]
    row = np.concatenate([r for r, _ in got])
    return row, (np.concatenate([h for _, h in got]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _counted(col: pa.Array, bits: int):
    """(row, slot, count) of a batch's texts; a text that spans groups is put together."""
    keys, counts = [], []
    for w in groups(col, carry=2):  # a pair's earlier word is compared with the one before it
        row, slot = terms(w, bits)
        k, c = np.unique(row.astype(np.int64) << bits | slot, return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    k, c = np.concatenate(keys), np.concatenate(counts)
    if len(keys) > 1:
        k, inv = np.unique(k, return_inverse=True)
        c = np.bincount(inv, c, len(k)).astype(np.int64)
    return k >> bits, k & ((1 << bits) - 1), c


def document_frequencies(docs: DataFrame, bits: int = BITS, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents that hold each slot's terms, documents): over all rows. The driver gets one number a slot."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total, rows = np.zeros(1 << bits, np.int64), 0
        for b in slices(batches):
            rows += b.num_rows
            total += np.bincount(_counted(b.column(0), bits)[1], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))], schema=schema)

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(1 << bits, np.int64), 0
    for slot, c in got:
        if slot < 0:
            n = c
        else:
            df[slot] = c
    return df, n


class Sparse:
    """Rows of (column, value) arrays; products go by dense blocks of a few rows, so that memory stays small."""

    BLOCK = 128

    def __init__(self, cols: list[np.ndarray], values: list[np.ndarray], width: int):
        self.cols, self.values, self.shape = cols, values, (len(cols), width)

    def blocks(self):
        for s in range(0, len(self.cols), self.BLOCK):
            part = np.zeros((min(self.BLOCK, len(self.cols) - s), self.shape[1]), np.float32)
            for k in range(len(part)):
                part[k, self.cols[s + k]] = self.values[s + k]
            yield s, part

    def times(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], m.shape[1]), np.float32)
        for s, part in self.blocks():
            out[s : s + len(part)] = part @ m
        return out

    def transposed_times(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[1], m.shape[1]), np.float32)
        for s, part in self.blocks():
            out += part.T @ m[s : s + len(part)]
        return out


def randomised_svd(x: Sparse, rank: int, seed: int = 3, rounds: int = 4) -> np.ndarray:
    """Right singular vectors (columns) of a matrix, by a random range finder with power iterations."""
    rank = min(rank, *x.shape)
    y = x.times(np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 10, *x.shape))).astype(np.float32))
    for _ in range(rounds):
        q, _ = np.linalg.qr(y)
        y = x.times(x.transposed_times(q))
    q, _ = np.linalg.qr(y)
    return np.linalg.svd(x.transposed_times(q).T, full_matrices=False)[2][:rank].T


def _weights(slot, count, idf):
    return ((1 + np.log(count)) * idf[slot]).astype(np.float32)


class Space:
    """What the scoring needs: idf by slot, the basis, labelled unit vectors and their labels, and the score of texts
    without known terms; all of bounded size."""

    def __init__(self, idf, used, basis, vectors, labels, blank):
        self.idf, self.used, self.basis, self.vectors, self.labels, self.blank = idf, used, basis, vectors, labels, blank


def fit(docs: DataFrame, labels: DataFrame, allowed, label: str = "quality", per_class: int = PER_CLASS, rank: int = RANK, bits: int = BITS, **cols) -> Space:
    """Document frequencies of the whole corpus; the space and the voters from at most ``per_class`` labelled documents of each class."""
    df, n = document_frequencies(docs, bits, cols.get("text_col", "text"))
    keep = df > 0
    idf = np.where(keep, np.log((1 + n) / (1 + df)), 0.0)
    used = np.cumsum(keep) - 1
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b in slices(batches):
            row, slot, count = _counted(b.column(2), bits)
            row, slot, count = (a[keep[slot]] for a in (row, slot, count))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            cut = lambda a: pa.array([a[s:e].astype(np.int32).tobytes() for s, e in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), cut(slot), cut(count)], schema=schema)

    sample = labelled_sample(docs, labels, label, per_class, allowed, **cols).select("id", "y", "text")
    rows = sample.mapInArrow(run, "id long, y int, slots binary, counts binary").collect()
    rows.sort(key=lambda r: (r.id is None, r.id))
    cols = [used[np.frombuffer(r.slots, np.int32)] for r in rows]
    values = [_weights(np.frombuffer(r.slots, np.int32), np.frombuffer(r.counts, np.int32), idf) for r in rows]
    voters = np.array([r.y for r in rows], np.float32)
    del rows
    # texts without terms don't vote on others; one vote against stands for what isn't there
    bare = np.array([not len(c) for c in cols], bool)
    blank = float(voters[bare].sum() / (bare.sum() + 1))
    cols, values, voters = [c for c in cols if len(c)], [v for v in values if len(v)], voters[~bare]
    values = [v / max(float(np.linalg.norm(v)), 1e-12) for v in values]
    x = Sparse(cols, values, max(1, int(keep.sum())))
    basis = randomised_svd(x, rank) if len(cols) else np.zeros((x.shape[1], 1), np.float32)
    v = x.times(basis)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return Space(idf, np.where(keep, used, -1), basis.astype(np.float32), v.astype(np.float32), voters, blank)


def _votes(col: pa.Array, sp: Space, neighbours: int, bits: int) -> np.ndarray:
    """Scores of a batch's texts."""
    n = len(col)
    prior = float(sp.labels.mean()) if len(sp.labels) else 0.5
    k = min(neighbours, len(sp.labels))
    row, slot, count = _counted(col, bits)
    on = sp.used[slot] >= 0
    row, slot, count = row[on], slot[on], count[on]
    weight = _weights(slot, count, sp.idf)
    vec = np.zeros((n, sp.basis.shape[1]), np.float32)
    cuts = np.searchsorted(row, np.arange(0, n + 1, 64))
    for s, e in zip(cuts, [*cuts[1:], len(row)]):  # blocks of documents, so that gathered rows of the basis stay few
        if e > s:
            part = sp.basis[sp.used[slot[s:e]]] * weight[s:e, None]
            first = np.flatnonzero(np.concatenate([[True], row[s + 1 : e] != row[s : e - 1]]))
            vec[row[s:e][first]] = np.add.reduceat(part, first, axis=0)
    norm = np.linalg.norm(vec, axis=1)
    vec /= np.maximum(norm, 1e-12)[:, None]
    score = np.full(n, prior)
    for s in range(0, n if k else 0, 1024):
        sim = vec[s : s + 1024] @ sp.vectors.T
        near = np.argpartition(sim, -k, axis=1)[:, -k:]
        edge = np.take_along_axis(sim, near, 1).min(1, keepdims=True)
        tied = np.flatnonzero((sim >= edge).sum(1) > k)  # more voters than places at the last similarity
        for t in tied.tolist():
            near[t] = np.lexsort((np.arange(sim.shape[1]), -sim[t]))[:k]
        votes = np.maximum(np.take_along_axis(sim, near, 1), 0).astype(np.float64)
        total = votes.sum(1)
        ok = (total > 0) & (norm[s : s + 1024] > 0)
        score[s : s + 1024][ok] = ((votes * sp.labels[near]).sum(1)[ok] / total[ok]).clip(0, 1)
    known = np.zeros(n, bool)
    known[row] = True
    score[~known] = sp.blank
    return score


def score_quality(docs: DataFrame, space: Space, neighbours: int = NEIGHBOURS, threshold: float = 0.3, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: the similarity-weighted vote of the nearest labelled documents, for every whole text.

    Exact cosines with all labelled vectors, in blocks of documents. Negative similarities don't vote; among equally
    similar ones at the end of the nearest those first in the order of their ids do. A text without known terms (empty,
    null, blank) has no neighbour: its score is the mean label of such labelled texts and of one more with label 0, so 0
    if none is labelled. A text of which no neighbour is similar has the voters' mean label, or 0.5 without any voter.
    Whole texts, however long. Repeated rows agree; an empty table gives an empty one; other columns, whatever their
    names, aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(space)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_votes(b.column(1), sent.value, neighbours, bits))], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, space: Space, neighbours: int = NEIGHBOURS, threshold: float = 0.3, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold``; without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(space)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(_votes(b.column(at), sent.value, neighbours, bits) >= threshold))

    return docs.mapInArrow(run, docs.schema)
