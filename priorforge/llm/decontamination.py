"""Benchmark passages in documents, by latent semantic retrieval and a check of the word order.

Documents become sequences of the benchmark's words (all other words are one symbol) and are cut into overlapping
passages. The corpus' document frequencies give TF-IDF weights, each term scaled by the root of its frequency, so that
its column in the matrix of all passages has its idf as length: words that come together weigh, not words that come
often. A distributed randomised SVD of that matrix gives the latent space. Items, cut into pieces of a passage's half,
are folded in; a passage whose cosine with a piece *in the space* is high enough is a candidate. A piece of which the
corpus' directions hold too little (its words never came together there) adds its own direction to the space. The
longest common subsequence of the item and the candidate's surroundings decides, and, where that is a paraphrase's,
whether the item's last sentence (its answer) is there too.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import slices
from .features import groups
from .scratch import table

#: A passage is two neighbouring blocks of so many words; each block is in two passages.
BLOCK = 48
#: Items are cut into pieces of at most so many words, which always stand whole in some passage.
PIECE = BLOCK
#: Leading directions of the corpus, and those drawn on top of them.
RANK, OVERSAMPLING = 128, 32
#: A piece of which the space holds less than this share (of its squared length) adds its direction.
HELD = 0.3
#: Items, and words of items, handled in one pass over the documents; more take more passes.
ITEMS, ITEM_WORDS = 500, 20_000
#: Cosine of a candidate; share of an item's words in order that marks a copy; the same for a paraphrase, if its weight
#: (by inverse document frequency) and its answer are there.
COSINE, COPY, PARAPHRASE, PARAPHRASE_WEIGHT, ANSWER = 0.3, 0.8, 0.6, 0.7, 0.8
#: Where the usual least finding of a piece (PARAPHRASE of its weight) has a lower cosine in a passage with so many times
#: the mean squared length, that is its threshold.
LOUD = 4.0
#: Share of the least finding's weight that must lie in one passage; what is inserted may push the rest into the next one.
INSIDE = 0.6
CHUNK = 64
#: Rows that are added up one after the other; of more, the sums are added up again.
RUN = 48
#: Cells of the table of a longest common subsequence; longer ones are found by halves.
TABLE = 1 << 22


def _words(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text, those without letters or digits left out."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for w in groups(pa.array(texts, pa.string()), shapes=False):
        ok = w.core != 0
        row, core = w.row[ok], w.core[ok]
        for r in np.unique(row):
            out[r].append(core[row == r])
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


class Items:
    """A block of benchmark items: words by number in a common vocabulary (the sorted hashes)."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [(i, t) for i, t in rows if t]
        words = _words([t for _, t in rows])
        rows = [(i, t, w) for (i, t), w in zip(rows, words) if len(w)]
        self.ids = [i for i, _, _ in rows]
        self.vocab = np.unique(np.concatenate([w for _, _, w in rows])) if rows else np.zeros(0, np.uint64)
        self.words = [np.searchsorted(self.vocab, w) for _, _, w in rows]
        last = [re.split(r"(?<=[.!?:])\s+", t.strip())[-1] for _, t, _ in rows]
        self.answer = [len(w) for w in _words(last)]


def _number(core: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocab, core), len(vocab) - 1)
    return np.where(vocab[at] == core, at, -1)


def _blocks(ids: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of each word's block; documents begin new blocks. ``first``: place of each document's first word."""
    own = (np.arange(len(ids)) - first[doc]) // BLOCK
    count = np.zeros(len(first), np.int64)
    np.maximum.at(count, doc, own + 1)
    return np.cumsum(count)[doc] - count[doc] + own


def encode(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: (doc_id, h, ids) for each document, and (term, n): blocks of a task that hold a term.

    h is the text's hash; ids are int32 numbers of the words (-1: no item's). Term -1 counts the blocks.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(items.vocab)
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("ids", pa.binary()), ("term", pa.int32()), ("n", pa.int64())])

    def run(batches):
        known = vocab.value
        total, n_blocks = np.zeros(len(known), np.int64), 0
        for b in slices(batches):
            seqs: list[list[bytes]] = [[] for _ in range(b.num_rows)]
            for w in groups(b.column(2), shapes=False):
                ok = w.core != 0
                ids = _number(w.core[ok], known).astype(np.int32)
                ends = np.searchsorted(w.row[ok], np.arange(b.num_rows + 1))
                raw = ids.tobytes()
                for r in np.unique(w.row[ok]).tolist():
                    seqs[r].append(raw[4 * ends[r] : 4 * ends[r + 1]])
                if len(ids):
                    # frequencies by blocks; a document that goes on in the next group begins a block there
                    row, doc = np.unique(w.row[ok], return_inverse=True)
                    block = _blocks(ids, doc, ends[row])
                    n_blocks += int(block[-1]) + 1
                    on = ids >= 0
                    total += np.bincount(np.unique(block[on] * len(known) + ids[on]) % len(known), minlength=len(known))
            done = [b"".join(s) for s in seqs]
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.binary()), none, pa.nulls(b.num_rows, pa.int64())], schema=schema)
        at = np.flatnonzero(total)
        k = len(at) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n_blocks))], schema=schema
        )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, h long, ids binary, term int, n long")


def _runs(table: np.ndarray, at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    out = np.zeros((len(begin), table.shape[1]), table.dtype)
    for j in range(int(size.max(initial=0))):
        m = int(np.searchsorted(-size, -j))
        out[:m] += table[at[begin[:m] + j]]
    back = np.empty_like(out)
    back[order] = out
    return back


def _sums(table: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Row k: the sum of the rows ``at[start[k]:start[k + 1]]`` of ``table``, in runs of at most RUN rows, a row of all runs at a time."""
    size = np.diff(start)
    if size.max(initial=0) <= RUN:
        return _runs(table, at, start[:-1], size)
    n = -(-size // RUN)
    ends = np.cumsum(n)
    before = RUN * (np.arange(ends[-1]) - np.repeat(ends - n, n))
    runs = _runs(table, at, np.repeat(start[:-1], n) + before, np.minimum(RUN, np.repeat(size, n) - before))
    return _sums(runs, np.arange(len(runs)), np.append(0, ends))


class Passages:
    """The known words of some documents by block, and the passages: blocks b and b + 1 of one document, for every b."""

    def __init__(self, raw: list[bytes]):
        self.lens = np.array([len(r) // 4 for r in raw])
        self.ids = np.frombuffer(b"".join(raw), np.int32)
        self.first = np.cumsum(self.lens) - self.lens
        count = -(-self.lens // BLOCK)
        begin = np.cumsum(count) - count
        n = int(count.sum())
        self.doc = np.repeat(np.arange(len(raw)), count)
        self.number = np.arange(n) - begin[self.doc]
        self.paired = np.concatenate([self.doc[1:] == self.doc[:-1], np.zeros(min(1, n), bool)])
        on = np.flatnonzero(self.ids >= 0)
        d = np.repeat(np.arange(len(raw)), self.lens)[on]
        self.term = self.ids[on]
        self.block = begin[d] + (on - self.first[d]) // BLOCK
        #: where each block's words begin, and their end
        self.start = np.searchsorted(self.block, np.arange(n + 1))

    def project(self, table: np.ndarray, s: int, e: int) -> np.ndarray:
        """Sums of the rows of ``table`` of the words of blocks s to e."""
        return _sums(table, self.term, self.start[s : e + 1])

    def products(self, table: np.ndarray, step: int = 512):
        """(first passage, sums of ``table`` over the words of that passage and the following ones), some at a time."""
        n = len(self.doc)
        for s in range(0, n, step):
            e = min(s + step, n)
            y = self.project(table, s, min(e + 1, n))
            z = y[: e - s].copy()
            on = np.flatnonzero(self.paired[s:e])
            z[on] += y[on + 1]
            yield s, z


def _some(raw: list[bytes], limit: int = 1 << 20):
    """Ranges of rows of about ``limit`` bytes together."""
    s = held = 0
    for k, r in enumerate(raw):
        held += len(r)
        if held >= limit:
            yield s, k + 1
            s, held = k + 1, 0
    if s < len(raw):
        yield s, len(raw)


def corpus_directions(encoded: DataFrame, scale: np.ndarray, rank: int = RANK, oversampling: int = OVERSAMPLING, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (columns) and squared singular values of the matrix A of all passages: a randomised SVD in one pass.

    A row of A has the counts of a passage's words times ``scale``. Tasks sum their rows' part of A'(A W) for a random W;
    the sums are added up in chunks of terms on the executors. The driver gets a number for each term of the benchmark and
    column, and takes the Nystrom form of A'A from it.
    """
    n, k = len(scale), min(len(scale), rank + oversampling)
    w = np.random.default_rng(seed).standard_normal((n, k)).astype(np.float32)
    sent = encoded.sparkSession.sparkContext.broadcast((scale, w))
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.binary())])

    def run(batches):
        scale, w = sent.value
        w = w * scale[:, None].astype(np.float32)
        total = np.zeros((n, k), np.float64)
        for b in slices(batches):
            raw = b.column(0).to_pylist()
            for s, e in _some(raw):
                p = Passages(raw[s:e])
                before = np.zeros(k, np.float32)
                for r, z in p.products(w):
                    # a block is in its own passage and in the one before it
                    own = z.copy()
                    own[1:] += np.where(p.paired[r : r + len(z) - 1, None], z[:-1], 0)
                    if r and p.paired[r - 1]:
                        own[0] += before
                    before = z[-1]
                    lo, hi = p.start[r], p.start[r + len(z)]
                    order = np.argsort(p.term[lo:hi], kind="stable")
                    t = p.term[lo:hi][order]
                    if len(t):
                        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                        total[t[head]] += _sums(own, p.block[lo:hi][order] - r, np.append(head, len(t)))
        total *= scale[:, None]
        parts = [(c, total[c * CHUNK : (c + 1) * CHUNK]) for c in range(-(-n // CHUNK))]
        parts = [(c, p.tobytes()) for c, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], schema=schema)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(p).reshape(-1, k)
                sums[c] = sums[c] + got if c in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], schema=schema)

    ddl = "chunk int, part binary"
    y = np.zeros((n, k))
    for c, p in encoded.select("ids").mapInArrow(run, ddl).repartition("chunk").mapInArrow(add, ddl).collect():
        y[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(p).reshape(-1, k)
    size = np.linalg.norm(y)
    if not size:
        return np.zeros((n, 0)), np.zeros(0)
    shift = 1e-7 * size
    y = y + shift * w
    core = w.T.astype(float) @ y
    left = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * size * np.eye(k))
    u, s, _ = np.linalg.svd(np.linalg.solve(left, y.T).T, full_matrices=False)
    keep = min(rank, int((s * s > shift).sum()))
    return u[:, :keep], s[:keep] ** 2 - shift


class Space:
    """The latent space with a block of items folded in.

    words: of each piece; item, offset: where it stands; basis: the corpus' directions and those that pieces add;
    latent: unit vectors of the pieces in it; least: the cosine from which a passage is a candidate of the piece;
    weight: of a term in the check; inside, table: the weight that a candidate shares with the piece at least, and the
    weight of each term in it.
    """

    def __init__(self, items: Items, scale: np.ndarray, weight: np.ndarray, df: np.ndarray, blocks: int, directions: np.ndarray, power: np.ndarray, cosine: float = COSINE, update: bool = True):
        """df: blocks that hold a term, of ``blocks``; directions, power: of :func:`corpus_directions`."""
        self.words, self.item, self.offset = [], [], []
        for k, w in enumerate(items.words):
            cuts = np.linspace(0, len(w), -(-len(w) // PIECE) + 1).astype(int)
            for s, e in zip(cuts, cuts[1:]):
                self.words.append(w[s:e])
                self.item.append(k)
                self.offset.append(int(s))
        n, m = len(scale), len(self.words)
        self.scale, self.weight = scale.astype(np.float32), weight
        self.table = np.zeros((m, n), np.float32)
        for k, w in enumerate(self.words):
            np.add.at(self.table[k], w, 1)
        rows = self.table * self.scale
        size = np.maximum(np.linalg.norm(rows, axis=1), 1e-30)
        rows /= size[:, None]
        basis = directions.astype(np.float32)
        z = rows @ basis
        self.held = (z * z).sum(1)
        few = np.flatnonzero(self.held < HELD) if update else np.zeros(0, np.int64)
        energy = float(power.sum()) / max(1, blocks)  # mean squared length of a passage in the space
        if len(few):
            rest = rows[few] - z[few] @ basis.T
            u, s, _ = np.linalg.svd(rest.T, full_matrices=False)
            u = u[:, s > 1e-3 * max(1e-30, float(s.max()))].astype(np.float32)
            basis = np.concatenate([basis, u], 1)
            z = rows @ basis
            energy += 2 * float((u * u).sum(1) @ (scale**2 * df)) / max(1, blocks)  # words apart from each other
        self.basis = basis
        self.latent = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        self.least, self.inside = np.zeros(m, np.float32), np.zeros(m, np.float32)
        for k, w in enumerate(self.words):
            gain = PARAPHRASE * float((self.scale[w] * (basis[w] @ self.latent[k])).sum())
            self.least[k] = min(cosine, gain / math.sqrt(gain * gain + LOUD * energy)) if gain > 0 else cosine
            light = np.sort(weight[w])
            self.inside[k] = INSIDE * min(PARAPHRASE_WEIGHT * light.sum(), light[: int(np.ceil(COPY * len(w)))].sum())
        self.table = np.where(self.table > 0, weight.astype(np.float32), 0)

    def candidates(self, p: Passages):
        """(passages, pieces) whose cosine in the space is a candidate's and that share enough weight."""
        table = self.basis * self.scale[:, None]
        for r, z in p.products(table):
            product = z @ self.latent.T
            x, k = np.nonzero(product >= np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None] * self.least)
            for s in range(0, len(x), 4096):
                a, b = x[s : s + 4096] + r, k[s : s + 4096]
                e = np.where(p.paired[a], a + 2, a + 1)
                lens = p.start[e] - p.start[a]
                ok = lens > 0
                a, b, lens = a[ok], b[ok], lens[ok]
                if not len(a):
                    continue
                ends = np.cumsum(lens)
                at = np.arange(ends[-1]) + np.repeat(p.start[a] - (ends - lens), lens)
                shared = np.add.reduceat(self.table[np.repeat(b, lens), p.term[at]], ends - lens)
                good = shared >= self.inside[b] - 1e-4
                yield a[good], b[good]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common subsequences of ``a`` with every beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.where(b == x, row[:-1] + 1, row[1:]))
    return row


def _places(a: np.ndarray, b: np.ndarray, at: int = 0) -> list[int]:
    """Places in ``a`` of a longest common subsequence; by halves of ``a`` where the table would be large."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n > 1 and n * m > TABLE:
        mid = n // 2
        cut = int((_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]).argmax())
        return _places(a[:mid], b[:cut], at) + _places(a[mid:], b[cut:], at + mid)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        hit = np.where(b == a[i], best[i, :-1] + 1, best[i, 1:])
        best[i + 1, 1:] = np.maximum.accumulate(hit)
    i, j, got = n, m, []
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            got.append(at + i)
    return got[::-1]


def _lcs(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[int, float, list[int]]:
    """A longest common subsequence of item ``a`` and passage ``b``: its length, its words' weight, its places in ``a``."""
    got = _places(a, b)
    return len(got), float(weight[a[got]].sum()) if got else 0.0, got


def item_share(item: np.ndarray, tail: int, seq: np.ndarray, weight: np.ndarray) -> float:
    """The share of an item's words that ``seq`` has in order, if that makes a finding; else 0. ``tail``: words of its answer."""
    seq = seq[seq >= 0]
    here = np.isin(item, seq)
    total = weight[item].sum()
    if here.mean() < PARAPHRASE or (here.mean() < COPY and weight[item[here]].sum() < PARAPHRASE_WEIGHT * total):
        return 0.0
    size, heavy, got = _lcs(item, seq, weight)
    share = size / len(item)
    if share >= COPY:
        return share
    if share >= PARAPHRASE and heavy >= PARAPHRASE_WEIGHT * total and sum(g >= len(item) - tail for g in got) >= ANSWER * tail:
        return share
    return 0.0


def _surroundings(block: int, offset: int, piece: int, item: int, length: int) -> tuple[int, int]:
    """The words of a document of ``length`` that may belong to the item, if a piece of it is in the passage at ``block``.

    Between the item's words half as many others may stand. Neighbouring places of a long item are taken together.
    """
    spare = max(0, piece + piece // 2 - BLOCK)
    lo = block * BLOCK - offset - offset // 2 - spare
    rest = item - offset - piece
    hi = (block + 2) * BLOCK + rest + rest // 2 + spare
    if item > PIECE:
        step = max(BLOCK, item // 4)
        lo, hi = lo // step * step, -(-hi // step) * step
    return max(0, lo), min(length, hi)


def search(encoded: DataFrame, items: Items, space: Space) -> DataFrame:
    """(doc_id, h, found): for every document the items it holds and the share of their words, as an array of structs."""
    sent = encoded.sparkSession.sparkContext.broadcast((space, items.words, items.answer, items.ids))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("found", kind)])

    def run(batches):
        space, words, answer, names = sent.value
        for b in slices(batches):
            raw = b.column(2).to_pylist()
            found: list[dict[int, float]] = [{} for _ in raw]
            for s, e in _some(raw):
                p, seen = Passages(raw[s:e]), set()
                for passage, piece in space.candidates(p):
                    for a, j in zip(passage.tolist(), piece.tolist()):
                        d, k = int(p.doc[a]), space.item[j]
                        lo, hi = _surroundings(int(p.number[a]), space.offset[j], len(space.words[j]), len(words[k]), int(p.lens[d]))
                        if (d, k, lo, hi) in seen or found[s + d].get(k, 0.0) >= 1.0:
                            continue
                        seen.add((d, k, lo, hi))
                        share = item_share(words[k], answer[k], p.ids[p.first[d] + lo : p.first[d] + hi], space.weight)
                        if share:
                            found[s + d][k] = max(share, found[s + d].get(k, 0.0))
            out = [[{"item_id": names[k], "share": v} for k, v in sorted(f.items(), key=lambda x: (names[x[0]] is None, names[x[0]] or 0))] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], schema=schema)

    return encoded.select("doc_id", "h", "ids").mapInArrow(run, "doc_id long, h long, found array<struct<item_id:long,share:double>>")


def _item_blocks(benchmark: DataFrame, item_col: str, item_text: str):
    """Blocks of ITEMS items and ITEM_WORDS words (about; an item isn't split), in the order of the ids; one block at a time is on the driver."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).orderBy(F.col("i").asc_nulls_last(), "t")
    held, size = [], 0
    for r in rows.toLocalIterator():
        n = len((r.t or "").split())
        if held and (len(held) >= ITEMS or size + n > ITEM_WORDS):
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += n
    yield held


def fit(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK) -> tuple[DataFrame, Space]:
    """The encoded documents and the space of a block of items: frequencies and directions of the whole corpus."""
    both = table(encode(docs, items, id_col, text_col), "encoded")
    counts = dict(both.filter("term is not null").groupBy("term").agg(F.sum("n")).collect())
    blocks = counts.pop(-1, 0)
    df = np.zeros(len(items.vocab))
    df[list(counts)] = list(counts.values())
    weight = np.log((1 + blocks) / (1 + df)) + 1e-3
    scale = weight / np.sqrt(1 + df)
    encoded = both.filter("term is null")
    return encoded, Space(items, scale, weight, df, blocks, *corpus_directions(encoded, scale, rank))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), contaminated, found (items and the share of their words in order), for every document.

    An item is found if at least COPY of its words stand in the passage in order, or PARAPHRASE of them with
    PARAPHRASE_WEIGHT of their weight and ANSWER of its last sentence. Case and marks at words' ends don't count. Null and
    empty texts hold nothing; items without words are never found; repeated rows and items are judged alike, each of them
    by itself. Very long texts and items are cut into passages and pieces, none is left out. Of several places of an item
    the greatest share counts; a share at a threshold is a finding. Other columns aren't read, whatever their names. The
    benchmark is a stated query set: it goes through in blocks of ITEMS items, each a pass over the documents.
    """
    kind = "array<struct<item_id:long,share:double>>"
    parts = []
    for rows in _item_blocks(benchmark, item_col, item_text):
        items = Items(rows)
        if items.ids:
            parts.append(search(*_searched(docs, items, id_col, text_col)))
    if len(parts) == 1:
        out = parts[0]
    else:
        # one row for each of docs: what is found goes back to the rows by id and text
        out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"))
        hits = None
        for p in parts:
            some = p.filter(F.size("found") > 0).select(F.col("doc_id").alias("i"), F.col("h").alias("t"), F.explode("found").alias("x"))
            hits = some if hits is None else hits.unionByName(some)
        if hits is None:
            out = out.withColumn("found", F.array().cast(kind))
        else:
            merged = hits.distinct().groupBy("i", "t").agg(F.array_sort(F.collect_list("x")).alias("x"))
            out = out.join(merged, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("t")), "left").select("doc_id", "h", F.coalesce("x", F.array().cast(kind)).alias("found"))
    return out.select("doc_id", "h", (F.size("found") > 0).alias("contaminated"), "found")


def _searched(docs: DataFrame, items: Items, id_col: str, text_col: str) -> tuple[DataFrame, Items, Space]:
    encoded, space = fit(docs, items, id_col, text_col)
    return encoded, items, space
