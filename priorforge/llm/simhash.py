"""SimHash near-duplicates: fingerprints, then a binary-trie self-join that prunes by its Hamming budget.

The join walks pairs of trie nodes down together, adds up the bits in which they differ, and leaves a pair once the
budget is spent. The upper levels are the deal: a fingerprint goes to its own prefix and, with what is left of its
budget, to every prefix that differs in few enough bits. Cells that are too full go down more levels before they are
dealt to tasks. Tasks walk the rest of the trie and return a spanning forest of the links they find, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .arrow_text import batch, column_bytes
from .graph import components
from .scratch import drop, table

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bins of the sketch that estimates resemblance, four bits each; 0 marks an empty bin.
BINS = 128
#: Shingles hashed and counted at a time.
BLOCK = 1 << 16
#: A cell with more pairs than this goes down STEP more bits before tasks walk it (they compare few of the pairs).
FULL_CELL, STEP = 1 << 38, 6
ZERO_NIBBLES = np.array([(v >> 4 == 0) + (v & 15 == 0) for v in range(256)], np.uint8)


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``size`` words, A-Z lower-cased, joined by a blank; of all words if they are fewer."""
    words = text.translate(LOWER).split()  # bytes.split() cuts at 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return
    joined = b" ".join(words)
    if n <= size:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), BLOCK):
        s, e = starts[k : k + BLOCK], ends[k : k + BLOCK]
        yield np.fromiter([digest(joined[i:j], 42) for i, j in zip(s, e)], np.uint64, len(s))


def fingerprint(blocks: list[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes: 0."""
    n = sum(map(len, blocks))
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for h in blocks:
        ones += np.unpackbits(h.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def sketch(blocks: list[np.ndarray]) -> bytes:
    """One-permutation MinHash: per bin (7 bits of the hash) the least hash, of which 4 bits (1 to 15) are kept."""
    low = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    for h in blocks:
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
        np.minimum.at(low, (mixed >> np.uint64(57)).astype(np.int64), mixed & np.uint64((1 << 57) - 1))
    digit = np.where(low == np.iinfo(np.uint64).max, 0, 1 + low % np.uint64(15)).astype(np.uint8)
    return (digit[0::2] << 4 | digit[1::2]).tobytes()


def resemblance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches (uint8, BINS / 2 wide); two empty ones: 1."""
    empty = ZERO_NIBBLES[a | b].sum(1, dtype=np.int64)
    used = BINS - empty
    same = ZERO_NIBBLES[a ^ b].sum(1, dtype=np.int64) - empty
    return np.where(used > 0, (same / np.maximum(used, 1) - 1 / 15) / (14 / 15), 1.0)


def fingerprints(docs: DataFrame, shingle: int = 3, with_sketch: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long[, sketch binary, h long]) of whole texts. Null and empty texts: 0. The long holds the 64 bits,
    signed; h is the text's hash."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("fp", pa.int64())] + [pa.field("sketch", pa.binary()), pa.field("h", pa.int64())] * with_sketch
    schema = pa.schema(fields)

    def run(batches):
        for b in batches:
            body, offs = column_bytes(b.column(1))
            raw = body.tobytes()
            fps, sks = np.zeros(b.num_rows, np.uint64), []
            for i in range(b.num_rows):
                blocks = list(shingle_hashes(raw[offs[i] : offs[i + 1]], shingle))
                fps[i] = fingerprint(blocks)
                if with_sketch:
                    sks.append(sketch(blocks))
            yield batch(schema, b.column(0), fps.view(np.int64), *([sks, b.column(2)] if with_sketch else []))

    ddl = "doc_id long, fp long" + ", sketch binary, h long" * with_sketch
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")] + [F.xxhash64(text_col).alias("h")] * with_sketch
    return docs.select(*cols).mapInArrow(run, ddl)


def _masks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(mask, set bits) of all masks over ``bits`` bits with at most ``budget`` set."""
    return [(sum(1 << i for i in c), k) for k in range(budget + 1) for c in combinations(range(bits), k)]


def _descend(rows: DataFrame, depth: int, bits: int, budget: int) -> DataFrame:
    """Walk all node pairs down ``bits`` levels.

    rows: (turn, node, left, home, v, ...): v's bits below ``depth`` decide; ``left`` is what remains of the budget for
    the first segment. A row at home goes to its own child and visits others; of two children the one whose masked
    bits have even parity in the differing place is visited, so each pair of nodes meets once. Visitors stay visitors.
    """
    own = F.shiftrightunsigned("v", 64 - depth - bits).bitwiseAND(F.lit((1 << bits) - 1))
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in _masks(bits, budget)])
    moved = rows.withColumn("own", own).withColumn("step", F.explode(F.filter(masks, lambda x: x["k"] <= F.col("left"))))
    child = F.col("own").bitwiseXOR(F.col("step.m"))
    # one direction for each pair {own, child}: by a hash of the pair, the smaller visits the larger or the other way round
    lot = F.pmod(F.hash(F.least("own", child), F.greatest("own", child), "node"), F.lit(2)) == 0
    goes = (F.col("step.m") == 0) | ~F.col("home") | F.when(lot, F.col("own") < child).otherwise(F.col("own") > child)
    return moved.filter(goes).select(
        "turn",
        F.shiftleft("node", bits).bitwiseOR(child).alias("node"),
        (F.col("left") - F.col("step.k")).alias("left"),
        (F.col("home") & (F.col("step.m") == 0)).alias("home"),
        *[c for c in rows.columns if c not in ("turn", "node", "left", "home")],
    )


class Forest:
    """Union-find over the rows of a cell, in NumPy."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(s, r):
                self.up[x] = r
                return r
            r = s

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Take links; return those that joined two trees."""
        ra, rb = self.roots(a), self.roots(b)
        new = []
        for i, j, x, y in zip(a[ra != rb].tolist(), b[ra != rb].tolist(), ra[ra != rb].tolist(), rb[ra != rb].tolist()):
            while self.up[x] != x:
                x = self.up[x]
            while self.up[y] != y:
                y = self.up[y]
            if x != y:
                self.up[max(x, y)] = min(x, y)
                new.append((i, j))
        return new


def _walk(v: np.ndarray, home: np.ndarray, left: np.ndarray, sketches: np.ndarray | None, depth: int, first: int, budget: int, total: int, least: float, small: int = 1 << 14) -> list[tuple[int, int]]:
    """Links among the rows of one cell: rows at home with each other and with the visitors.

    The tries (rows at home; visitors by what is left of their budget) are sorted arrays; a node is a range. Node pairs
    go down together from bit ``depth``, with the bits already spent above; while inside the first segment (``first`` bits) the differing bits must stay within ``budget``, all
    together within ``total``. Small pairs are compared at once.
    """
    groups = [np.flatnonzero(home), *[np.flatnonzero(~home & (left == k)) for k in range(budget + 1)]]
    below = v & np.uint64((1 << (64 - depth)) - 1)  # visitors come from other prefixes
    rows = [g[np.argsort(below[g], kind="stable")] for g in groups]
    sides, whole = [below[g] for g in rows], [v[g] for g in rows]
    forest, links = Forest(len(v)), []
    segment = np.uint64(((1 << first) - 1) << (64 - first)) if first else np.uint64(0)

    def compare(a0, a1, k, b0, b1):
        x, y = whole[0][a0:a1], whole[k][b0:b1]
        step = max(1, (1 << 20) // max(1, len(y)))
        for s in range(0, len(x), step):
            diff = x[s : s + step, None] ^ y[None, :]
            ok = np.bitwise_count(diff) <= total
            if first:
                ok &= np.bitwise_count(diff & segment) <= budget
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            i, j = rows[0][a0 + s + i], rows[k][b0 + j]
            if k == 0 and a0 == b0:
                up = i < j
                i, j = i[up], j[up]
            apart = forest.roots(i) != forest.roots(j)
            i, j = i[apart], j[apart]
            if sketches is not None and len(i):
                like = np.concatenate([resemblance(sketches[i[p : p + 4096]], sketches[j[p : p + 4096]]) for p in range(0, len(i), 4096)]) >= least
                i, j = i[like], j[like]
            links.extend(forest.join(i, j))

    def cut(side, s, e, bit):
        """Where the range's values with this bit set begin."""
        low = (int(side[s]) >> (bit + 1) << (bit + 1)) | 1 << bit
        return s + int(np.searchsorted(side[s:e], np.uint64(low)))

    n = len(rows[0])
    stack = [(0, n, k, 0, len(g), depth, budget - k + 1 if k else 0) for k, g in enumerate(rows) if n and len(g)]
    while stack:
        a0, a1, k, b0, b1, at, used = stack.pop()
        if (a1 - a0) * (b1 - b0) <= small or at >= 64:
            compare(a0, a1, k, b0, b1)
            continue
        bit = 63 - at
        am, bm = cut(sides[0], a0, a1, bit), cut(sides[k], b0, b1, bit)
        same = k == 0 and a0 == b0 and a1 == b1
        limit = min(total, budget) if at < first else total
        for p, (i0, i1) in enumerate(((a0, am), (am, a1))):
            for q, (j0, j1) in enumerate(((b0, bm), (bm, b1))):
                if i0 < i1 and j0 < j1 and used + (p != q) <= limit and not (same and p > q):
                    stack.append((i0, i1, k, j0, j1, at + 1, used + (p != q)))
    return links


def trie_links(fps: DataFrame, max_bits: int, turns: int = 1, bits: int | None = None, min_resemblance: float = 0.0) -> DataFrame:
    """Links (a, b) that span what the pairs of distinct ids with at most ``max_bits`` differing bits connect.

    fps: (id long, fp long[, sketch binary]) with distinct ids; with a sketch, a pair also needs an estimated
    resemblance of ``min_resemblance``. ``turns`` > 1 splits the 64 bits into that many segments and walks a trie for
    each, rotated so that the segment comes first: of max_bits differing bits some segment holds at most
    max_bits // turns, so the trie prunes by that smaller budget at first and no pair within max_bits is lost.
    ``bits`` is the depth of the first deal; it follows the logarithm of the count if not given.
    """
    spark, has = fps.sparkSession, "sketch" in fps.columns
    first = 64 // turns if turns > 1 else 0
    budget = max_bits // turns
    if bits is None:
        n = fps.count()
        depth = math.ceil(math.log2(n + 1))
        bits = max(5, min(10, depth - 16)) if turns > 1 else max(9, min(14, depth - 12))
    extra = ["sketch"] if has else []
    turn = lambda r: fps.select(
        F.lit(r).alias("turn"),
        F.lit(0).cast("long").alias("node"),
        F.lit(budget).alias("left"),
        F.lit(True).alias("home"),
        (F.shiftleft("fp", r * first).bitwiseOR(F.shiftrightunsigned("fp", 64 - r * first)) if r else F.col("fp")).alias("v"),
        "id",
        *extra,
    )
    rows = turn(0)
    for r in range(1, turns):
        rows = rows.unionByName(turn(r))
    dealt = _descend(rows, 0, bits, budget)
    cells, depth, made = [], bits, []
    while True:
        sizes = dealt.groupBy("turn", "node").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("r")).filter(F.col("n") * F.col("r") > FULL_CELL)
        if depth + STEP > (first or 64) or not (full := table(sizes.select("turn", "node"), "full")).take(1):
            cells.append((dealt, depth))
            break
        made.append(full)
        cells.append((dealt.join(full, ["turn", "node"], "left_anti"), depth))
        dealt = _descend(dealt.join(full, ["turn", "node"], "left_semi"), depth, STEP, budget)
        depth += STEP
    out = None
    for part, depth in cells:
        links = _cell_links(part, depth, first, budget, max_bits, min_resemblance, has)
        out = links if out is None else out.unionByName(links)
    result = table(out.distinct(), "links")
    for x in made:
        drop(x)
    return result


def _cell_links(rows: DataFrame, depth: int, first: int, budget: int, total: int, least: float, has: bool) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def done():
            t = pa.Table.from_batches(held)
            home = t.column("home").to_numpy()
            ids = t.column("id").to_numpy()
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1) if has else None
            if home.any():
                found = _walk(t.column("v").to_numpy().view(np.uint64), home, t.column("left").to_numpy(), sk, depth, first, budget, total, least)
                if found:
                    i = np.array(found)
                    return batch(schema, ids[i[:, 0]], ids[i[:, 1]])
            return None

        for b in batches:
            if not b.num_rows:
                continue
            turn, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((turn[1:] != turn[:-1]) | (node[1:] != node[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if key is not None and key != (turn[s], node[s]):
                    if (x := done()) is not None:
                        yield x
                    held = []
                key = (turn[s], node[s])
                held.append(b.slice(s, e - s))
        if held and (x := done()) is not None:
            yield x

    keep = ["turn", "node", "home", "left", "v", "id"] + ["sketch"] * has
    return rows.select(*keep).repartition("turn", "node").sortWithinPartitions("turn", "node").mapInArrow(run, "a long, b long")


def simhash_components(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, turns: int = 1, min_resemblance: float | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fp (long), component_id, kept, n_same[, h: hash of the text]: near-duplicate groups by fingerprints of whole texts.

    Documents link if their fingerprints differ in at most ``max_bits`` bits and, with ``min_resemblance``, their
    sketches also estimate that Jaccard similarity of the shingle sets. Equal fingerprints (and equal sketches) are one
    node, so copies aren't expanded. component_id is the least doc_id that links reach, kept is doc_id = component_id.
    Null and empty texts have fingerprint 0 and link like any other. Rows with a null doc_id link too; they are never
    a component's name unless it has nothing else (then null). Repeated rows get the same result. No rows: empty.
    """
    has = min_resemblance is not None
    known = table(fingerprints(docs, shingle, has, id_col, text_col), "fingerprints")
    by = ["fp"] + ["sketch"] * has
    kinds = known.groupBy(*by).agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same"))
    kinds = table(kinds.withColumn("id", F.xxhash64("fp", "sketch") if has else F.col("fp")), "kinds")
    links = trie_links(kinds.select("id", *by), max_bits, turns, min_resemblance=min_resemblance or 0.0)
    joined = components(links)
    named = kinds.join(joined, kinds["id"] == joined["node"], "left").select("id", "least", "n_same", *by, F.coalesce("component", "id").alias("c"))
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    of = named.join(names, "c").select(*by, "component_id", "n_same")
    return known.join(of, by).select("doc_id", "fp", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "n_same", *["h"] * has)
