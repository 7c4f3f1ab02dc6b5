"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is the concatenation of one random codeword per block of coordinates; a vector falls into every filter whose
inner product with it exceeds a threshold (a spherical cap). The list of these filters is decoded block by block,
leaving partial sums that the best codewords of the other blocks can't lift over the threshold. Vectors that share a
label and a filter are compared by exact cosine in double precision. A pair counts in the least filter that both share,
so links are counted without writing pairs down.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .scratch import drop, table
from .simhash import Forest

#: Filters that a vector falls into on average, and at least.
MEAN_LIST, LEAST_LIST = 20, 10
#: Codewords of a block at most; more filters take more blocks.
CODEWORDS = 512
#: Vectors of a filter that are compared in one unit; larger filters are compared in pairs of blocks of this size.
UNIT = 384


@lru_cache(maxsize=8)
def codebooks(dim: int, filters: int, seed: int = 11) -> tuple[tuple[np.ndarray, ...], float]:
    """(codewords per block, threshold): at least ``filters`` directions over unit vectors of ``dim`` coordinates.

    The threshold is where random unit vectors fall into MEAN_LIST filters on average, found by simulation.
    """
    blocks = min(dim, max(2 if dim > 1 else 1, math.ceil(math.log2(filters + 1) / math.log2(CODEWORDS))))
    words = max(2, math.ceil(filters ** (1 / blocks)))
    rng = np.random.default_rng(seed + dim)
    books = []
    for part in np.array_split(np.arange(dim), blocks):
        b = rng.standard_normal((words, len(part)))
        books.append(b / np.linalg.norm(b, axis=1, keepdims=True) / math.sqrt(blocks))
    x = rng.standard_normal((2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cut = np.cumsum([0, *[b.shape[1] for b in books]])
    total = 0
    for b, s, e in zip(books, cut, cut[1:]):
        total = total + (x[:, s:e] @ b.T)[:, rng.integers(0, words, 1000)]
    share = min(0.5, MEAN_LIST / words**blocks)
    return tuple(books), float(np.quantile(total, 1 - share))


def decode_list(products: list[np.ndarray], threshold: float) -> np.ndarray:
    """Numbers of all filters whose blocks' products add up to at least ``threshold``, in ascending order."""
    rest = np.cumsum([0.0, *[p.max() for p in products[::-1]]])[::-1][1:]
    sums, codes = np.zeros(1), np.zeros(1, np.int64)
    for p, r in zip(products, rest):
        j = np.flatnonzero(p + sums.max() + r >= threshold)
        grid = sums[:, None] + p[j][None, :]
        a, b = np.nonzero(grid + r >= threshold)
        sums, codes = grid[a, b], codes[a] * len(p) + j[b]
        if not len(sums):
            break
    return np.sort(codes)


def filters_of(v: np.ndarray, filters: int) -> list[np.ndarray]:
    """The list of each row (unit vectors); where it is shorter than LEAST_LIST, the threshold sinks until it isn't."""
    books, threshold = codebooks(v.shape[1], filters)
    cut = np.cumsum([0, *[b.shape[1] for b in books]])
    every = [v[:, s:e] @ b.T for b, s, e in zip(books, cut, cut[1:])]
    size = len(books[0]) ** len(books)
    out = []
    for i in range(len(v)):
        row, t = [p[i] for p in every], threshold
        got = decode_list(row, t)
        while len(got) < min(LEAST_LIST, size):
            t -= 0.02
            got = decode_list(row, t)
        out.append(got)
    return out


def _owned(lists: np.ndarray, f: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether no filter below ``f`` is in both rows' lists (padded with the greatest number)."""
    below = np.where(lists < f, lists, -1)
    width = int((below >= 0).sum(1).max(initial=0))
    if not width:
        return np.ones(len(i), bool)
    below = below[:, :width]  # lists ascend
    ok = np.ones(len(i), bool)
    step = max(1, (1 << 21) // width**2)
    for s in range(0, len(i), step):
        a, b = below[i[s : s + step]], below[j[s : s + step]]
        ok[s : s + step] = ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2))
    return ok


def _lists(col) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.values.to_numpy(), col.offsets.to_numpy()


def _units(t: pa.Table, least: float):
    """(class, other or null, links) rows of whole units, sorted by (label, f, bi, bj): link counts per class in each
    unit, and a spanning forest of the unit's links."""
    label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    f, bi, bj, ids, block, n = (t.column(c).to_numpy() for c in ("f", "bi", "bj", "cid", "block", "n"))
    values, vo = _lists(t.column("v"))
    filters, fo = _lists(t.column("filters"))
    new = np.concatenate([[True], (label[1:] != label[:-1]) | (f[1:] != f[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
    starts = np.flatnonzero(new)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
        if e - s < 2:
            continue
        v = values[vo[s] : vo[e]].reshape(e - s, -1)
        v = v / np.sqrt((v * v).sum(1))[:, None]
        if bi[s] == bj[s]:
            left = right = np.arange(e - s)
        else:
            left, right = np.flatnonzero(block[s:e] == bi[s]), np.flatnonzero(block[s:e] == bj[s])
        cosine = v[left] @ v[right].T
        hit = cosine >= least
        if left is right:
            hit &= np.arange(e - s)[:, None] < np.arange(e - s)[None, :]
        if not hit.any():
            continue
        i, j = np.nonzero(hit)
        i, j = left[i], right[j]
        tree = Forest(e - s).join(i, j)
        lists = [filters[fo[k] : fo[k + 1]] for k in range(s, e)]
        pad = np.full((e - s, max(map(len, lists))), np.iinfo(np.int64).max)
        for k, x in enumerate(lists):
            pad[k, : len(x)] = x
        own = _owned(pad, int(f[s]), i, j)
        i, j, here, size = i[own], j[own], ids[s:e], n[s:e]
        links = (np.bincount(i, size[j], e - s) + np.bincount(j, size[i], e - s)).astype(np.int64)
        has = np.flatnonzero(links)
        out.append((here[has], np.full(len(has), -1), links[has]))
        if tree:
            a, b = np.array(tree).T
            out.append((here[a], here[b], np.zeros(len(a), np.int64)))
    if not out:
        return None
    a, b, links = (np.concatenate([o[k] for o in out]) for k in range(3))
    none = np.concatenate([np.full(len(o[0]), not o[2].size or o[2][0] > 0) for o in out])
    return pa.array(a), pa.array(b, mask=none), pa.array(links)


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: links by cosine of at least ``least`` between rows of one label.

    Rows with the same label and vector are one class, so copies aren't compared with each other; they still count as
    links. Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link
    with nothing: n_links 0, a component of their own. Vectors of different length don't link. n_links counts other
    rows; component_id is the least vec_id that links reach. Repeated rows count as rows of their own. Empty table: empty.
    Every link returned is verified; those whose vectors share no filter are missed (the tests measure recall).
    """
    e, label = F.col(vec_col), F.col(label_col).cast("string") if label_col else F.lit("")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    wide = F.transform(e, lambda x: x.cast("double") + F.lit(0.0))  # no negative zero
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(fine & label.isNotNull(), wide).alias("v"), F.concat_ws("/", label, F.size(e).cast("string")).alias("label"))
    rows = rows.withColumn("cid", F.xxhash64("label", "v"))
    good = rows.filter("v is not null")
    classes = table(good.groupBy("cid", "label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    filters = max(64, MEAN_LIST * most)
    schema = pa.schema([("cid", pa.int64()), ("filters", pa.list_(pa.int64()))])

    def code(batches):
        for b in batches:
            v = b.column(1).to_pylist()
            out: list = [None] * len(v)
            for dim in {len(x) for x in v}:
                at = [k for k, x in enumerate(v) if len(x) == dim]
                x = np.array([v[k] for k in at])
                x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow of the squares
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for k, f in zip(at, filters_of(x, filters)):
                    out[k] = f
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], schema=schema)

    # few, heavy rows: deal them evenly
    coded = table(classes.select("cid", "v").repartition(F.col("cid")).mapInArrow(code, "cid long, filters array<long>"), "coded")
    entries = coded.join(classes.select("cid", "label"), "cid").select("label", "cid", F.explode("filters").alias("f"))
    entries = table(entries, "entries")
    shared = entries.groupBy("label", "f").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / UNIT)
    met = entries.join(shared, ["label", "f"]).withColumn("blocks", blocks.cast("long"))
    met = met.withColumn("block", F.pmod(F.xxhash64("cid", "f"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("label", "f", "cid", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    units = met.join(classes.select("cid", "v", "n"), "cid").join(coded, "cid")
    result = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    key = ["label", "f", "bi", "bj"]

    def compare(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            # the last unit may go on in the next batch
            last = [t.column(c)[t.num_rows - 1].as_py() for c in key]
            cut = t.num_rows
            cols = [t.column(c) for c in key]
            while cut and all(c[cut - 1].as_py() == x for c, x in zip(cols, last)):
                cut -= 1
            rest = t.slice(cut)
            if cut and (got := _units(t.slice(0, cut), least)) is not None:
                yield pa.RecordBatch.from_arrays(list(got), schema=result)
        if rest is not None and (got := _units(rest, least)) is not None:
            yield pa.RecordBatch.from_arrays(list(got), schema=result)

    units = units.select(*key, "cid", "block", "n", "v", "filters").repartition(*key).sortWithinPartitions(*key)
    found = table(units.mapInArrow(compare, "a long, b long, links long"), "found")
    drop(entries)
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.filter("b is not null").select("a", "b"))
    named = classes.select("cid", "n", "least").join(counts, F.col("cid") == F.col("a"), "left").join(joined, F.col("cid") == F.col("node"), "left")
    named = named.withColumn("c", F.coalesce("component", "cid")).select("cid", "c", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    of = named.join(names, "c").select("cid", "n_links", "component_id")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("cid")).alias("cid")).join(of, "cid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
