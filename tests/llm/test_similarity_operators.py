"""SimHash, vectors, classifiers, decontamination, components and the pipeline against brute force, and their edge cases."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from priorforge.llm import decontamination, embedding_dedup, graph, quality, queries, scratch, simhash, toxicity
from priorforge.llm.arrow_text import pieces
from priorforge.llm.features import Words, groups

SF = "/root/testdata/sf0.001"
EDGE = [(1, "one two three"), (2, None), (3, ""), (4, "Same text here now"), (4, "Same text here now"), (5, "same TEXT here\nnow"), (None, "same text here now"), (None, None), (7, "x y " * 30000), (8, " \n\t"), (9, "é 日 😀")]
CLASH = "doc_id long, text string, fp long, v long, node long, label string, least long, id int, sketch string"


def docs(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, 1, 2, 3, "s", 4, 5, "k") for i, t in rows], CLASH)


def forest(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


# ---- components


def test_components(spark):
    random.seed(2)
    for n, edges in ((60, [(k, k + 1) for k in range(59)]), (300, [(0, k) for k in range(1, 300)]), (400, [(random.randrange(400), random.randrange(400)) for _ in range(250)]), (5, [])):
        got = {r.node: r.component for r in graph.components(spark.createDataFrame([*edges, (None, 1)] if edges else [], "a long, b long")).collect()}
        want = forest(n, edges)
        assert got == {k: want[k] for e in edges for k in e if any(set(x) == {k} or (k in x and x[0] != x[1]) for x in edges) and any(k in x and x[0] != x[1] for x in edges)}


# ---- SimHash


def brute_fingerprint(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.LOWER))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark):
    rows = duckdb.connect().sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    top = forest(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    want = {i: (f"{f:016x}", rows[k][0]) for (i, _), f, k in zip(rows, fps, top)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, SF).collect()} == want


def test_simhash_edges(spark):
    rows = simhash.simhash_components(docs(spark)).collect()
    assert len(rows) == len(EDGE)
    of = {(r.doc_id, r.fp): r.component_id for r in rows}
    zero = [r for r in rows if r.fp == 0]
    assert {r.component_id for r in zero} == {2} and len(zero) == 4  # null, empty and blank texts
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert [c for (i, f), c in of.items() if i is None and f != 0] == [4]
    assert simhash.simhash_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bits,turns,depth", [(2, 1, 3), (2, 1, 9), (3, 1, 6), (7, 2, 4), (11, 4, 5)])
def test_trie_join_loses_no_link(spark, bits, turns, depth, monkeypatch):
    rng = np.random.default_rng(bits)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():  # clusters of near fingerprints
        for _ in range(12):
            x = s
            for b in rng.integers(0, 64, rng.integers(1, 14)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    want = forest(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= bits])
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "id long, fp long")
    for full in (1 << 31, 200):  # with the small bound, cells go down more levels before tasks take them
        monkeypatch.setattr(simhash, "FULL_CELL", full)
        got = simhash.trie_links(df, bits, turns, depth).collect()
        assert all((fps[r.a] ^ fps[r.b]).bit_count() <= bits for r in got)
        assert forest(len(fps), [(r.a, r.b) for r in got]) == want


def test_sketch_estimates_resemblance():
    random.seed(4)
    words = [f"w{k}" for k in range(4000)]
    for n in (40, 300, 3000):
        for share in (0.0, 0.02, 0.1):
            a = random.choices(words, k=n)
            b = [random.choice(words) if random.random() < share else w for w in a]
            sets = [{" ".join(x[k : k + 5]) for k in range(n - 4)} for x in (a, b)]
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            sk = [np.frombuffer(simhash.sketch(list(simhash.shingle_hashes(" ".join(x).encode(), 5))), np.uint8)[None] for x in (a, b)]
            assert abs(float(simhash.resemblance(*sk)[0]) - true) < 0.17


# ---- vectors


def brute_vectors(rows, least=0.98):
    ok = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for p, a in enumerate(ok):
        for b in ok[:p]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    pairs.append((a, b))
    top = forest(len(rows), pairs)
    name = {t: min(rows[k][0] for k in range(len(rows)) if top[k] == t) for t in set(top)}
    return sorted((rows[k][0], sum(k in p for p in pairs), name[top[k]]) for k in range(len(rows)))


def test_vectors_edges(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal(16)
    rows = [(k, (base + 0.02 * rng.standard_normal(16)).tolist(), 1) for k in range(30)]
    rows += [(100 + k, rows[0][1], 1) for k in range(5)] + [(120, rows[0][1], 2), (121, [2 * x for x in rows[0][1]], 1), (122, [-x for x in rows[0][1]], 1)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 1), (204, [float("inf")] + [1.0] * 15, 1), (205, [], 1), (206, rows[0][1], None), (207, rows[0][1][:8], 1), (207, rows[0][1][:8], 1)]
    rows += [(300, [0.0, -0.0, 1.0], 5), (301, [0.0, 0.0, 1.0], 5), (302, [1e-30] + [0.0] * 2, 5)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, cid int, n int")
    want = brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_recall(spark):
    """Pairs at the very threshold, where a shared filter is least likely."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(400):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.9801
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = brute_vectors([(i, np.float32(v).astype(float).tolist(), l) for i, v, l in rows])
    assert sum(r.n_links for r in got) >= 0.97 * sum(n for _, n, _ in want)


def test_large_filters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "UNIT", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    rows = [(k, (base + 0.03 * rng.standard_normal(8)).tolist(), 0) for k in range(90)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)


# ---- features, classifiers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1é \n.*日", max_size=30), min_size=1, max_size=6))
def test_word_features(texts):
    import pyarrow as pa

    got = [[] for _ in texts]
    for w in groups(pa.array(texts)):
        for r, c in zip(w.row.tolist(), w.core.tolist()):
            got[r].append(c)
    seen = {}
    for t, cores in zip(texts, got):
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        assert len(words) == len(cores)
        for w, c in zip(words, cores):
            core = w.translate(simhash.LOWER).strip(b".*")
            assert (core == b"") == (c == 0)
            assert seen.setdefault(core, c) == c
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_cut_between_words():
    body = np.frombuffer(b"word " * 1000, np.uint8)
    parts = list(pieces(np.array([0, 2500, 5000]), body, limit=700))
    assert sum(int((b[:, 1] - b[:, 0]).sum()) for _, b in parts) == 5000
    assert sum(len(Words(body, r, b).core) for r, b in parts) == 1000


def test_long_texts_lose_no_pair(monkeypatch):
    """Features of a text that is handled in many groups equal those of the same text in one."""
    import pyarrow as pa
    from priorforge.llm import arrow_text

    random.seed(4)
    texts = [" ".join(random.choice(["aa", "aa", "b!", "Cc,", "d1", "*"]) for _ in range(n)) for n in (1, 400, 2, 3000, 7)] + [None, "", "x " * 50]
    col = pa.array(texts)
    want = [toxicity._row_slots(col, 20), quality._counted(col, 15)]
    real = arrow_text.pieces
    monkeypatch.setattr("priorforge.llm.features.pieces", lambda offs, body: real(offs, body, limit=60))
    got = [toxicity._row_slots(col, 20), quality._counted(col, 15)]
    assert all(np.array_equal(a, b) for a, b in zip(want[0], got[0], strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(want[1], got[1], strict=True))


def test_votes_equal_a_plain_vote():
    """Scores by brute force: dense TF-IDF vectors, all cosines, the nearest in the order of similarity and place."""
    import pyarrow as pa

    random.seed(7)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta,", "Theta."]
    texts = [" ".join(random.choices(words, k=random.randint(1, 12))) for _ in range(60)] + ["", None, " "]
    rng = np.random.default_rng(1)
    bits, n_slots = 8, 256
    idf, basis = rng.random(n_slots), rng.standard_normal((n_slots, 5)).astype(np.float32)
    vectors = rng.standard_normal((40, 5)).astype(np.float32)
    vectors[20:] = vectors[:20]  # every voter has a twin
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 40).astype(np.float32)
    space = quality.Space(idf, np.arange(n_slots), basis, vectors, labels, 0.125)
    got = quality._votes(pa.array(texts), space, 5, bits)
    row, slot, count = quality._counted(pa.array(texts), bits)
    for k, t in enumerate(texts):
        if not (t or "").strip():
            assert got[k] == 0.125
            continue
        x = np.zeros(n_slots)
        x[slot[row == k]] = (1 + np.log(count[row == k])) * idf[slot[row == k]]
        v = (x @ basis) / np.linalg.norm(x @ basis)
        sim = (vectors.astype(float) @ v).round(5)
        near = sorted(range(40), key=lambda i: (-sim[i], i))[:5]
        votes = np.maximum(sim[near], 0)
        assert got[k] == pytest.approx((votes * labels[near]).sum() / votes.sum() if votes.sum() else labels.mean(), abs=1e-3)


def test_ftrl_equals_coordinates_one_by_one():
    rng = np.random.default_rng(3)
    slots = [np.unique(rng.integers(0, 40, 6)) for _ in range(50)]
    y = rng.integers(0, 2, 50).astype(float)
    at, w, bias = toxicity.fit_ftrl(slots, y, bits=6, epochs=3, alpha=0.7, beta=1.0, l1=0.4, l2=0.1, seed=2)
    z, n, b, bn = [0.0] * 64, [0.0] * 64, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= 0.4:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * 0.4) / ((1.0 + n[i] ** 0.5) / 0.7 + 0.1)

    order = np.random.default_rng(2)
    for _ in range(3):
        for k in order.permutation(50):
            p = 1 / (1 + np.exp(-(sum(weight(i) for i in slots[k]) + b)))
            g = p - y[k]
            for i in slots[k]:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.7
                z[i] += g - sigma * weight(i)
                n[i] += g * g
            bn += g * g
            b -= 0.7 * g / (1.0 + bn**0.5)
    want = {i: weight(i) for i in range(64) if weight(i)}
    assert at.tolist() == sorted(want) and np.allclose(w, [want[i] for i in at.tolist()]) and bias == pytest.approx(b)


def test_labelled_samples_are_bounded_by_bytes(spark):
    d = spark.createDataFrame([(k, "x" * 100) for k in range(50)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    size = lambda n: sorted(r["count"] for r in toxicity.labelled_sample(d, lab, "toxic", 20, lambda c: queries.F.lit(True), max_bytes=n).groupBy("y").count().collect())
    assert size(1 << 20) == [20, 20] and size(450) == [5, 5] and size(1) == [1, 1]


def held_out(spark, query, label, fold):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", label)
    got = query(spark, "/root/testdata/sf0.1")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == 10000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == fold(zlib.crc32(str(r.doc_id).encode())) for r in rows)
    return [r for r in rows if r.held_out]


def test_quality_held_out(spark):
    rows = held_out(spark, queries.op1_quality, "quality", lambda c: c % 5 == 0)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) >= 0.95 * len(bad)
    assert sum(r.predicted == 1 for r in rows if r.quality == 1) >= 0.99 * sum(r.quality for r in rows)


def test_toxicity_held_out(spark):
    rows = held_out(spark, queries.op4_toxicity, "toxic", lambda c: c % 3 == 1)
    assert sum(r.predicted == 1 for r in rows if r.toxic == 1) >= 0.8 * sum(r.toxic for r in rows)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.005 * len(rows)


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0), (4, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        for d in (docs(spark), docs(spark, [])):
            space = quality.fit(d, lab, lambda c: queries.F.lit(True))
            got = quality.score_quality(d, space).collect()
            assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
            assert quality.keep_good(d, space).columns == d.columns
            model = toxicity.train(d, lab, lambda c: queries.F.lit(True))
            got = toxicity.score_toxicity(d, model).collect()
            assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(1)
    slots = [np.unique(np.concatenate([rng.integers(100, 5000, 40), [7] if k % 2 else []]).astype(np.int64)) for k in range(400)]
    at, w, b = toxicity.fit_ftrl(slots, np.array([k % 2 for k in range(400)], float), bits=13)
    assert 7 in at and w[list(at).index(7)] == w.max() and len(at) < 400


# ---- decontamination


def brute_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, best[j + 1] = best[j + 1], prev + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_lcs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(0, 30))
        n, weight, at = decontamination._lcs(a, b, np.ones(6))
        assert n == brute_lcs(a.tolist(), b.tolist()) == len(at) and weight == n


def test_decontamination(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: " ".join(random.choice(common) if random.random() < 0.5 else word() for _ in range(n))
    items = [(k, text(30 + k) + ". " + text(6)) for k in range(12)] + [(50, None), (51, ""), (52, "* !"), (0, None)]
    rows, want = [], {}
    for k in range(200):
        body = text(random.randint(0, 400)).split(" ")
        hit = set()
        if k % 4 == 0:
            i = k // 4 % 12
            copy = items[i][1].split(" ")
            if k % 8 == 0:  # a paraphrase: some words replaced, case changed
                copy = [w.upper() if n % 10 else word() for n, w in enumerate(copy)]
            at = random.randint(0, len(body))
            body[at:at] = copy
            hit.add(i)
        rows.append((k, " ".join(body)))
        want[k] = sorted(hit)
    rows += [(1000, None), (1001, ""), (1002, "x " * 100000 + items[3][1] + " y" * 100000), (1002, "z"), (None, items[5][1])]
    want |= {1000: [], 1001: []}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows)
    for size in (2000, 5):  # items in one pass, and in blocks
        decontamination.ITEMS, old = size, decontamination.ITEMS
        got = decontamination.find_contamination(df, benchmark).collect()
        decontamination.ITEMS = old
        assert len(got) == len(rows)
        found = {r.doc_id: sorted(x.item_id for x in r.found) for r in got}
        assert {k: found[k] for k in want} == want
        assert sorted(len(r.found) for r in got if r.doc_id == 1002) == [0, 1] and found[None] == [5]
        assert all(r.contaminated == bool(r.found) for r in got)
    assert decontamination.find_contamination(docs(spark, []), benchmark).count() == 0
    assert {r.contaminated for r in decontamination.find_contamination(df, benchmark.limit(0)).collect()} == {False}


def test_decontamination_query(spark):
    docs_, bench = (duckdb.connect().sql(f"select * from '{SF}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    want = {r[0]: sorted(i for i, t in bench if t in r[1]) for r in docs_}
    assert {r.doc_id: r.item_ids for r in queries.op7_decontamination(spark, SF).collect()} == want


# ---- pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = df.columns, []
    bench = [t for _, t in duckdb.connect().sql(f"select * from '{sf}/benchmark.parquet'").fetchall()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = df
        df = scratch.table(stage(spark, df, sf), "stage")
        kept.append(df.count())
        if k < 4:
            assert df.columns == columns and df.dtypes == before.dtypes
            assert df.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if k == 0:
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            assert df.join(labels, "doc_id").filter("quality = 1").count() == before.join(labels, "doc_id").filter("quality = 1").count()
        if k == 1:
            assert all(r.n_chars == len(r.text) for r in df.collect())
        if k == 2:
            texts = [r.text for r in df.collect()]
            assert len(texts) == len(set(texts))
        if k == 3:
            assert not any(b in r.text for r in df.collect() for b in bench)
            clean = {r.doc_id for r in before.collect() if not any(b in r.text for b in bench)}
            assert clean == {r.doc_id for r in df.collect()}
    assert kept[-1] == kept[-2] > 700
    assert corpus_pipeline.run(spark, sf).count() == kept[-1]


def test_pipeline_edges(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "one two three four five six", "en", None, 27), (3, "one two three four five six", "en", None, 27), (None, "no id here", None, None, None)]
    rows += [(5, "alpha beta gamma delta epsilon zeta", None, None, None), (5, "eta theta iota kappa lambda mu", None, None, None)]
    for name, some in (("some", rows), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        assert sorted(str(r.doc_id) for r in got) == (["3", "5", "5", "None"] if some else [])


def test_sums_of_rows():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((50, 5))
    for sizes in ([0, 3, 200, 1, 0, 5000, decontamination.RUN, decontamination.RUN + 1], [0], [], [0, 0, 7]):
        start = np.append(0, np.cumsum(sizes)).astype(int)
        at = rng.integers(0, len(rows), start[-1])
        plain = np.array([rows[at[s:e]].sum(0) for s, e in zip(start, start[1:])]).reshape(-1, 5)
        assert np.allclose(decontamination._sums(rows, at, start), plain)
