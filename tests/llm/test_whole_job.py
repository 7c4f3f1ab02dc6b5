"""Work that must not be cut short: every near-duplicate pair, every verbatim copy, every row."""

import random

import duckdb
import numpy as np

import corpus_pipeline
from priorforge.llm import decontamination, resemblance


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else frozenset()


def groups_of(rows, least=0.8):
    """Row numbers by component, by brute force, and the pairs at ``least`` with their similarity."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    bands = {}
    for b in range(len(rows)):
        for a in range(b):
            if min(len(sets[a]), len(sets[b])) < least * max(len(sets[a]), len(sets[b])):
                continue
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
            if j >= least:
                bands[a, b] = j
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(rows))], bands


def test_near_duplicates_are_exact(spark):
    """Random texts with 0 to 12 % of the words changed: many pairs close to 0.8 on either side."""
    random.seed(3)
    words = [f"w{k}" for k in range(3000)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A b")]
    for g in range(60):
        base = random.choices(words, k=random.randint(8, 400))
        for _ in range(4):
            share = random.random() * 0.12
            rows.append((len(rows), " ".join(random.choice(words) if random.random() < share else w for w in base)))
    top, _ = groups_of(rows)
    got = resemblance.resemblance_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: top[k] for k in range(len(rows))}


def test_pipeline_near_duplicates_on_documents(spark):
    """The pairs at 0.8 and more of sf0.01's documents are together, and nobody else."""
    rows = duckdb.connect().sql("select min(doc_id) as i, text from '/root/testdata/sf0.01/documents.parquet' where text is not null group by text order by i").fetchall()
    top, bands = groups_of(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()}
    assert bands and kept == {rows[k][0] for k in range(len(rows)) if top[k] == k}


def test_long_items_and_items_of_frequent_words_are_found(spark):
    random.seed(8)
    words = [f"w{k}" for k in range(20000)]
    frequent = [f"f{k}" for k in range(40)]
    items = [(k, " ".join(random.sample(words, (600, 1500, 3000)[k % 3])) + ".") for k in range(8)]
    # two words of these are rare at most, the others stand in most documents
    items += [(10 + k, " ".join(random.sample(frequent, 28) + random.sample(words, k)) + ".") for k in range(3)]
    rows, want = [], {}
    for k in range(150):
        body = random.choices(words, k=300) + random.choices(frequent, k=300)
        random.shuffle(body)
        want[k] = []
        if k % 5 == 0:
            i, text = items[k // 5 % len(items)]
            at = random.randint(0, len(body))
            body[at:at] = text.split()
            want[k] = [i]
        rows.append((k, " ".join(body)))
    got = decontamination.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: sorted(x.item_id for x in r.found) for r in got} == want


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(0, 700)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(0, 900)).astype(np.uint64)]))
        assert resemblance.least_difference(resemblance.parities(a), resemblance.parities(b)) <= len(np.setxor1d(a, b))


def test_a_hot_shingle_and_large_groups(spark):
    """A third of the texts are alike, and one passage stands in all of them; nothing is lost and nothing added."""
    random.seed(11)
    words, same = [f"w{k}" for k in range(500)], [f"h{k}" for k in range(60)]
    base = random.choices(words, k=200)
    rows = [(k, " ".join(same + [random.choice(words) if random.random() < 0.01 else w for w in base])) for k in range(200)]
    rows += [(1000 + k, " ".join(same + random.choices(words, k=random.randint(5, 60)))) for k in range(200)]
    top, _ = groups_of(rows)
    got = resemblance.resemblance_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: rows[top[k]][0] for k, (i, _) in enumerate(rows)}


def test_every_link_meets_and_unlike_texts_make_no_pair(spark):
    """Texts that share a long passage and are not alike make no pair; every link is met, with rows in several files."""
    random.seed(22)
    words, passage = [f"w{k}" for k in range(5000)], [f"p{k}" for k in range(30)]
    rows = [(k, " ".join(passage + random.choices(words, k=90))) for k in range(120)]
    for g in range(60):
        base = random.choices(words, k=150)
        rows += [(len(rows) + k, " ".join(random.choice(words) if random.random() < 0.01 else w for w in base)) for k in range(3)]
    texts = spark.createDataFrame([(i, i, t) for i, t in rows], "doc_id long, h long, text string")
    known = resemblance.table(resemblance._prefixes(texts, 5, 0.8), "known")
    node = {r.doc_id: r.node for r in known.collect()}
    kinds = resemblance.table(known.dropDuplicates(["node"]), "kinds")
    shared = resemblance.table(resemblance._shared(kinds).repartition(5), "shared")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.a, r.b) for r in resemblance._candidates(shared, None, kinds, 0.8, False).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    links = {tuple(sorted((node[a], node[b]))) for a, b in groups_of(rows)[1] if node[a] != node[b]}
    alone = {node[k] for k in range(120)}
    assert len(links) > 100 and links <= got and not any(a in alone or b in alone for a, b in got)


def test_differences_of_many_pairs():
    rng = np.random.default_rng(6)
    bits = [resemblance.parities(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(0, 700, 60)]
    i, j = (rng.integers(0, 60, 500) for _ in range(2))
    assert resemblance.least_differences(bits, i, j).tolist() == [resemblance.least_difference(bits[x], bits[y]) for x, y in zip(i, j)]


def planted(sf, seed, n):
    """Documents with ``n`` copies of items in which up to 40 % of the words are replaced and others are put between them."""
    random.seed(seed)
    con = duckdb.connect()
    bench = con.sql(f"select item_id, text from '{sf}/benchmark.parquet' order by 1").fetchall()
    rows = con.sql(f"select doc_id, text from '{sf}/documents.parquet' where text is not null order by 1").fetchall()
    pool = [w for _, t in rows[:100] for w in t.split()]
    for _ in range(n):
        i, (_, item) = random.randrange(len(rows)), random.choice(bench)
        body, keep, more = rows[i][1].split(), random.uniform(0.55, 1), random.choice([0, 0, 0.1, 0.3])
        copy = [x for w in item.split() for x in ([w if random.random() < keep else random.choice(pool)] + [random.choice(pool)] * (random.random() < more))]
        at = random.randint(0, len(body))
        body[at:at] = copy
        rows[i] = (rows[i][0], " ".join(body))
    return rows, bench


def test_retrieval_recall_against_every_passage(spark):
    """Every document and item that a longest common subsequence with any passage would find, by the corpus' space alone too."""
    rows, bench = planted("/root/testdata/sf0.001", 5, 160)
    items = decontamination.Items(bench)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoded, space = decontamination.fit(docs, items)
    raw = [(r.doc_id, bytes(r.ids)) for r in encoded.select("doc_id", "ids").collect()]
    p = decontamination.Passages([x for _, x in raw])
    want = set()
    for a in range(len(p.doc)):
        d = int(p.doc[a])
        for k, w in enumerate(items.words):
            spare = max(0, len(w) + len(w) // 2 - decontamination.BLOCK)
            lo, hi = max(0, int(p.number[a]) * decontamination.BLOCK - spare), (int(p.number[a]) + 2) * decontamination.BLOCK + spare
            if decontamination.item_share(w, items.answer[k], p.ids[p.first[d] : p.first[d] + p.lens[d]][lo:hi], space.weight):
                want.add((raw[d][0], items.ids[k]))
    assert len(want) > 60
    directions = space.basis[:, : min(space.basis.shape[1], decontamination.RANK)]
    blocks = len(p.doc)
    df = np.exp(-(space.weight - 1e-3)) * (1 + blocks) - 1
    make = lambda v: decontamination.Space(items, space.scale, space.weight, df, blocks, v, np.zeros(v.shape[1]), update=False)
    for s, least in ((space, 0.97), (make(directions), 0.9)):
        got = {(r.doc_id, x.item_id) for r in decontamination.search(encoded, items, s).collect() for x in r.found}
        assert len(got & want) >= least * len(want) and not got - want
    # without the corpus' directions there is no space, and nothing is retrieved; with other ones the candidates change
    assert not any(r.found for r in decontamination.search(encoded, items, make(directions[:, :0])).collect())
    turned = np.linalg.qr(np.random.default_rng(1).standard_normal(directions.shape))[0]
    pairs = [{(int(a), int(b)) for x, y in s.candidates(p) for a, b in zip(x, y)} for s in (make(directions), make(turned))]
    assert pairs[0] != pairs[1]


def test_other_words_are_retrieved_through_the_space(spark):
    """Words of one subject stand together in the corpus: a passage without any word of the item has a high cosine with it."""
    random.seed(1)
    subjects = [[f"s{k}w{j}" for j in range(20)] for k in range(12)]
    rows = [(i, " ".join(random.choices(subjects[i % 12], k=96))) for i in range(600)]
    items = decontamination.Items([(2 * k + h, " ".join(s[10 * h : 10 * h + 10])) for k, s in enumerate(subjects) for h in (0, 1)])
    _, space = decontamination.fit(spark.createDataFrame(rows, "doc_id long, text string"), items, rank=12)
    n = len(items.ids)
    rest = decontamination.Passages([items.words[j].astype(np.int32).tobytes() for j in range(n)])
    z = np.concatenate([z for _, z in rest.products(space.basis * space.scale[:, None])])
    cosine = z @ space.latent.T / np.linalg.norm(z, axis=1)[:, None]
    for j in range(n):
        assert not set(items.words[j].tolist()) & set(items.words[j ^ 1].tolist())
        assert cosine[j, j ^ 1] >= 0.8 and all(cosine[j, i] < decontamination.COSINE for i in range(n) if i not in (j, j ^ 1))


def test_subsequences_by_halves(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(1, 40)), rng.integers(0, 5, rng.integers(0, 60))
        whole = decontamination._places(a, b)
        monkeypatch.setattr(decontamination, "TABLE", 4)
        parts = decontamination._places(a, b)
        monkeypatch.undo()
        assert len(whole) == len(parts) == decontamination._lengths(a, b)[-1] and parts == sorted(set(parts))
        at = 0
        for x in a[parts]:  # it is a subsequence of b
            at = b.tolist().index(x, at) + 1


def test_repeated_rows_stay_with_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 2)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(5)]
    rows = [(1, items[4][1]), (1, items[4][1]), (None, "a b"), (None, "a b"), (2, None)]
    got = decontamination.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), [x.item_id for x in r.found]) for r in got) == [("1", [4]), ("1", [4]), ("2", []), ("None", []), ("None", [])]
