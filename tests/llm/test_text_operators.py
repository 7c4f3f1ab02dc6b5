"""Sharding, line dedup, URL rules, token ids and SentencePiece against brute force, and their edge cases."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import AddedToken, Tokenizer

from priorforge.llm import line_dedup, queries, sentencepiece_codec, sharding, token_store, url_filter

SF = "/root/testdata/sf0.001"
EDGE = [(1, "a\nb\nc\nd"), (2, None), (3, ""), (4, "a\nb\nc\nd"), (4, "a\nb\nc\nd"), (None, "a\nb\nc"), (None, None), (7, "x y " * 30000), (8, " \n\t\n"), (9, "é日😀▁<s>\x00 ok")]
CLASH = "doc_id long, text string, shard int, slot int, h long, spans string, ids string, fp long, row_no int, n int, id int, k int, row string"


def docs(spark, rows=EDGE):
    """Documents with extra columns that carry the operators' own names."""
    return spark.createDataFrame([(i, t, 1, 2, 3, "s", "i", 4, 5, 6, 7, 8, "r") for i, t in rows], CLASH)


def documents():
    return duckdb.connect().sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


# ---- sharding


def place(x, n, seed=7, rounds=sharding.ROUNDS):
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)

    def chain(*values):
        h = 42
        for kind, v in values:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    def once(p):
        l, r = divmod(p, b)
        for i in range(rounds):
            if i % 2 == 0:
                l = (l + chain(("q", seed), ("q", i), ("q", r)) % a) % a
            else:
                r = (r + chain(("q", seed), ("q", i), ("q", l)) % b) % b
        return l * b + r

    p = once(x)
    while p >= n:
        p = once(p)
    return p


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 101, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = [r.p for r in spark.range(n).select(sharding.permuted(queries.F.col("id"), n).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if 1 < n <= 101:
        assert got == [place(i, n) for i in range(n)]


def test_shards(spark):
    rows = queries.op9_sharding(spark, SF).collect()
    texts = dict(documents())
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for s, c in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(c))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    again = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet").repartition(7))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}


def test_shards_edges(spark):
    rows = sharding.shard_documents(docs(spark), 3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in EDGE)
    assert len({(r.shard, r.slot) for r in rows}) == len(EDGE)
    assert [r.size for r in rows if r.doc_id == 2] == [16]
    assert sharding.shard_documents(docs(spark, []), 3).count() == 0


def test_many_copies_take_all_slots(spark):
    df = spark.range(20000).select(queries.F.lit(5).cast("long").alias("doc_id"), queries.F.lit("same").alias("text"))
    rows = sharding.shard_documents(df, 7).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in rows) == 20000 and all(r["max(slot)"] == r["count(1)"] - 1 for r in rows)


# ---- line dedup


def brute_lines(rows, window=3):
    texts = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1], xxh(x[2])))
    first, gone = {}, {}
    wins = []
    for key in texts:
        lines = key[2].split("\n")
        full = [k for k, l in enumerate(lines) if l.strip(" ")]
        for a in range(len(full) - window + 1):
            wins.append((key, full[a], full[a + window - 1], tuple(lines[full[a + j]].strip(" ") for j in range(window))))
    for key, s, e, w in wins:
        first.setdefault(w, (key, s, e))
    for key, s, e, w in wins:
        k, fs, fe = first[w]
        if not (k == key and s <= fe):
            gone.setdefault(key, set()).update(range(s, e + 1))
    out = {}
    for key in texts:
        out[key] = "\n".join(l for k, l in enumerate(key[2].split("\n")) if k not in gone.get(key, ()))
    return out


def xxh(t):
    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def check_lines(rows, got):
    want = brute_lines(rows)
    for r in got:
        if r.src is None:
            assert r.text is None and r.n_removed == 0
        else:
            assert r.text == want[(r.doc_id is not None, r.doc_id or 0, r.src)], r.doc_id


def test_lines_on_documents_and_random_texts(spark):
    random.seed(3)
    made = [(k // 2, "\n".join(random.choice(["p", "q", " r", "", "s "]) for _ in range(random.randint(0, 14)))) for k in range(300)]
    for rows in (documents(), made, EDGE):
        df = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, src string")
        got = line_dedup.dedup_lines(df).collect()
        assert len(got) == len(rows)
        check_lines(rows, got)


def test_lines_keep_columns_and_empty_tables(spark):
    assert line_dedup.dedup_lines(docs(spark)).columns[:13] == docs(spark).columns
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# ---- URLs

PAGES = [
    (1, "http://A.com/en/1", '<link rel="canonical" href="https://b.org/es/x">'),
    (2, "https://b.org/es/x?q", None),
    (3, "http://c.net/fr/", '<meta http-equiv="refresh" content="0; url=//a.com/en/1">'),
    (4, "http://x.fr/1", '<html><LINK href=/2 REL=canonical></html>'),
    (5, "http://x.fr/2", '<meta http-equiv=refresh content="3;URL=http://sub.example.com/en/77">'),
    (6, None, "canonical"),
    (7, "no scheme", ""),
    (8, "http://example.com", ""),
    (9, "ftp://u.example.net/de/8#f", ""),
    (10, "http://d.net/de/9", ""),
    (11, "http://y.fr/a", '<link rel=canonical href="http://z.fr/b">'),
    (12, "http://z.fr/b", '<link rel=canonical href="http://k.com/en/">'),
    (12, "http://z.fr/b", '<link rel=canonical href="http://k.com/en/">'),
]
VERDICTS = {1: ("com/en/", "block"), 2: ("org/es/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"),
            8: (None, "allow"), 9: ("example.net/de/8", "block"), 10: ("net/de/", "allow"), 11: (None, "block"), 12: (None, "block")}


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS node", "'q' AS host", "2 AS v")
    got = url_filter.judge_urls(pages, url_filter.page_edges(pages)).collect()
    assert len(got) == len(PAGES)
    assert {r.page_id: (r.rule, r.verdict) for r in got} == VERDICTS
    by = {r.page_id: (r.host, r.path) for r in got}
    assert by[1] == ("a.com", "/en/1") and by[6] == ("", "") and by[7] == ("", "") and by[8] == ("example.com", "") and by[9] == ("u.example.net", "/de/8")
    assert url_filter.judge_urls(pages.limit(0), url_filter.page_edges(pages.limit(0))).count() == 0


def test_urls_sql(spark, tmp_path):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/*.parquet'")
    want = sorted(map(str, con.sql(queries.OP2_SQL).project("page_id, host, path, rule, verdict").fetchall()))
    got = queries.op2_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_long_chains_of_redirects(spark):
    n = 200
    pages = spark.createDataFrame([(k, f"http://h{k}.fr/p", None) for k in range(n)], "page_id long, url string, html string")
    edges = spark.createDataFrame([(f"http://h{k}.fr/p", f"http://h{k + 1}.fr/p") for k in range(n - 1)] + [("http://h0.fr/p", "http://bad.com/en/")], "src string, dst string")
    assert {r.verdict for r in url_filter.judge_urls(pages, edges).collect()} == {"block"}


# ---- token ids


def test_token_files(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for i, x in documents():
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_token_store(spark, SF).collect()} == want


def test_token_files_edges(spark):
    for rows in (EDGE, []):
        path = token_store.new_path(spark)
        token_store.write_tokens(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), path, block_tokens=50)
        got = token_store.read_tokens(spark, path, with_ids=True).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
        got.sort(key=lambda r: r.start)
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
        assert [r.doc_id for r in got if r.doc_id] == sorted(r.doc_id for r in got if r.doc_id)
        assert all(r.ids[-1] == 0 and len(r.ids) == r.n_tokens for r in got)


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for vocab in (100, 65000):  # symbols of 16 and of 32 bits
        for n in (1, 2, 50, 5000):
            runs = [rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint32).tobytes() for _ in range(n)]
            block = token_store._block(0, 0, 0, list(range(n)), runs, vocab)
            assert [x.tobytes() for x in token_store.decode_block(block)] == runs
            for d in {0, n // 2, n - 1}:
                ids = np.frombuffer(runs[d], np.uint32)
                assert token_store.decode_range(block, d).tobytes() == runs[d]
                for s in range(-1, len(ids) + 2):
                    for e in range(-1, len(ids) + 2):
                        assert token_store.decode_range(block, d, s, e).tolist() == ids[max(0, s) : max(0, e)].tolist()
        assert block["width"] == (2 if vocab == 100 else 4) and len(block["symbols"]) < sum(map(len, runs)) / (4 if vocab == 100 else 2)
        rules = np.frombuffer(block["rules"], "<u4").reshape(-1, 2)
        lengths = np.frombuffer(block["rule_tokens"], "<u4")
        assert [len(token_store._unfold(np.array([vocab + k]), rules, vocab)) for k in range(len(rules))] == lengths.tolist()


def test_grammar_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(2)
    ids = np.repeat(rng.integers(0, 50, 4000), 3).astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    sym, last, rules, width = token_store.compress(ids, last, 50)
    pairs = Counter(zip(sym[:-1].tolist(), sym[1:].tolist()))
    # overlapping occurrences count here, so a run may show a pair a few times more
    assert max(n for (a, b), n in pairs.items() if a != b) < token_store.RULE_BYTES // width + 2
    # the first rule round holds the most frequent pair of all
    first = Counter(zip(ids[:-1].tolist(), ids[1:].tolist())).most_common(1)[0][0]
    assert list(first) in rules.tolist()


def test_ranges_of_tokens(spark):
    path = token_store.new_path(spark)
    rows = [(i, t) for i, t in documents()[:40]] + [(3, "a second text of this id")]
    token_store.write_tokens(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), path, block_tokens=2000)
    want = {}
    for r in token_store.read_tokens(spark, path, with_ids=True).collect():
        want.setdefault(r.doc_id, []).append(r.ids)
    asked = [(i, 5 * k, 5 * k + 9) for k, (i, _) in enumerate(rows[:20])] + [(3, 0, 10**9), (10**6, 0, 3)]
    got = token_store.read_ranges(spark, path, spark.createDataFrame(asked, "doc_id long, first long, last long")).collect()
    assert sorted((r.doc_id, r.first, r.last, r.ids) for r in got) == sorted((i, s, e, ids[s:e]) for i, s, e in asked for ids in want.get(i, []))


ALPHABET = ["a", "the", " ", "  ", "\n", "\n\n", "é", "日", "😀", "<|endoftext|>", "\t", "\x00", "\x1c", "\x85", "!", "***", "'s", "'ll", "12", "\xa0", "　", "½", "Ⅷ", "▁", "<s>", "<0x0A>", "—", "”.", "\r"]


def test_encoders_equal_the_libraries():
    random.seed(5)
    texts = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 25))) for _ in range(3000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = token_store.Encoder(open(path).read())
    assert any("<|endoftext|>" in t for t in texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in enc.group(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    codec = sentencepiece_codec.Codec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids, counts, decoded = codec.group(texts)
    want = lib.encode(texts)
    assert np.split(ids, np.cumsum(counts)[:-1])[7].tolist() == want[7]
    assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == list(map(len, want)) and decoded == [lib.decode(w) if w else "" for w in want]
    # the heap and the list agree
    assert all([x for x in codec._long(w) if x] == codec._short(w) for w in ("▁internationalisation", "▁" * 9, "abcabcabc", "******"))


def test_added_tokens_with_rules_go_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.add_tokens([AddedToken("wide", lstrip=True, rstrip=True), AddedToken("alone", single_word=True), "plain"])
    texts = ["a wide b", "alone", "not_alone alone", " wide  wide", "explain plain", "none"]
    got = token_store.Encoder(lib.to_str()).group(texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_memos_are_bounded_by_bytes(monkeypatch):
    """Runs without blanks, each several megabytes long, don't add up in a worker."""
    for module in (sentencepiece_codec, token_store):
        monkeypatch.setattr(module, "KEPT_BYTES", 1 << 20)
    random.seed(9)
    texts = ["".join(random.choice("abcdefghijklmnop日本語") for _ in range(n)) for n in (2_000_000, 300_000, 5)] + ["a b"]
    enc = token_store.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    codec = sentencepiece_codec.Codec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    for t in texts:
        assert np.frombuffer(enc.group([t])[0], np.uint32).tolist() == enc.lib.encode(t, add_special_tokens=False).ids
        assert codec.group([t], 0)[2] == [t]  # checked against the library as a whole
    for x in (enc, codec):
        assert x.held <= 1 << 20 and sum(map(len, x.known.values())) <= 1 << 20


def test_decoding_reads_the_ids():
    codec = sentencepiece_codec.Codec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    codec.agenda = lambda part, real=codec.agenda: [*real(part), 300]
    codec.check = False
    assert codec.group(["one two"])[2] != ["one two"]


def test_wrong_ids_are_noticed():
    codec = sentencepiece_codec.Codec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    codec.by_parts = False  # as for a vocabulary without places to cut: whole documents are checked
    codec.group(["one two", "", "three"])
    codec.known[codec.cut.findall(codec.prefix + "two")[0]] = b"\0\0\0\0"
    with pytest.raises(RuntimeError):
        codec.group(["one", "two"])


def test_sentencepiece_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(x := sp.encode(t)), sha(",".join(map(str, x))), sha(sp.decode(x))) for i, t in documents()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_sentencepiece(spark, SF).collect()} == want


def test_sentencepiece_edges(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sentencepiece_codec.encode_documents(docs(spark), path)
    rows = got.collect()
    assert len(rows) == len(EDGE)
    assert all((r.ids, r.n_tokens, r.decoded) == ([], 0, "") for r in rows if r.doc_id in (2, 3))
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode_ids(got, path).collect()}
    assert back[1] == "a\nb\nc\nd" and back[7] == EDGE[7][1]
    assert sentencepiece_codec.encode_documents(docs(spark, []), path).count() == 0
