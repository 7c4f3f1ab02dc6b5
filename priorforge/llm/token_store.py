"""Token ids on disk, compressed by Re-Pair grammars: frequent pairs of ids become nonterminals, again and again.

The format is a Parquet table of blocks, so any store that Spark writes will do and the writer's commit protocol guards
against lost executors. A block holds consecutive documents: the tokens before them in their part, their
ids (doc_id), the tokens and the symbols of each,
the rules (pairs, a little-endian uint32 each) with the length that each expands to, and the symbols (uint32, or uint16
where they fit). Symbols below ``vocab`` are token ids, ``vocab`` + r is rule r. Rules never cross a document's end, so
a document is decoded from its own symbols and the rules alone, and the lengths give the symbol that holds any token, so
that a range of tokens is read without expanding the rest.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import scratch_root
from .sentencepiece_codec import kept, look_up, text_groups

#: Byte-level pre-tokens never cross these parts' edges: plain letters and digits (with the blank before) up to a mark or
#: white space, any other word or rest of one, a run of other white space.
PARTS = re.compile(r" ?[0-9A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-/:-@\[-`{-~\s]|$)| ?\S+|\s+(?!\S)|\s+")
#: White space to re, but not to the tokenizer.
ODD = "[\x1c-\x1f]"
#: Bytes of the parts that a worker keeps; beyond, it starts anew.
KEPT_BYTES = 256 << 20
BLOCK_TOKENS = 1 << 21
#: A round gives rules to the pairs that are at least this share as frequent as the most frequent one.
SHARE = 0.1
#: Bytes of a rule in a block: its pair and its length.
RULE_BYTES = 12
#: Slots of the table that names the pairs of a round, as a power of two.
SLOT_BITS = 20
#: Vocabularies that leave fewer numbers than this below 2^16 use 32-bit symbols.
LEAST_FREE = 1024
BLOCK_DDL = "part int, block int, before long, doc_ids array<long>, n_tokens array<long>, n_symbols array<long>, vocab long, rules binary, rule_tokens binary, symbols binary, width int"


class Encoder:
    """Ids of texts by the tokenizers library, which sees every distinct part; parts met before are kept."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(model)
        added = [t for t in self.lib.get_added_tokens_decoder().values() if t.content]
        plain = [not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added]
        #: texts that the library must see whole: with white space that re reads otherwise, or added tokens with rules
        self.apart = re.compile("|".join([ODD, *[re.escape(t.content) for t, ok in zip(added, plain) if not ok]]))
        #: other added tokens, which are parts of their own
        self.added = re.compile("(" + ("|".join(sorted((re.escape(t.content) for t, ok in zip(added, plain) if ok), key=len, reverse=True)) or "(?!)") + ")")
        self.vocab = self.lib.get_vocab_size()
        (self.line_end,) = self.lib.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, parts: list[str]) -> None:
        """Words go to the library in one text, with line ends between them, which are tokens of their own there."""
        known: dict[str, bytes] = {}
        words = [p for p in parts if not p.isspace()]
        if words:
            some = ["\n".join(words[k : k + 500]) + "\n" for k in range(0, len(words), 500)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(some, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.line_end).tolist()
            if len(ends) != len(words):
                raise RuntimeError("line ends merge with words in this vocabulary")
            raw, at = ids.tobytes(), 0
            for p, e in zip(words, ends):
                known[p] = raw[at : 4 * e]
                at = 4 * e + 4
        if rest := [p for p in parts if p not in known]:
            for p, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False)):
                known[p] = np.array(e.ids, np.uint32).tobytes()
        self.held = kept(self.known, self.held, list(known), list(known.values()), KEPT_BYTES)

    def group(self, texts: list[str]) -> list[bytes]:
        flat, ends = [], [0]
        for t in texts:
            if t and not self.apart.search(t):
                for k, x in enumerate(self.added.split(t)):
                    flat += [x] if k & 1 else PARTS.findall(x)
            ends.append(len(flat))
        got = look_up(self.known, flat, self.learn)
        return [self.whole(t) if t and s == e else b"".join(got[s:e]) for t, s, e in zip(texts, ends, ends[1:])]

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()


def compress(ids: np.ndarray, last: np.ndarray, vocab: int, share: float = SHARE):
    """(symbols, last, rules, width): a Re-Pair grammar of a block. ``last`` marks each document's last id.

    Each round counts all pairs inside documents exactly, gives a nonterminal to every pair that occurs at least ``share``
    as often as the most frequent one, and replaces its occurrences (of overlapping ones every second). Rounds go on until
    no pair saves more than its rule costs, or until the numbers below 2^16 are used up (with few of those beside the
    vocabulary, symbols have 32 bits): one more rule would double every symbol. The most frequent pairs come first.
    """
    width = 2 if vocab + LEAST_FREE <= 1 << 16 else 4
    limit, least = (1 << 8 * width) - vocab, RULE_BYTES // width + 2
    word = np.dtype(f"u{2 * width}").type
    half, none = word(8 * width), word((1 << 16 * width) - 1)
    spread, down = word(0x9E3779B97F4A7C15 >> (64 - 16 * width) | 1), word(16 * width - SLOT_BITS)
    sym, last = ids.astype(np.uint32), last.copy()
    rules: list[np.ndarray] = []
    made = 0
    while made < limit and len(sym) > 1:
        key = sym[:-1].astype(word) << half | sym[1:]
        key[last[:-1]] = none
        order = np.sort(key)
        start = np.concatenate([[0], np.flatnonzero(order[1:] != order[:-1]) + 1])
        count = np.diff(np.append(start, len(order)))
        if order[-1] == none:
            start, count = start[:-1], count[:-1]
        most = int(count.max(initial=0))
        if most < least:
            break
        good = np.flatnonzero(count >= max(least, most * share))
        if len(good) > limit - made:
            good = np.sort(good[np.argsort(-count[good], kind="stable")[: limit - made]])
        pair = order[start[good]]
        # a table by hash names the pairs; of two in one slot the other waits for the next round
        table = np.zeros(1 << SLOT_BITS, np.uint32)
        table[(pair * spread) >> down] = np.arange(len(pair), dtype=np.uint32)
        pair = pair[table[(pair * spread) >> down] == np.arange(len(pair))]
        table[(pair * spread) >> down] = np.arange(len(pair), dtype=np.uint32)
        # most places are left out by their first symbol alone
        begins = np.zeros(vocab + made + 1, bool)
        begins[pair >> half] = True
        at = np.flatnonzero(begins[sym[:-1]])
        found = key[at]
        name = table[(found * spread) >> down]
        hit = pair[name] == found
        at, name = at[hit], name[hit]
        # runs of neighbouring places overlap: take the 1st, 3rd, ... of each run
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        first = np.repeat(start, np.diff(np.append(start, len(at))))
        even = (np.arange(len(at)) - first) & 1 == 0
        at, name = at[even], name[even]
        rules.append(np.stack([pair >> half, pair & (none >> half)], 1).astype(np.uint32))
        sym[at] = np.uint32(vocab + made) + name
        last[at] |= last[at + 1]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        sym, last = sym[stay], last[stay]
        made += len(pair)
    return sym, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), width


def rule_lengths(rules: np.ndarray, vocab: int) -> np.ndarray:
    """Tokens that each rule expands to; a rule uses earlier rules only."""
    n = np.ones(len(rules), np.int64)
    size = lambda s: np.where(s < vocab, 1, n[np.maximum(s.astype(np.int64) - vocab, 0)])
    while True:
        m = size(rules[:, 0]) + size(rules[:, 1])
        if np.array_equal(m, n):
            return n
        n = m


def _unfold(out: np.ndarray, rules: np.ndarray, vocab: int) -> np.ndarray:
    """The tokens of some symbols, one level of rules at a time; only the rules that these symbols use are read."""
    out = out.astype(np.int64)
    while (inner := out >= vocab).any():
        ends = np.cumsum(1 + inner)
        got = np.empty(int(ends[-1]), np.int64)
        r = rules[out[inner] - vocab]
        got[ends[~inner] - 1] = out[~inner]
        got[ends[inner] - 2] = r[:, 0]
        got[ends[inner] - 1] = r[:, 1]
        out = got
    return out.astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocab: int) -> np.ndarray:
    """The tokens of many symbols, gathered from the expansions of all rules, whose ``lengths`` are given."""
    every = np.concatenate([np.arange(vocab, dtype=np.uint32), _unfold(rules.reshape(-1), rules, vocab)])
    size = np.concatenate([np.ones(vocab, np.int64), lengths.astype(np.int64)])
    start = np.cumsum(size) - size
    n = size[symbols]
    ends = np.cumsum(n)
    place = np.repeat(start[symbols] - (ends - n), n)
    place += np.arange(len(place))
    return every[place]


def _block(part: int, number: int, before: int, doc_ids: list, runs: list[bytes], vocab: int) -> dict:
    ids = np.frombuffer(b"".join(runs), np.uint32)
    n = np.array([len(r) // 4 for r in runs], np.int64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(n) - 1] = True
    sym, last, rules, width = compress(ids, last, vocab)
    ends = np.flatnonzero(last) + 1
    return {
        "part": part,
        "block": number,
        "before": before,
        "doc_ids": doc_ids,
        "n_tokens": n.tolist(),
        "n_symbols": np.diff(ends, prepend=0).tolist(),
        "vocab": vocab,
        "rules": rules.astype("<u4").tobytes(),
        "rule_tokens": rule_lengths(rules, vocab).astype("<u4").tobytes(),
        "symbols": sym.astype(f"<u{width}").tobytes(),
        "width": width,
    }


def write_tokens(docs: DataFrame, model_path: str, path: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), add ``end_id`` to each, and write blocks in ascending order of the id, nulls first.

    Texts are dealt by ranges of (id, text hash), so each part holds a range and parts are in order; equal ids stay in
    the order of their texts' hashes. A block ends with the document that reaches ``block_tokens``, however long. Added
    tokens of the vocabulary in a text are what the library makes of them. Repeated rows are documents of their own, an
    empty table gives no block, and columns other than the two aren't read, whatever their names.
    """
    with open(model_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], np.uint32).tobytes()
    schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64())]
        + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "n_tokens", "n_symbols")]
        + [("vocab", pa.int64()), ("rules", pa.binary()), ("rule_tokens", pa.binary()), ("symbols", pa.binary()), ("width", pa.int32())]
    )

    def run(batches):
        enc, part, number = _encoder(model.value), TaskContext.get().partitionId(), 0
        doc_ids, runs, held, before = [], [], 0, 0

        def out():
            return pa.RecordBatch.from_pylist([_block(part, number, before, doc_ids, runs, enc.vocab)], schema=schema)

        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [t or "" for t in b.column(1).to_pylist()]
            for s, e in text_groups(texts):
                for i, x in zip(ids[s:e], enc.group(texts[s:e])):
                    doc_ids.append(i)
                    runs.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= block_tokens:
                        yield out()
                        doc_ids, runs, held, number, before = [], [], 0, number + 1, before + held
        if runs:
            yield out()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = narrow.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(run, BLOCK_DDL).write.parquet(path)


_encoders: dict[int, Encoder] = {}


def _encoder(model: str) -> Encoder:
    if (key := hash(model)) not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _stored(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths of their expansions, symbols) of a block."""
    return np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_tokens"], "<u4"), np.frombuffer(row["symbols"], f"<u{row['width']}")


def decode_block(row: dict) -> list[np.ndarray]:
    """The ids of a block's documents."""
    rules, lengths, symbols = _stored(row)
    return np.split(expand(symbols, rules, lengths, row["vocab"]), np.cumsum(np.asarray(row["n_tokens"], np.int64))[:-1])


def decode_range(row: dict, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of one of a block's documents: only the symbols that hold them are expanded."""
    rules, lengths, symbols = _stored(row)
    end = int(np.asarray(row["n_symbols"][: document + 1], np.int64).sum())
    own = symbols[end - row["n_symbols"][document] : end]
    size = np.ones(len(own), np.int64)
    size[own >= row["vocab"]] = lengths[own[own >= row["vocab"]].astype(np.int64) - row["vocab"]]
    ends = np.cumsum(size)
    stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
    start = max(0, start)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = np.searchsorted(ends, [start, stop - 1], "right")
    before = int(ends[a] - size[a])
    return _unfold(own[a : b + 1], rules, row["vocab"])[start - before : stop - before]


def read_ranges(spark, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, first, last, ids: tokens ``first`` to ``last`` (exclusive, from 0) of documents, without decoding the rest.

    wanted: (doc_id, first, last). Blocks meet their requests by the ids they hold; a range beyond the document's end is
    cut there, repeated requests are answered once for each of the document's rows, unknown ids not at all.
    """
    files = spark.read.schema(BLOCK_DDL).parquet(path)
    at = files.select("part", "block", F.posexplode("doc_ids").alias("place", "doc_id")).join(wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")), "doc_id")
    asked = at.groupBy("part", "block").agg(F.collect_list(F.struct("doc_id", "place", "first", "last")).alias("asked"))
    ids_type = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("ids", ids_type)])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                got = [decode_range(row, x["place"], x["first"], x["last"]).astype(np.int32) for x in row["asked"]]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in row["asked"]], pa.int64()) for c in ("doc_id", "first", "last")] + [pa.array(got, ids_type)], schema=schema)

    return files.join(asked, ["part", "block"]).mapInArrow(run, "doc_id long, first long, last long, ids array<int>")


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32[, ids], decoded from the files.

    A block knows the tokens before it in its part; the parts' counts (one number for each of the writer's partitions)
    are summed on the driver.
    """
    files = spark.read.schema(BLOCK_DDL).parquet(path)
    count = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = sorted(map(tuple, files.groupBy("part").agg(F.sum(count)).collect()))
    offsets, total = {}, 0
    for p, n in parts:
        offsets[p] = total
        total += n
    ids_type = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", ids_type)] * with_ids)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = decode_block(row)
                n = np.asarray(row["n_tokens"], np.int64)
                cols = [row["doc_ids"], offsets[row["part"]] + row["before"] + np.cumsum(n) - n, n, [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(cols, schema)] + ([pa.array([x.astype(np.int32) for x in ids], ids_type)] if with_ids else []), schema=schema
                )

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.mapInArrow(run, ddl)


def new_path(spark) -> str:
    """A fresh folder for token files under the scratch folder."""
    import uuid

    return f"{scratch_root(spark)}/tokens/{uuid.uuid4().hex}"
