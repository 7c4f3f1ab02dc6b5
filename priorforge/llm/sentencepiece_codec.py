"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, by a score-ordered agenda.

Adjacent symbols whose concatenation is a piece wait on an agenda, best score first, leftmost first among equals; the
best pair merges and its new neighbours join the agenda. Characters that no piece covers fall back to byte pieces.
Merges never cross a place between two characters that stand side by side in no piece: the text is cut at such places
(before blanks, between letters and punctuation marks), and each worker keeps the segmentations of the parts it has
met. Every new part is checked against the sentencepiece library as it is met, a batch at a time, and so is one whole
document of each Arrow batch; a vocabulary without such cuts has every document checked. Decoding is the library's, from
the ids of each document.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import GROUP_BYTES

BLANK = "▁"
#: Bytes of the parts that a worker keeps (with what Python needs for each); beyond, it starts anew.
KEPT_BYTES, ENTRY_BYTES = 128 << 20, 150
#: Up to so many characters the agenda is a plain list.
SHORT = 48


class Codec:
    """Encoder and decoder for a model file's bytes."""

    def __init__(self, model: bytes, check: bool = True):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check = check
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        self.cut = self._cutter()
        # what the library does with a lone 'a' shows whether it sets a blank before the text
        self.prefix = BLANK if sp.decode_pieces([BLANK + "a"]) == "a" and sp.encode("a", out_type=str)[0].startswith(BLANK) else ""
        #: whether parts can be checked in one text, between line ends; else documents are, each of them
        self.by_parts = bool(self.cut and self.cut.fullmatch("\n") and len(self.cut.findall("\na")) == 2)
        #: ids (int32) of parts, and the bytes that these take
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _cutter(self) -> re.Pattern | None:
        """Pattern of the parts that no merge leaves; None if pieces have blanks after other characters.

        Characters that stand side by side in some piece, or are linked by such, form a class; a part is a run of blanks
        and then of one class. A character that no longer piece holds is a part of its own.
        """
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            return None
        up: dict[str, str] = {}

        def top(c: str) -> str:
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        for p in self.ids:
            body = p.lstrip(BLANK)
            for x, y in zip(body, body[1:]):
                up[top(x)] = top(y)
        classes: dict[str, list[str]] = {}
        for c in up:
            classes.setdefault(top(c), []).append(c)
        large = sorted(classes.values(), key=len, reverse=True)
        return re.compile("|".join([f"{BLANK}*[{re.escape(''.join(sorted(c)))}]+" for c in large] + [f"{BLANK}*[^{BLANK}]", f"{BLANK}+"]), re.S)

    def agenda(self, part: str) -> list[int]:
        """Ids of a part by merging the best adjacent pair again and again."""
        if len(part) == 1 and part in self.ids:
            return [self.ids[part]]
        sym = self._short(part) if len(part) <= SHORT else self._long(part)
        out: list[int] = []
        for s in sym:
            if s:
                i = self.ids.get(s)
                if i is not None:
                    out.append(i)
                elif self.byte_ids:
                    out.extend(self.byte_ids[b] for b in s.encode())
                else:
                    out.append(self.unk)
        return out

    def _short(self, part: str) -> list[str]:
        """The agenda as a list of scores in the order of the text: its first greatest entry is next."""
        sym, get, none = list(part), self.scores.get, -math.inf
        wait = [get(a + b, none) for a, b in zip(sym, sym[1:])]
        while wait and (best := max(wait)) != none:
            i = wait.index(best)
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
            del wait[i]
            if i:
                wait[i - 1] = get(sym[i - 1] + sym[i], none)
            if i < len(wait):
                wait[i] = get(sym[i] + sym[i + 1], none)
        return sym

    def _long(self, part: str) -> list[str]:
        """The agenda as a heap, with stale entries told by their length."""
        sym, n, score = list(part), len(part), self.scores
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        wait = [(-s, i, 2) for i in range(n - 1) if (s := score.get(sym[i] + sym[i + 1])) is not None]
        heapq.heapify(wait)
        while wait:
            _, i, size = heapq.heappop(wait)
            j = right[i]
            if not sym[i] or j >= n or len(sym[i]) + len(sym[j]) != size:
                continue
            merged = sym[i] + sym[j]
            if merged not in score:
                continue
            sym[i], sym[j] = merged, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (s := score.get(merged + sym[k])) is not None:
                    heapq.heappush(wait, (-s, i, len(merged) + len(sym[k])))
            h = left[i]
            if h >= 0 and (s := score.get(sym[h] + merged)) is not None:
                heapq.heappush(wait, (-s, h, len(sym[h]) + len(merged)))
        return sym

    def learn(self, parts: list[str]) -> None:
        """Segment new parts and hold them against the library."""
        got = [self.agenda(p) for p in parts]
        if self.check and self.by_parts:
            self._compare(parts, got)
        raw = [array("i", a).tobytes() for a in got]
        self.held = kept(self.known, self.held, parts, raw, KEPT_BYTES)

    def _compare(self, parts: list[str], got: list[list[int]]) -> None:
        """The library's ids of all new parts, set in one text with line ends between them, which are parts of their own."""
        end = self.agenda("\n")
        theirs = self.lib.encode("\n" + "".join([p + "\n" for p in parts]))
        want = (self.agenda(BLANK) if self.prefix else []) + end + [i for a in got for i in (*a, *end)]
        if theirs != want:
            bad = [p for p, a in zip(parts, got) if self.lib.encode("\n" + p) != (self.agenda(BLANK) if self.prefix else []) + end + a]
            raise RuntimeError(f"the agenda differs from the library on {bad[:5]!r}")

    def group(self, texts: list[str], whole: int | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids, ids per text, decoded texts) of some texts. Text number ``whole`` is checked as a whole."""
        find = self.cut.findall if self.cut else lambda t: [t]
        flat, ends = [], [0]
        for t in texts:
            if t:
                flat += find((self.prefix + t).replace(" ", BLANK))
            ends.append(len(flat))
        got = look_up(self.known, flat, self.learn)
        runs = [b"".join(got[s:e]) for s, e in zip(ends, ends[1:])]
        counts = np.array([len(r) // 4 for r in runs], np.int64)
        ids = np.frombuffer(b"".join(runs), np.int32)
        cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
        rows = [ids[s:e].tolist() for s, e in zip(cuts, cuts[1:])]
        if self.check:
            for k in range(len(texts)) if not self.by_parts else [] if whole is None else [whole]:
                if rows[k] != self.lib.encode(texts[k]):
                    raise RuntimeError(f"the ids differ from the library's on the text {texts[k][:80]!r}")
        return ids, counts, [self.decode(r) for r in rows]

    def decode(self, ids: list[int]) -> str:
        """The library's text of a document's ids."""
        return self.lib.decode(ids) if ids else ""


def kept(known: dict, held: int, keys: list, values: list[bytes], limit: int) -> int:
    """Put new entries into a memo that starts anew beyond ``limit`` bytes; what it holds now."""
    size = ENTRY_BYTES * len(keys) + sum(map(len, keys)) + sum(map(len, values))
    if held + size > limit:
        known.clear()
        held = 0
    known.update(zip(keys, values))
    return held + size


def look_up(known: dict, keys: list, learn) -> list:
    """Values of keys; ``learn`` puts the missing ones into ``known`` (and may drop others)."""
    got = list(map(known.get, keys))
    if None in got:
        missing = [i for i, g in enumerate(got) if g is None]
        learn(list({keys[i] for i in missing}))
        for i in missing:
            got[i] = known[keys[i]]
    return got


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec for each model in a process."""
    if (key := hash(model)) not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def text_groups(texts: list[str], limit: int = GROUP_BYTES):
    """Ranges of rows of about ``limit`` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int, no begin or end ids), n_tokens, decoded (the text that the ids decode to).

    Whole texts, however long: a very long one is cut into parts like any other. A null text counts as empty, which has
    no ids and decodes to the empty text. Of equal scores the leftmost pair merges first. Rows are independent: repeated
    ids or texts give repeated rows, an empty table an empty one, and other columns, whatever their names, aren't read.
    ``model_path`` is a file on the driver; its bytes go to the executors as a broadcast (a vocabulary, so of bounded size).
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    ids_type = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", ids_type), ("n_tokens", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        c = codec(model.value)
        for k, b in enumerate(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            whole = k % max(1, len(texts))
            for s, e in text_groups(texts):
                ids, counts, decoded = c.group(texts[s:e], whole - s if s <= whole < e else None)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s).cast(pa.int64()), lists, pa.array(counts), pa.array(decoded, pa.string())], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string")


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text: the texts of arrays of ids; a null array decodes to the empty text."""
    with open(model_path, "rb") as f:
        model = rows.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        c = codec(model.value)
        for b in batches:
            out = [c.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], schema=schema)

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
