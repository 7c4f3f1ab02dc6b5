"""Hashed word features of many texts at once, in NumPy over Arrow's text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .arrow_text import GROUP_BYTES, column_bytes, pieces

_BASE = 0x100000001B3 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)  # modulo 2^64


class _Tables:
    up = down = np.zeros(0, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Tables.up) <= n:
        size = max(n + 1, 2 * GROUP_BYTES)
        _Tables.up, _Tables.down = _powers(_BASE, size), _powers(_INVERSE, size)
    return _Tables.up, _Tables.down


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | (_BYTES >= 128)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_ALNUM = _LETTER | _DIGIT
_PLACED = _LOWER.astype(np.uint64) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hash of byte ranges from running sums of byte * base^place, so that equal ranges have equal hashes anywhere."""
    return mix((prefix[end] - prefix[start]) * down[start])


class Words:
    """Words of a group of texts: ``row`` (index of the text in its batch), ``core`` (hash of its letters and digits,
    A-Z lower-cased; 0 if it has none), ``shape`` (hash of its case, its length class and the other marks that end it)
    and ``follows`` (whether the word before belongs to the same text). Without ``shapes`` only row, core and follows; with
    ``stem`` also the hash of the first so many bytes of the core (of all, if they are fewer)."""

    def __init__(self, body: np.ndarray, rows: np.ndarray, bounds: np.ndarray, shapes: bool = True, stem: int = 0):
        self.old = 0
        lens = bounds[:, 1] - bounds[:, 0]
        n = int((lens + 1).sum())
        text = np.full(n, 32, np.uint8)
        at = np.cumsum(lens + 1) - lens - 1
        for (s, e), a in zip(bounds.tolist(), at.tolist()):
            text[a : a + e - s] = body[s:e]
        gap = _SPACE[text]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if n and not gap[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        self.row = rows[np.searchsorted(at, start, "right") - 1]
        self.follows = np.zeros(len(start), bool)
        self.follows[1:] = self.row[1:] == self.row[:-1]
        alnum = _ALNUM[text]
        up, down = _tables(n)
        prefix = np.zeros(n + 1, np.uint64)
        # the core: from the first to the last letter or digit of the word
        np.cumsum(_PLACED[text] * up[:n], out=prefix[1:])
        seen = np.flatnonzero(alnum)
        if len(seen) and len(start):
            i, j = np.searchsorted(seen, start), np.searchsorted(seen, end)
            has = j > i
            first = np.where(has, seen[np.minimum(i, len(seen) - 1)], start)
            last = np.where(has, seen[np.maximum(j - 1, 0)] + 1, start)
        else:
            has, first, last = np.zeros(len(start), bool), start, start
        self.core = np.where(has, _range_hash(prefix, first, last, down), np.uint64(0))
        if stem:
            self.stem = np.where(has, _range_hash(prefix, first, np.minimum(last, first + stem), down), np.uint64(0))
        if not shapes:
            return
        tail = mix((prefix[end] - prefix[last]) * down[last])
        head = mix((prefix[first] - prefix[start]) * down[start])
        caps = np.zeros(n + 1, np.int32)
        np.cumsum(_UPPER[text], out=caps[1:])
        letters = np.zeros(n + 1, np.int32)
        np.cumsum(_LETTER[text], out=letters[1:])
        ups, lets = caps[end] - caps[start], letters[end] - letters[start]
        style = np.where(lets == 0, 0, np.where(ups == 0, 1, np.where(ups == 1, 2, np.where(ups * 2 >= lets, 3, 4)))).astype(np.uint64)
        long = np.minimum(end - start, 64)
        size = np.searchsorted([2, 5, 9, 14, 24, 40], long).astype(np.uint64)
        self.style = style
        self.shape = mix((tail ^ (head >> np.uint64(1))) * np.uint64(31) + style * np.uint64(8) + size)
        self.marks = mix((tail ^ (head >> np.uint64(1))) * np.uint64(37) + style)


def groups(col: pa.Array, shapes: bool = True, stem: int = 0, carry: int = 0) -> Iterator[Words]:
    """The words of a string column, about a megabyte at a time; null is empty. A text may go on in the next group, which
    then begins with the ``carry`` words before it: ``old`` counts these, they are there for pairs only."""
    body, offs = column_bytes(col)
    before = None
    for rows, bounds in pieces(offs, body):
        w = Words(body, rows, bounds, shapes, stem)
        w.old = 0
        if before is not None and carry and len(w.row) and len(before.row) and before.row[-1] == w.row[0]:
            w.old = min(carry, int((before.row[-carry:] == w.row[0]).sum()))
            for name, new in list(vars(w).items()):
                if isinstance(new, np.ndarray):
                    setattr(w, name, np.concatenate([getattr(before, name)[-w.old :], new]))
            w.follows[w.old] = True
        if len(w.row):
            before = w
        yield w


def pairs(w: Words, values: np.ndarray, gap: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each new word's value with the one ``gap`` words before it in the same text."""
    s = max(gap, w.old)
    if len(values) <= s:
        return w.row[:0], values[:0]
    now, then = slice(s, None), slice(s - gap, len(values) - gap)
    same = w.row[now] == w.row[then]
    h = mix(values[now] * np.uint64(0x9E3779B97F4A7C15) + values[then] + np.uint64(salt))
    return w.row[now][same], h[same]
