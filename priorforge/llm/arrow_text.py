"""Text columns of Arrow batches as NumPy arrays, and small helpers for mapInArrow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about so many bytes, so that temporary arrays stay small.
GROUP_BYTES = 1 << 20


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, offs


def pieces(offs: np.ndarray, body: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and byte ranges in groups of about ``limit`` bytes; longer rows are cut after a blank or line end.

    Yields (rows, bounds): piece k is body[bounds[k, 0]:bounds[k, 1]] and belongs to rows[k].
    """
    rows, bounds, held = [], [], 0
    for r in range(len(offs) - 1):
        s, e = int(offs[r]), int(offs[r + 1])
        while True:
            cut = e
            if e - s > limit:
                at = np.flatnonzero(body[s + limit // 2 : s + limit] <= 32)
                cut = s + limit // 2 + int(at[-1]) + 1 if len(at) else s + limit
                while cut < e and not len(at) and (body[cut] & 0xC0) == 0x80:
                    cut += 1
            rows.append(r)
            bounds.append((s, cut))
            held += cut - s
            s = cut
            if held >= limit:
                yield np.array(rows), np.array(bounds, np.int64).reshape(-1, 2)
                rows, bounds, held = [], [], 0
            if s >= e:
                break
    if rows:
        yield np.array(rows), np.array(bounds, np.int64).reshape(-1, 2)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a thousand rows, so that what is made of them stays small."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
