"""Terms of texts, found on the bytes of Arrow string columns.

A term is a run of ASCII letters and of code points beyond ASCII, with A-Z lower-cased: in
UTF-8 a run of bytes a-z or from 0x80 on, so no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at in one go.
STEP = 4 << 20


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text starts and ends."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[col.offset:col.offset + len(col) + 1] \
        if offsets is not None and len(col) else np.zeros(1, dtype=kind)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at.astype(np.int64) - at[0]


def _is_letter(raw: np.ndarray) -> np.ndarray:
    return (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 65) & (raw <= 90))


def pieces(raw: np.ndarray, offsets: np.ndarray, step: int = STEP
           ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about ``step`` bytes at most.  A
    longer text comes alone in several pieces, cut where no term is cut (a term longer than
    ``step`` stays whole)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        if hi - lo <= step:
            yield row, raw[lo:hi], offsets[row:end + 1] - lo
        while hi - lo > step:
            cut = hi
            for a in range(lo + step, hi, step):
                gap = np.flatnonzero(~_is_letter(raw[a:min(a + step, hi)]))
                if len(gap):
                    cut = a + int(gap[0])
                    break
            yield row, raw[lo:cut], np.array([0, cut - lo])
            lo = cut
            if hi > lo and hi - lo <= step:
                yield row, raw[lo:hi], np.array([0, hi - lo])
        row = end


def find_terms(raw: np.ndarray, offsets: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased, and start, end and row of each term."""
    letter = _is_letter(raw)
    low = raw | (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    opens[inner] = letter[inner]  # a term does not go from one text into the next
    closes = letter.copy()
    closes[:-1] &= ~letter[1:]
    closes[inner - 1] = letter[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def as_strings(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The terms at these places, which are all terms of ``low``."""
    sizes = ends - starts
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    kept = low[_is_letter(low)]
    return pa.Array.from_buffers(pa.large_string(), len(starts),
                                 [None, pa.py_buffer(at), pa.py_buffer(kept)])
