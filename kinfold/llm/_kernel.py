"""Vectorised text primitives over Arrow string columns, shared by the operators that run in numpy.

Everything works on one flat UTF-8 buffer and the offsets of its texts. Work is done in slices of bounded
bytes (one text longer than a slice is a slice of its own), so memory follows the slice, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on a uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _stream(11, 256) | np.uint64(1)
_BYTE[SPACE] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_PLACE = _stream(23, 1 << 16) | np.uint64(1)
_SHINGLE = _stream(37, 64) | np.uint64(1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of at most ``most`` text bytes: (rows, bytes, offsets)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        flat, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), flat[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for the next task, maybe of another stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def words(flat: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (hash of each word, text of each word, words of each text)."""
    docs = len(offs) - 1
    solid = ~SPACE[flat]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    bound = offs[:-1][offs[:-1] < len(flat)]
    first[bound] = solid[bound]
    starts = np.flatnonzero(first)
    per = np.diff(np.searchsorted(starts, offs))
    doc = np.repeat(np.arange(docs, dtype=np.int32), per)
    if not len(starts):
        return np.zeros(0, np.uint64), doc, per
    span = np.diff(np.append(starts, len(flat)))
    place = np.arange(starts[0], len(flat), dtype=np.int64) - np.repeat(starts, span)
    value = (_BYTE_LOWER if lower else _BYTE)[flat[starts[0] :]]
    value *= _PLACE[place & 0xFFFF]
    if span.max() > len(_PLACE):  # places of very long words beyond the table
        far = np.flatnonzero(place >= len(_PLACE))
        value[far] *= mix(place[far].astype(np.uint64) >> np.uint64(16)) | np.uint64(1)
    return mix(np.add.reduceat(value, starts - starts[0])), doc, per


def shingles(word: np.ndarray, per: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, text after text, and their number in each text (with repeats).

    A text of fewer than k words gives its whole sequence as one shingle; without words it gives none.
    """
    ends = np.cumsum(per)
    n = np.where(per >= k, per - k + 1, (per > 0).astype(per.dtype))
    weighed = [word * _SHINGLE[j] for j in range(k)]
    total = np.zeros(len(word), np.uint64)
    for j in range(k):
        total[: len(word) - j] += weighed[j][j:]
    begin = ends - per
    at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = total[at]
    place = np.cumsum(n) - n
    for d in np.flatnonzero((per > 0) & (per < k)):
        short = np.uint64(0x5EED) * np.uint64(per[d])
        for j in range(per[d]):
            short = short + weighed[j][begin[d] + j]
        out[place[d]] = short
    return mix(out), n


def distinct_sets(value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the hashes of each text and drop repeats: (hashes, number in each text)."""
    value, ends = value.copy(), np.cumsum(n)
    at = 0
    for to in ends.tolist():
        if to - at > 1:
            value[at:to].sort()
        at = to
    if not len(value):
        return value, n
    doc = np.repeat(np.arange(len(n)), n)
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], np.bincount(doc[keep], minlength=len(n))


def code_points(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of code points of each text."""
    lead = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    return lead[offs[1:]] - lead[offs[:-1]]
