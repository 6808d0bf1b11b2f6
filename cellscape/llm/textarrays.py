"""Vectorised word and shingle hashing over Arrow string columns.

Everything here works on one slice of an Arrow batch at a time (about `SLICE_BYTES` of text), so a task's memory is bounded by
the slice and the longest single document, not by the batch. Words are runs of bytes outside 0x20 and 0x09-0x0D after A-Z is
lower-cased; they are hashed to 64 bits by a polynomial over a table of mixed byte values, evaluated with one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply), vectorised."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64; kept and doubled as needed."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            out = np.empty(size, dtype=np.uint64)
            out[0], done, step = 1, 1, base
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(step)
                done, step = 2 * done, (step * step) & _MASK
            _powers[name] = out
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a slice. starts/ends are byte positions in data; doc is each word's row; first[d]:first[d + 1] are row d's words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of about `limit` bytes of `column`; a longer text makes a part by itself."""
    at = batch.schema.get_field_index(column)
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside is_gap, cut at the rows' bounds."""
    inside = ~is_gap[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    finishes[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def words(col: pa.Array, is_gap: np.ndarray = IS_SPACE) -> Words:
    """Words of a slice's texts, lower-cased over A-Z, with their hashes."""
    data, offsets = buffers(col)
    data = LOWER[data]
    starts, ends = word_bounds(data, offsets, is_gap)
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, starts, ends, doc, first, span_hashes(data, starts, ends))


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of the k-word shingles in text order, first[d]:first[d + 1] those of row d; a row of 1 to k - 1
    words has its whole sequence as its one shingle, a row without words none."""
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(first[-1], dtype=np.uint64)
    if len(w.hashes) >= k:
        rolled = w.hashes[: len(w.hashes) - k + 1].copy()
        for i in range(1, k):
            rolled = rolled * _STEP + w.hashes[i : len(w.hashes) - k + 1 + i]
        whole = np.flatnonzero(w.doc[: len(rolled)] == w.doc[k - 1 :])
        place = first[w.doc[whole]] + whole - w.first[w.doc[whole]]
        out[place] = mix64(rolled[whole])
    for d in np.flatnonzero((n > 0) & (n < k)):
        value = np.uint64(n[d])
        with np.errstate(over="ignore"):
            for h in w.hashes[w.first[d] : w.first[d + 1]]:
                value = value * _STEP + h
        out[first[d]] = mix64(np.array([value]))[0]
    return out, first


def distinct_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted without repeats, and the new bounds."""
    parts, sizes = [], np.zeros(len(first), dtype=np.int64)
    for d in range(len(first) - 1):
        if first[d + 1] > first[d]:
            part = np.sort(values[first[d] : first[d + 1]])
            keep = np.empty(len(part), dtype=bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            parts.append(part if keep.all() else part[keep])
            sizes[d + 1] = len(parts[-1])
    return np.concatenate(parts) if parts else values[:0], np.cumsum(sizes)
