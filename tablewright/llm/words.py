"""Words, shingles and hashes of whole texts, computed on Arrow batches inside tasks.

A batch of texts is one byte array with offsets. Word bounds come from a table of separator
bytes; the hash of any byte range comes from one prefix sum, so no word becomes a Python
object. All hashes are 64 bits and depend on the bytes alone, hence a repeated task
computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = b" \t\n\x0b\x0c\r"
#: Texts are looked at in pieces of about so many bytes (one text is never divided).
PIECE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all of its bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_table = np.arange(256, dtype=np.uint64)
_BYTE_VALUES = mixed(_table + np.uint64(0x5851F42D4C957F2D))
_LOWERED = _BYTE_VALUES.copy()
_LOWERED[65:91] = _BYTE_VALUES[97:123]
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0 .. P^n and their inverses, kept for the next batch."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        _powers[:] = []
        for base in (_P, _P_INV):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def hash_prefix(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums from which `range_hash` takes the hash of any byte range."""
    powers, _ = _powers_to(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_LOWERED if lower else _BYTE_VALUES)[data] * powers[: len(data)], out=sums[1:])
    return sums


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), the length included."""
    _, inverse = _powers_to(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _P)


def is_separator(separators: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = True
    return table


_BLANK = is_separator(BLANKS)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each text begins (missing: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """Words of some texts: byte bounds, hashes, and the first word of each text (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = True) -> np.ndarray:
        return range_hash(hash_prefix(self.data, lower), self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: pa.Array, separators: np.ndarray = _BLANK) -> Words:
    data, offsets = bytes_of(texts)
    inside = ~separators[data] if len(data) else np.zeros(0, bool)
    begins, stops = inside.copy(), inside.copy()
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(data):
        begins[1:] &= ~inside[:-1]
        begins[cuts] = inside[cuts]
        stops[:-1] &= ~inside[1:]
        stops[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text, and where those of each text begin; a
    text with 1 to k - 1 words gives its whole sequence as one. In order of place.
    """
    n = np.diff(first)
    steps = [_P ** np.uint64(j + 1) for j in range(k)]
    got = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(got)))
    rolled = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
    for j, step in enumerate(steps):
        rolled += hashes[j : j + len(rolled)] * step
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], got)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return mixed(rolled[at]), bounds
    total = rolled[np.minimum(at, max(0, len(rolled) - 1))] if len(rolled) else np.zeros(len(at), np.uint64)
    for t in short:
        own = np.zeros(1, dtype=np.uint64)
        for j in range(n[t]):
            own += hashes[first[t] + j : first[t] + j + 1] * steps[j]
        total[bounds[t]] = own[0] + np.uint64(n[t])
    return mixed(total), bounds


def sorted_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted, without repeats."""
    hashes = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return hashes[new], np.concatenate(([0], np.cumsum(new)))[bounds]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `size` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        group = np.cumsum(lengths, dtype=np.int64) // size
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of a numeric array as one binary value each; bounds has one more than there are runs."""
    raw = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1,
        [None, pa.py_buffer((bounds * raw.dtype.itemsize).astype(np.int64)), pa.py_buffer(raw)],
    ).cast(pa.binary())


def runs(values: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of `binary`."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = pc.fill_null(values.cast(pa.large_binary()), b"")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].tobytes() if data is not None and data.size else b""
    return np.frombuffer(raw, dtype=dtype), (at - at[0]) // size
