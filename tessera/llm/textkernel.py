"""Vectorised text kernels over Arrow string batches: slicing by bytes, words, word hashes, shingle sets.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, A-Z lower-cased.
Everything works on whole texts; slices only bound how many documents are in memory together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 15

_is_sep = np.zeros(256, dtype=bool)
_is_sep[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def scatter(x: np.ndarray) -> np.ndarray:
    """One round of mixing, in place: enough for polynomial hashes of short spans, at a third of mix's cost."""
    x ^= x >> U64(32)
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct elements, sorted: by sorting, which is far faster here than the hashing that np.unique does."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


_byte_value = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: Values of the bytes as they are, and with A-Z lower-cased.
exact_value = _byte_value.copy()
_byte_value[65:91] = _byte_value[97:123]
_BASE = U64(0x9DDFEA08EB382D69)
_BASE_INVERSE = U64(pow(0x9DDFEA08EB382D69, -1, 1 << 64))
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES * 2)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def inverse_powers(n: int) -> np.ndarray:
    return _power_tables(n)[1][:n]


def prefix_hash(data: np.ndarray, values: np.ndarray = _byte_value) -> np.ndarray:
    """S with S[j] - S[i] = sum of value(data[k]) * BASE**k for i <= k < j, modulo 2**64."""
    power, _ = _power_tables(len(data))
    out = np.empty(len(data) + 1, dtype=U64)
    out[0] = 0
    # in place: eight bytes for each byte of text, and no more
    np.take(values, data, out=out[1:], mode="clip")
    out[1:] *= power[: len(data)]
    np.cumsum(out[1:], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], whatever their place."""
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len + 1 offsets from 0; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of the batches with about `limit` bytes of text and SLICE_ROWS rows each at most, one row at least; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        _, at = text_buffers(texts)
        first = 0
        while first < len(texts):
            last = min(max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1), first + SLICE_ROWS)
            yield batch.slice(first, last - first)
            first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the documents data[at[i]:at[i+1]], and the len + 1 offsets of each document's words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_is_sep[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of each document, and the offsets of each document's words."""
    start, end, first = words(data, at)
    return span_hash(prefix_hash(data), start, end), first


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct hashes of `size` consecutive words; with fewer words, the whole sequence as one; without words, none."""
    hashes, first = word_hashes(data, at)
    count = np.diff(first)
    key = mix(hashes + U64(size))
    joint = np.zeros(max(0, len(key) - size + 1), dtype=U64)
    for k in range(size if len(joint) else 0):
        joint = joint * U64(0xC2B2AE3D27D4EB4F) + key[k : k + len(joint)]
    joint = mix(joint)
    out = []
    for i, n in enumerate(count.tolist()):
        a = int(first[i])
        if n >= size:
            out.append(distinct(joint[a : a + n - size + 1]))
        elif n:
            x = U64(n)
            with np.errstate(over="ignore"):
                for h in mix(hashes[a : a + n] + U64(n)):
                    x = x * U64(0xC2B2AE3D27D4EB4F) + h
            out.append(mix(np.array([x], dtype=U64)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out
