"""Vectorised word hashing over Arrow text columns (numpy, whole batches at a time)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Words of more bytes are hashed by XXH3: a polynomial modulo 2^64 has known collisions of words of some 1024 letters.
LONG_WORD = 48
#: Bytes hashed in one numpy pass; bounds the working arrays whatever the length of a text.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_TABLE = _LOWER.tobytes()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
SPACES = b" \t\n\x0b\x0c\r"
_pows: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length()) + 1
    if size not in _pows:
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for b in (_BASE, inverse):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if len(_pows) > 2:
            _pows.clear()
        _pows[size] = (made[0], made[1])
    return _pows[size]


def words_of_bytes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII whitespace, A-Z lower-cased) of texts laid end to end in `data`.

    bounds: start of each text and the end of the last. Returns hash, start, end of each word and the number of words of each text.
    """
    n = len(data)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U64), empty, empty, np.zeros(len(bounds) - 1, dtype=np.int64)
    low = _LOWER[data]
    word = ~_SPACE[low]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[(bounds < n) & (bounds >= 0)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends_at = bounds[(bounds > 0) & (bounds <= n)] - 1
    last[ends_at] = word[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((low.astype(U64) + U64(1)) * power[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(low[starts[k] : ends[k]])
    counts = np.diff(np.searchsorted(starts, bounds))
    return h, starts, ends, counts


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column laid end to end, and the bounds of its rows (a null is empty)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes: (first row, last row + 1, bytes, bounds). A longer row comes alone and whole."""
    data, bounds = buffers(column)
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a run of rows and the word count of each; a long single row is cut at whitespace so that memory stays bounded."""
    if len(data) <= 2 * PIECE or len(bounds) > 2:
        h, _, _, counts = words_of_bytes(data, bounds)
        return h, counts
    parts = [words_of_bytes(data[a:b], np.array([0, b - a]))[0] for a, b in cuts(data)]
    h = np.concatenate(parts)
    return h, np.array([len(h)])


def cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about PIECE bytes of one text that end before whitespace (or at its end)."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + PIECE)
        while b < n:
            gap = np.flatnonzero(_SPACE[data[b : b + PIECE]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(n, b + PIECE)
        yield a, b
        a = b


def shingle_hashes(h: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words in each text; a shorter text with words is one run of all of them.

    Returns the hashes and the index of the text each belongs to.
    """
    n = len(h)
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the end of the text
    value = np.zeros(n, dtype=U64)
    seed = U64(0xD6E8FEB86659FD93)
    for k in range(size):
        shifted = np.zeros(n, dtype=U64)
        if k < n:
            shifted[: n - k] = h[k:]
        value = np.where(left > k, mix(value * seed + shifted), value)
    position = np.arange(n) - np.repeat(ends - counts, counts)
    keep = (left >= size) | (position == 0)
    return value[keep], doc[keep]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
