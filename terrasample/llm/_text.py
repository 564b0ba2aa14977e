"""Word and shingle hashes of whole texts, vectorised over Arrow batches.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D) after lower-casing A-Z. Shingles are compared by
64-bit hashes: two different shingles of a corpus of n share one with a chance of n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time, for which a worker keeps tables of 32 bytes each; longer only if a single word is.
CHUNK = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts (one more offset than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of the first word of each text (one more than texts)."""
    return words_at(data, offsets)[:2]


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words``, and the byte that each word starts at."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] |= word[edge]
    start = np.flatnonzero(begins)
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[edge - 1] |= word[edge - 1]
    end = np.flatnonzero(ends) + 1
    out = np.empty(len(start), dtype=np.uint64)
    a = 0
    while a < len(start):  # whole words, CHUNK bytes or one word at a time
        b = max(a + 1, int(np.searchsorted(end, start[a] + CHUNK, side="right")))
        lo, hi = start[a], end[b - 1]
        up, down = _power_tables(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_CODE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out, np.searchsorted(start, offsets), start


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, and the first of each text. A text of fewer than k words,
    but at least one, has its whole sequence as one."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), dtype=np.uint64)
    if len(word) >= k:
        full = np.zeros(len(word) - k + 1, dtype=np.uint64) + np.uint64(k)
        for j in range(k):
            full = mix64(full ^ word[j : len(word) - k + 1 + j])
        long = n >= k
        pick = np.repeat(first[:-1][long] - at[:-1][long], count[long]) + _ranges(at[:-1][long], count[long])
        out[_ranges(at[:-1][long], count[long])] = full[pick]
    for i in np.flatnonzero((n > 0) & (n < k)):
        h = np.full(1, n[i], dtype=np.uint64)
        for w in word[first[i] : first[i + 1]]:
            h = mix64(h ^ w)
        out[at[i]] = h[0]
    return out, at


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    some = count > 0
    start, count = start[some], count[some]
    step = np.ones(total, dtype=np.int64)
    step[0] = start[0]
    step[np.cumsum(count)[:-1]] = start[1:] - start[:-1] - count[:-1] + 1
    return np.cumsum(step)


def shingle_hashes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*words(*text_bytes(column)), k)
