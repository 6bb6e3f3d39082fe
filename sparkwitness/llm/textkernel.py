"""Vectorised byte and word kernels shared by the corpus operators.

Everything works on whole Arrow batches: the UTF-8 bytes of many texts lie in
one buffer and NumPy handles them together, so there is no per-row Python cost
for hashing.  Chunks are bounded in bytes (a text longer than the bound is a
chunk of its own), hence memory follows the longest text, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one round of NumPy calls.
CHUNK_BYTES = 1 << 20

#: Word length of the shingles used by all near-duplicate operators.
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15
_MASK64 = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_U64 = np.uint64

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Powers of the hash base are kept for one block and for the block numbers.
_BLOCK_BITS = 16
_BLOCK = 1 << _BLOCK_BITS


def _powers(base: int, count: int) -> np.ndarray:
    """base**0 to base**(count - 1) modulo 2**64."""
    t = np.full(count, _U64(base & _MASK64))
    t[0] = 1
    return np.multiply.accumulate(t)


_SMALL, _SMALL_INV = _powers(_BASE, _BLOCK), _powers(_BASE_INV, _BLOCK)
_STEP_BASE, _STEP_INV = pow(_BASE, _BLOCK, 1 << 64), pow(_BASE_INV, _BLOCK, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that every bit of the result is usable."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(27)
    h *= _U64(0x94D049BB133111EB)
    h ^= h >> _U64(31)
    return h


class RollingHash:
    """Polynomial hashes (mod 2**64) of any substring of a byte buffer; 8 bytes of memory a byte."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        blocks = self.n // _BLOCK + 1
        power, self.inverse = _powers(_STEP_BASE, blocks), _powers(_STEP_INV, blocks)
        self.prefix = np.zeros(self.n + 1, _U64)
        for j in range(blocks):
            part = data[j * _BLOCK : (j + 1) * _BLOCK].astype(_U64)
            part += _U64(1)
            part *= _SMALL[: len(part)]
            own = self.prefix[j * _BLOCK + 1 : j * _BLOCK + 1 + len(part)]
            np.cumsum(part, out=own)
            own *= power[j]
            own += self.prefix[j * _BLOCK]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair; equal bytes give equal hashes."""
        out = self.prefix[end] - self.prefix[start]
        out *= _SMALL_INV[start & (_BLOCK - 1)]
        out *= self.inverse[start >> _BLOCK_BITS]
        return out

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of the given width."""
        count = self.n - width + 1
        if count <= 0:
            return np.zeros(0, _U64)
        out = self.prefix[width:] - self.prefix[:count]
        for j in range((count - 1) // _BLOCK + 1):
            own = out[j * _BLOCK : (j + 1) * _BLOCK]
            own *= _SMALL_INV[: len(own)]
            own *= self.inverse[j]
        return out


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column as one uint8 buffer, and n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets - first


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes together (one row at least)."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of a chunk (offsets start at 0)."""
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    here, before = solid[1:], solid[:-1]
    start = np.flatnonzero(here & (~before | edge))
    end = np.flatnonzero(before & (~here | edge))
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each A-Z-lower-cased word of a chunk, and its row."""
    start, end, row = word_spans(data, offsets)
    roll = RollingHash(_LOWER[data])
    return mix(roll.spans(start, end)), row


_STEP = [_U64((0xD6E8FEB86659FD93 * (2 * i + 1)) & _MASK64) for i in range(64)]


def gram_hashes(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of one text, and their rows."""
    if len(words) < k:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    n = len(words) - k + 1
    total = np.full(n, _U64((k * 0x632BE59BD9B4E019) & _MASK64))
    for i in range(k):
        total += words[i : i + n] * _STEP[i]
        if i % 2:
            total ^= total >> _U64(29)
    inside = row[:n] == row[k - 1 :]
    return mix(total[inside]), row[:n][inside]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text of a chunk its sorted set of k-word shingle hashes.

    A text of fewer words has the whole sequence as its one shingle; a text
    without words has the empty set.
    """
    words, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    hashes, owner = gram_hashes(words, row, k)
    cut = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    first = np.concatenate(([0], np.cumsum(count)))
    out = []
    for i in range(n):
        if count[i] >= k:
            out.append(np.unique(hashes[cut[i] : cut[i + 1]]))
        elif count[i]:
            own = words[first[i] : first[i + 1]]
            out.append(gram_hashes(own, np.zeros(len(own), np.int64), len(own))[0])
        else:
            out.append(np.zeros(0, _U64))
    return out


def chunked_sets(column: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and shingle sets of each chunk of a string column."""
    data, offsets = text_buffers(column)
    for a, b in chunks(offsets):
        lo, hi = offsets[a], offsets[b]
        yield a, shingle_sets(data[lo:hi], offsets[a : b + 1] - lo, k)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
