"""Vectorised text primitives shared by the training-data operators.

Arrow string columns hold all texts of a batch in one buffer, so words are found and hashed for
thousands of documents with a handful of numpy operations and no per-word Python objects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; a longer text makes a piece of its own.
PIECE_BYTES = 2 << 20
#: Longest span that is hashed limb by limb; longer ones are hashed by BLAKE2b.
LIMBS = 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_STEP = _rng.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
_LIMB = _rng.integers(1, 2**64, LIMBS, dtype=U64)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def fold_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def is_space_separated() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    return table


def is_alnum() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


FOLD, SPACED, ALNUM = fold_ascii(), is_space_separated(), is_alnum()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each piece holds about ``size`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(buffers(batch.column(column))[1])
        total, begin = 0, 0
        if lengths.sum() <= size:
            yield batch
            continue
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += n
        yield batch.slice(begin)


class Words:
    """Words of all texts of a piece: byte spans, owning row, 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACED, fold: np.ndarray = FOLD):
        self.rows = len(offsets) - 1
        folded = fold[raw]
        self.folded = folded
        inside = word[folded]
        n = len(raw)
        if n:
            before = np.empty(n, bool)
            before[0] = False
            before[1:] = inside[:-1]
            heads = offsets[:-1][offsets[:-1] < n]
            before[heads] = False
            after = np.empty(n, bool)
            after[-1] = False
            after[:-1] = inside[1:]
            after[offsets[1:][offsets[1:] > 0] - 1] = False
            self.starts = np.flatnonzero(inside & ~before)
            self.ends = np.flatnonzero(inside & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        #: words of row r are first[r]:first[r + 1]
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.folded, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes anywhere.

    A span is cut into limbs of eight bytes. Each limb goes through a mixer of its own before they are summed, so
    repetitive words are as far apart as any others: two different spans meet with a chance of about 2**-63.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    limbs = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = ends - starts
    out = size.astype(U64) * _STEP[63] + mix((limbs[starts] & _MASK[np.minimum(size, 8)]) + _LIMB[0])
    more = np.flatnonzero((size > 8) & (size <= 8 * LIMBS))
    for j in range(1, LIMBS):
        left = size[more] - 8 * j
        out[more] += mix((limbs[starts[more] + 8 * j] & _MASK[np.minimum(left, 8)]) + _LIMB[j])
        more = more[left > 8]
        if not len(more):
            break
    for w in np.flatnonzero(size > 8 * LIMBS):
        out[w] = int.from_bytes(hashlib.blake2b(data[starts[w] : ends[w]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def gram_hashes(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of k words inside one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = np.flatnonzero(words.row[:n] == words.row[k - 1 :])
    total = np.zeros(n, U64)
    for j in range(k):
        total += hashes[j : j + n] * _STEP[j]
    return mix(total[inside] + U64(k)), inside


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed longs with the same bits."""
    return np.ascontiguousarray(x).view(np.int64)
