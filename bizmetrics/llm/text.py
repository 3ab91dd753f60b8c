"""Words and word hashes of whole Arrow batches, by array operations.

A batch is cut into chunks of whole documents (about ``CHUNK`` bytes; a longer document is
a chunk of its own). A word's hash mixes its eight-byte blocks one after the other, all words
of a chunk at a time; the rare long ones take a digest. Windows of words are differences of
one running polynomial sum over the words' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BLOCKS = 8  # eight-byte blocks up to which words are mixed; longer ones take a digest
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer on uint64 (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Poly:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand: for short runs
    of values that are hashes themselves (over raw bytes, long runs of two values that
    alternate in a certain order and their opposites would be equal for every base)."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, 1 << 63)) * 2 + 1 & _M
        self.inverse = pow(self.base, -1, 1 << 64)
        self.bytes = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self._up = self._down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if size > CHUNK:  # a very long document: do not keep its tables
                return up, down
            self._up, self._down = up, down
        return self._up, self._down

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hash of values[s:e] for each pair of bounds."""
        up, down = self.powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] ^ mix((ends - starts).astype(np.uint64)))


def _table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
BLANK = _table(b" \t\n\v\f\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_POLY: dict[int, Poly] = {}


def poly(seed: int) -> Poly:
    if seed not in _POLY:
        _POLY[seed] = Poly(seed)
    return _POLY[seed]


@dataclass
class Chunk:
    """Documents first..first+len(offsets)-1 of a batch: their bytes, end to end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    data, offsets = byte_column(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(column))
        own = data[offsets[first] : offsets[last]]
        yield Chunk(first, LOWER[own] if lower else own, offsets[first : last + 1] - offsets[first])
        first = last


def word_bounds(chunk: Chunk, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word."""
    n = len(chunk.data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = blank[chunk.data]
    inside = ~gap[1:-1]
    # A document starts and ends words, whatever stands beside it in the buffer.
    edge = np.zeros(n + 1, bool)
    edge[chunk.offsets] = True
    starts = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, chunk.offsets)


def word_hashes(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each run of bytes. Runs of one length up to eight never share them; hashes
    of different seeds are independent of each other."""
    salt = np.uint64(int.from_bytes(hashlib.blake2b(seed.to_bytes(8, "little"), digest_size=8).digest(), "little"))
    lengths = ends - starts
    padded = np.concatenate([chunk.data, np.zeros(8, np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded, (len(chunk.data) + 1, 8), (1, 1), writeable=False)

    def block(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return blocks[at].view("<u8").ravel() & _MASKS[np.minimum(left, 8)]

    out = mix(block(starts, lengths) ^ mix(lengths.astype(np.uint64) + salt)) if len(starts) else np.zeros(0, np.uint64)
    longer = np.flatnonzero(lengths > 8)
    for k in range(1, BLOCKS):
        if not len(longer):
            break
        own = block(starts[longer] + 8 * k, lengths[longer] - 8 * k)
        out[longer] = mix(out[longer] * np.uint64(0x9E3779B97F4A7C15) + mix(own ^ salt))
        longer = longer[lengths[longer] > 8 * (k + 1)]
    key = salt.tobytes()
    for i in longer.tolist():
        digest = hashlib.blake2b(chunk.data[starts[i] : ends[i]], digest_size=8, key=key).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words, also across documents: the caller masks."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - width + 1)
    return poly(seed).runs(words, at, at + width)


def window_mask(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """True where a window of ``width`` words lies within one document."""
    n = max(total - width + 1, 0)
    inside = np.zeros(n + 1, np.int64)
    counts = np.diff(first)
    own = counts >= width
    np.add.at(inside, first[:-1][own], 1)
    np.add.at(inside, (first[1:] - width + 1)[own], -1)
    return np.cumsum(inside[:n]) > 0
