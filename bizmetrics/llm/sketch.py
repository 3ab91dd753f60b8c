"""Count-min sketches built per partition and merged by Spark.

A sketch has ``rows`` lines of ``2**bits`` cells; a key adds to one cell of each line, and
the least of its cells never is below its count. Its size is fixed by these parameters, not
by the data: that is the bound of what is broadcast. Partitions send their cells in blocks,
sparse where few are set; blocks of a number meet in one task and are added as they stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bizmetrics.llm.shared import once
from bizmetrics.llm.text import mix

BLOCK_BITS = 16
_BLOCK = 1 << BLOCK_BITS
_SCHEMA = "block int, sparse boolean, cells binary"


@dataclass(frozen=True)
class Shape:
    bits: int
    rows: int = 2
    # Counts above the limit stay there; all that is asked for must lie at or below it.
    limit: int = (1 << 32) - 1

    def cells(self, keys: np.ndarray) -> np.ndarray:
        """Cell numbers of the keys: one line of the result for each line of the sketch."""
        out = np.empty((self.rows, len(keys)), np.int64)
        for r in range(self.rows):
            salt = np.uint64(0x9E3779B97F4A7C15 * (2 * r + 1) & (1 << 64) - 1)
            out[r] = (mix(keys ^ salt) >> np.uint64(64 - self.bits)).astype(np.int64) + (r << self.bits)
        return out

    @property
    def dtype(self):
        return np.uint8 if self.limit < 1 << 8 else np.uint16 if self.limit < 1 << 16 else np.uint32

    @property
    def size(self) -> int:
        return self.rows << self.bits


def _pack(counts: np.ndarray) -> tuple[bool, bytes]:
    at = np.flatnonzero(counts)
    if len(at) * (2 + counts.itemsize) < counts.nbytes:
        return True, at.astype("<u2").tobytes() + counts[at].tobytes()
    return False, counts.tobytes()


def _unpack(sparse: bool, cells: bytes, dtype) -> tuple[np.ndarray | slice, np.ndarray]:
    if not sparse:
        return slice(None), np.frombuffer(cells, dtype)
    n = len(cells) // (2 + np.dtype(dtype).itemsize)
    return np.frombuffer(cells, "<u2", n).astype(np.int64), np.frombuffer(cells, dtype, n, 2 * n)


def _rows(blocks: dict[int, tuple[bool, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(blocks), pa.int32()),
            pa.array([s for s, _ in blocks.values()], pa.bool_()),
            pa.array([c for _, c in blocks.values()], pa.binary()),
        ],
        names=["block", "sparse", "cells"],
    )


def _merged(
    df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], shape: Shape,
    finish: Callable[[np.ndarray], tuple[bool, bytes]],
) -> Iterator[tuple[int, bool, bytes]]:
    """Blocks of the merged sketch, each as ``finish`` makes it from its counts."""
    if shape.bits < BLOCK_BITS:
        raise ValueError(f"a sketch line has {_BLOCK} cells or more")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(shape.size, shape.dtype)
        for batch in batches:
            for some in keys(batch):
                for cells in shape.cells(some):
                    at, n = np.unique(cells, return_counts=True)
                    table[at] = np.minimum(table[at].astype(np.int64) + n, shape.limit)
        for b in range(shape.size >> BLOCK_BITS):
            own = table[b << BLOCK_BITS : (b + 1) << BLOCK_BITS]
            if own.any():
                yield _rows({b: _pack(own)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, sparse, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(b, np.zeros(_BLOCK, np.uint32))
                at, n = _unpack(sparse, cells, shape.dtype)
                total[at] = np.minimum(total[at].astype(np.int64) + n, shape.limit)
        for b, total in sums.items():
            yield _rows({b: finish(total.astype(shape.dtype))})

    # As many rows as the sketch has blocks, whatever the input.
    with once(df.sparkSession):
        merged = df.mapInArrow(build, _SCHEMA).repartition("block").mapInArrow(merge, _SCHEMA).toArrow()
    for batch in merged.to_batches():
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def count(
    df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], shape: Shape
) -> np.ndarray:
    """Cells of all keys that ``keys`` yields (arrays of uint64) over the batches of ``df``."""
    table = np.zeros(shape.size, shape.dtype)
    for b, sparse, cells in _merged(df, keys, shape, _pack):
        at, n = _unpack(sparse, cells, shape.dtype)
        table[b << BLOCK_BITS : (b + 1) << BLOCK_BITS][at] = n
    return table


def estimate(table: np.ndarray, shape: Shape, keys: np.ndarray) -> np.ndarray:
    cells = shape.cells(keys)
    out = table[cells[0]]
    for line in cells[1:]:
        out = np.minimum(out, table[line])
    return out


class AtLeast:
    """Only whether an estimate is ``least`` or more: one bit a cell, for the broadcast."""

    def __init__(
        self, df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
        shape: Shape, least: int,
    ):
        self.shape, self.bits = shape, np.zeros(shape.size >> 3, np.uint8)
        width = _BLOCK >> 3
        for b, _, cells in _merged(df, keys, shape, lambda n: (False, np.packbits(n >= least).tobytes())):
            self.bits[b * width : (b + 1) * width] = np.frombuffer(cells, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for cells in self.shape.cells(keys):
            out &= (self.bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return out
