"""Words of whole Arrow text columns as 64-bit hashes, without a Python loop over words.

A word is a run of bytes of one class; a table says the class and the value of
each byte (so folding of A-Z is a property of the table).  The hash of a run is a
polynomial over its byte values, read off prefix sums modulo 2**64, mixed with
the length at the end.  Texts are taken in slices of bounded size; a text is
never cut, so one very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a fixed bijection)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass(frozen=True)
class ByteTable:
    """Class (0: between words) and value of each of the 256 bytes."""

    classes: np.ndarray
    values: np.ndarray


def byte_table(fold: bool, split_marks: bool) -> ByteTable:
    """White space 0x09-0x0D and 0x20 separates; ``fold`` equates A-Z with a-z.

    With ``split_marks``, runs of other ASCII marks are words of their own.
    """
    classes = np.ones(256, np.uint8)
    classes[[9, 10, 11, 12, 13, 32]] = 0
    if split_marks:
        marks = [b for b in range(33, 127) if not chr(b).isalnum()]
        classes[marks] = 2
    values = mix(np.arange(1, 257, dtype=U64))
    if fold:
        values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return ByteTable(classes, values)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, U64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


class WordHasher:
    """Hashes words of one task; keeps the power tables between slices."""

    def __init__(self, table: ByteTable):
        self.table = table
        self.up = self.down = np.ones(1, U64)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and per row the index of its first word (one more at the end)."""
        n = len(data)
        if not n:
            return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
        if len(self.up) <= n:
            self.up, self.down = _powers(_BASE, max(n, SLICE_BYTES)), _powers(_INVERSE, max(n, SLICE_BYTES))
        classes = self.table.classes[data]
        change = np.empty(n + 1, bool)
        change[0] = change[n] = True
        np.not_equal(classes[1:], classes[:-1], out=change[1:n])
        change[bounds] = True
        edges = np.flatnonzero(change)
        inside = classes[edges[:-1]] != 0
        starts, ends = edges[:-1][inside], edges[1:][inside]
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum(self.table.values[data] * self.up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(_BASE))
        return hashes, np.searchsorted(starts, bounds)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds within the bytes); null texts are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row, end = 0, len(column)
    while row < end:
        to = int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, "right")) - 1
        to = min(max(to, row + 1), end)
        yield row, to, raw[bounds[row]:bounds[to]], (bounds[row:to + 1] - bounds[row]).astype(np.int64)
        row = to


def signed(x: np.ndarray) -> pa.Array:
    """Hashes as Spark longs."""
    return pa.array(x.view(np.int64))
