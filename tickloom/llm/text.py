"""Bytes of Arrow text columns as NumPy arrays: words, word hashes, shingles.

Everything works on UTF-8 bytes.  The separators of all word definitions used here are ASCII,
so a byte class decides and no text is decoded.  Hashes are 64 bits wide and do not depend on
the partitioning, the platform or the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
SAME = np.arange(256, dtype=np.uint8)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes inside any of the (first, last) ranges."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first: last + 1] = True
    return table


#: `[^\x20\x09-\x0D]+`
BLANK = byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
NOT_LETTER = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n; kept and grown by doubling."""
    size = len(_powers[0])
    while size <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * U(pow(base, size, 1 << 64))])
        size *= 2
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    up, down = _power_tables(len(data))
    summed = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], out=summed[1:])
    return mix((summed[ends] - summed[starts]) * down[starts])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[edges[0]: edges[-1]], edges - edges[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most `most` bytes of text, or one longer row.

    Working memory of the callers is a multiple of this, or of the longest single text.
    """
    if batch.num_rows == 0:
        return
    edges = column_bytes(batch.column(text))[1]
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """Words of consecutive texts: byte spans, index of the text of each, and hashes.

    `first[i]:first[i + 1]` are the words of text i.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray, case: np.ndarray = LOWER):
        raw, self.offsets = column_bytes(column)
        self.data = case[raw]
        inside = ~separators[self.data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        before[heads] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        tails = self.offsets[1:][self.offsets[1:] > 0] - 1
        after[tails] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.first[-1] = len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, hash) of each window of `width` words inside a text.

        A text with fewer words, but not none, has one window of all its words.
        """
        n, count = len(hashes), np.diff(self.first)
        mixed = np.zeros(max(0, n - width + 1), dtype=np.uint64)
        for k in range(width):
            mixed += hashes[k: n - width + 1 + k] * U(pow(_BASE, 2 * k + 3, 1 << 64)) if n >= width else mixed
        text = np.repeat(np.arange(len(count)), count)
        at = np.flatnonzero(text[: n - width + 1] == text[width - 1:]) if n >= width else np.zeros(0, dtype=np.int64)
        found = mix(mixed[at] + U(width))
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            rest = np.zeros(len(short), dtype=np.uint64)
            for k in range(width - 1):
                has = count[short] > k
                rest[has] += hashes[self.first[short[has]] + k] * U(pow(_BASE, 2 * k + 3, 1 << 64))
            found = np.concatenate([found, mix(rest + count[short].astype(np.uint64))])
            at = np.concatenate([at, self.first[short]])
            order = np.argsort(at, kind="stable")
            at, found = at[order], found[order]
        return text[at], at, found


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's LONG."""
    return x.view(np.int64)
