"""All pairs of rows, block against block.

A block travels as one packed row, so what is moved grows with the number of blocks, which is small, and not
with that of their pairs.  A task unpacks two blocks and compares them tile by tile in bounded memory,
giving off the pairs of each tile as it goes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

c = F.col
#: Rows of a tile, and columns that are filled at once.
TILE, WIDE = 1024, 2048
#: Numbers that a side keeps filled in between its tiles.
HELD = 1 << 24


def least_blocks(spark: SparkSession, rows: int) -> float:
    """Blocks whose pairs keep all cores busy, as long as a block fills a tile."""
    return min(math.sqrt(8 * spark.sparkContext.defaultParallelism), rows / TILE)


def packed(rows: DataFrame, *block: str) -> DataFrame:
    """One row per block: its columns `block` and all the others' rows as `_rows`, compressed."""
    kind = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in block)

    def pack(table: pa.Table) -> pa.Table:
        sink, inner = pa.BufferOutputStream(), table.drop_columns(list(block)).combine_chunks()
        with pa.ipc.new_stream(sink, inner.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(inner)
        return table.select(block).slice(0, 1).append_column("_rows", pa.array([sink.getvalue().to_pybytes()], pa.binary()))

    return cut_lineage(rows.groupBy(*block).applyInArrow(pack, f"{kind}, _rows binary"))


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all().combine_chunks()


Meet = Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]]


def met_blocks(left: DataFrame, right: DataFrame, meet: Meet, schema: str, pairs: int, *more: str) -> DataFrame:
    """What `meet` finds in each pair of blocks; `left` and `right` have (`more`, _i, _j, _rows), `right` without the pairs of a block and itself."""
    rows = left.select(*more, "_i", "_j", F.lit(0).alias("_side"), "_rows").unionByName(right.select(*more, "_i", "_j", F.lit(1).alias("_side"), "_rows"))
    keys = [*more, "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {}
        for batch in batches:
            for side, block in zip(batch["_side"].to_pylist(), batch["_rows"]):
                sides[side] = unpacked(block.as_buffer())
        yield from meet(sides[0], sides.get(1, sides[0]), 1 not in sides)

    # More partitions than pairs, so that few tasks get two large ones.
    spark = left.sparkSession
    parts = max(min(4 * pairs, 64 * spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, schema)


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what is true in a matrix with little of it; its width is a multiple of 8."""
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    word, bit = np.nonzero(mask.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + bit, mask.shape[1])


class Rows:
    """Rows of few entries (row, column, value), in an order of their own, filled into tiles on demand."""

    def __init__(self, offsets: np.ndarray, column: np.ndarray, value: np.ndarray, order: np.ndarray, columns: int, base: np.ndarray | None = None):
        held = np.diff(offsets)[order]
        self.begin = np.concatenate([[0], np.cumsum(held)])
        entry = np.repeat(offsets[:-1][order] - self.begin[:-1], held) + np.arange(self.begin[-1])
        self.row, self.column, self.value = np.repeat(np.arange(len(order)), held), column[entry], value[entry]
        self.base, self.columns, self.count, self.kept = base, columns, len(order), {}

    def tile(self, start: int, begin: int = 0, dtype: type = np.float32) -> np.ndarray:
        """Rows from `start` on and columns from `begin` on, `TILE` x `WIDE` at most, filled up to a multiple of eight rows; `base` stands where no entry is."""
        if (found := self.kept.get((start, begin, dtype))) is not None:
            return found
        stop, width = min(start + TILE, self.count), min(WIDE, self.columns - begin)
        out = np.zeros((-(-(stop - start) // 8) * 8, width), dtype=dtype)
        if self.base is not None:
            out[: stop - start] = self.base[start:stop, None]
        part = slice(self.begin[start], self.begin[stop])
        row, column, value = self.row[part] - start, self.column[part], self.value[part]
        if self.columns > WIDE:
            here = (column >= begin) & (column < begin + width)
            row, column, value = row[here], column[here] - begin, value[here]
        out[row, column] = value
        if dtype is np.float32 and self.count * self.columns <= HELD:
            self.kept[start, begin, dtype] = out
        return out

    def size(self, start: int) -> int:
        return min(TILE, self.count - start)

    def starts(self) -> range:
        return range(0, self.count, TILE)

    def chunks(self) -> range:
        return range(0, max(self.columns, 1), WIDE)
