"""Any number of rule boxes against rows through bitmaps: no join, no shuffle, no key that can run hot.

A column's values are cut into cells.  For each column and cell a bitmap says which rules may hold there;
a row's candidates are the AND of its columns' bitmaps, and each candidate is verified on the values
themselves.  Rules are taken in blocks, so a task holds bitmaps of one block size whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

c = F.col
#: Rules in a block, cells of a column, rows taken at once, and conditions that one broadcast may hold.
BLOCK, CELLS, ROWS, MOST = 8192, 64, 2048, 4_000_000


@dataclass
class RuleIndex:
    """Conditions in order of rule, and for each block of rules the bitmaps by column and cell."""

    names: pa.Array
    columns: list[str]
    cuts: list[np.ndarray]
    begin: np.ndarray
    column: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def bitmaps(self, first: int, last: int) -> list[np.ndarray]:
        """Per column (cells + 1, words): bit r of a cell says that rule first + r may hold there; the last row is for missing values."""
        words = -(-(last - first) // 64)
        span = slice(self.begin[first], self.begin[last])
        rule = np.repeat(np.arange(last - first), np.diff(self.begin[first: last + 1]))
        out = []
        for k, cuts in enumerate(self.cuts):
            may = np.arange(words * 64) < np.full((len(cuts) + 2, 1), last - first)
            mine = self.column[span] == k
            cell = np.arange(len(cuts) + 1)[:, None]
            low, high = np.searchsorted(cuts, self.lo[span][mine]), np.searchsorted(cuts, self.hi[span][mine])
            with np.errstate(invalid="ignore"):
                empty = ~(self.lo[span][mine] <= self.hi[span][mine])
            for j, r in enumerate(rule[mine].tolist()):
                may[:-1, r] &= (cell[:, 0] >= low[j]) & (cell[:, 0] <= high[j]) & ~empty[j]
            may[-1, np.unique(rule[mine])] = False
            out.append(np.packbits(may, axis=1, bitorder="little").view(np.uint64))
        return out

    def verified(self, values: np.ndarray, row: np.ndarray, rule: np.ndarray) -> np.ndarray:
        """Which (row, rule) pairs hold on the values themselves."""
        count = self.begin[rule + 1] - self.begin[rule]
        pair = np.repeat(np.arange(len(rule)), count)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + self.begin[rule][pair]
        v = values[self.column[at], row[pair]]
        with np.errstate(invalid="ignore"):
            wrong = ~((v >= self.lo[at]) & (v <= self.hi[at]))
        return np.bincount(pair[wrong], minlength=len(rule)) == 0


def candidates(found: list[np.ndarray], cells: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, rule in the block) of the bits left; rows in a cell without a rule are dropped first, and only words with a bit are unpacked."""
    live = np.flatnonzero(np.logical_and.reduce([some.any(axis=1)[cell] for some, cell in zip(found, cells, strict=True)]))
    bits = found[0][cells[0][live]]
    for some, cell in zip(found[1:], cells[1:], strict=True):
        bits &= some[cell[live]]
    row, word = np.nonzero(bits)
    at, bit = np.nonzero(np.unpackbits(bits[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return live[row[at]], word[at] * 64 + bit


def _matcher(shared, fields: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: RuleIndex = shared.value
        rules = len(index.names)
        blocks = [(a, min(a + BLOCK, rules)) for a in range(0, rules, BLOCK)]
        maps = {block: index.bitmaps(*block) for block in blocks} if len(blocks) * BLOCK <= 1 << 16 else {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                values = np.stack([pc.cast(batch.column(n), pa.float64()).to_numpy(zero_copy_only=False).astype(float) for n in index.columns])
                cells = [np.where(np.isnan(v), len(cuts) + 1, np.searchsorted(cuts, v)) for v, cuts in zip(values, index.cuts, strict=True)]
                for block in blocks:
                    row, rule = candidates(maps.get(block) or index.bitmaps(*block), cells)
                    rule = rule + block[0]
                    for begin in range(0, len(row), 1 << 20):
                        r, q = row[begin: begin + (1 << 20)], rule[begin: begin + (1 << 20)]
                        good = index.verified(values, r, q)
                        if good.any():
                            r, q = r[good], q[good]
                            for part in range(0, len(r), 10_000):
                                rows = batch.select(fields).take(pa.array(r[part: part + 10_000]))
                                yield pa.RecordBatch.from_arrays([*rows.columns, index.names.take(pa.array(q[part: part + 10_000]))], schema=schema)
    return run


def match_by_bitmaps(frame: DataFrame, rules: DataFrame, cells: int = CELLS, most: int = MOST) -> DataFrame:
    """Every (row, rule) pair whose conditions (rule_id, column, lo, hi) all hold; adds `rule_id` to the row.

    All columns named must be in `frame`; missing values and NaN hold nothing.  The cells are
    approximate quantiles, which only decide how many candidates are verified.  One pass over `frame` for
    each `most` conditions; the rules of a pass are broadcast, at 20 bytes a condition.
    """
    spark = frame.sparkSession
    names = sorted(r["column"] for r in rules.select("column").distinct().collect())
    schema = StructType([*frame.schema.fields, StructField("rule_id", StringType())])
    conditions = rules.count()
    if not conditions:
        return spark.createDataFrame([], schema)
    steps = [i / cells for i in range(1, cells)]
    edges = frame.agg(*[F.percentile_approx(F.nanvl(c(n).cast("double"), F.lit(None)), steps).alias(n) for n in names]).first()
    cuts = [np.unique(np.array(edges[n] or [], dtype=float)) for n in names]
    passes, arrow = -(-conditions // most), to_arrow_schema(schema)
    out = None
    for k in range(passes):
        part = rules if passes == 1 else rules.filter(F.pmod(F.xxhash64("rule_id"), F.lit(passes)) == k)
        shared = spark.sparkContext.broadcast(build_index(part.select(c("rule_id").cast("string").alias("rule_id"), "column", "lo", "hi").toArrow(), names, cuts))
        found = frame.mapInArrow(_matcher(shared, frame.columns, arrow), schema)
        out = found if out is None else out.unionByName(found)
    return out


def build_index(table: pa.Table, columns: Sequence[str], cuts: list[np.ndarray]) -> RuleIndex:
    """The index of conditions (rule_id, column, lo, hi); a missing bound makes a condition that never holds."""
    table = table.sort_by("rule_id").combine_chunks()
    ids = table.column("rule_id").to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, dtype=np.int64)
    place = {n: k for k, n in enumerate(columns)}
    number = lambda name: pc.cast(table.column(name), pa.float64()).to_numpy(zero_copy_only=False).astype(float)
    return RuleIndex(pa.array(ids[heads], pa.string()), list(columns), cuts, np.append(heads, len(ids)), np.array([place[x] for x in table.column("column").to_pylist()], dtype=np.int32), number("lo"), number("hi"))
