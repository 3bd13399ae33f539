"""Best-fit packing with several permitted sequence lengths.

Documents are cut into pieces of at most the greatest length.  Pieces are dealt by a hash into
lots of bounded size, and each lot is packed on its own, longest piece first: a piece goes to
the open sequence it leaves least room in; if it fits in none, each size is filled in thought
from the lengths still to come and the one of least cost per filled token is opened.  At the
end each sequence shrinks to the least permitted length that holds its contents.  Only ids and lengths move.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.store import store
from tickloom.llm.text import BLANK, Words, slices

SIZES = (256, 512, 1024, 2048, 4096)
#: Pieces in a lot: hundreds of sequences even of the greatest length, seconds of work.
LOT = 25_000
#: Heaps in which equal pieces are counted.
SALTS = 64
#: Cost of a sequence: its length plus the square over this (attention), in tokens.
ATTENTION = 16_384


def cost(size: int) -> float:
    return size + size * size / ATTENTION


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each piece; every length is from 1 to the greatest size.

    Pieces are taken from the longest, ties in the given order.  A new sequence of size s is
    charged the cost of the least size that holds what the lengths still to come can put into
    it, per token of that; of equal charges the larger size wins.
    """
    sizes = sorted(sizes)
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    kinds, counts = np.unique(lengths, return_counts=True)
    kinds, counts = kinds.tolist(), counts.tolist()

    def filled_by(n: int, size: int) -> int:
        """Tokens in a sequence of `size` that begins with a piece of n, longest fitting pieces next."""
        left, k = size - n, bisect_right(kinds, n) - 1
        while left and k >= 0:
            k = min(k, bisect_right(kinds, left) - 1)
            if k >= 0:
                left -= kinds[k] * min(counts[k], left // kinds[k])
                k -= 1
        return size - left

    def charge(n: int, size: int) -> float:
        used = filled_by(n, size)
        return cost(sizes[bisect_left(sizes, used)]) / used

    room: list[int] = []
    stacks: dict[int, list[int]] = {}
    used: list[int] = []
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        counts[bisect_left(kinds, n)] -= 1
        k = bisect_left(room, n)
        if k < len(room):
            left = room[k]
            b = stacks[left].pop()
            if not stacks[left]:
                del stacks[left]
                room.pop(k)
        else:
            # Later pieces are no longer than this one: only they can fill what is left.
            size = min((s for s in sizes if s >= n), key=lambda s: (charge(n, s), -s))
            b, left = len(used), size
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left -= n
        if left:
            if left not in stacks:
                stacks[left] = []
                insort(room, left)
            stacks[left].append(b)
    filled = np.array(used, dtype=np.int64)
    capacity = np.array(sizes, dtype=np.int64)[np.searchsorted(sizes, filled)] if len(filled) else filled
    return bins, offsets, capacity[bins] if len(filled) else bins


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = np.diff(Words(part.column("text"), BLANK).first) + 1
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64())], names=["id", "tokens"])
    return run


def _packed(sizes: Sequence[int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "spread", "id", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, capacity = pack(rows.n_tokens.to_numpy(), sizes)
        return rows.assign(bin=bins, bin_offset=offsets, capacity=capacity)[["id", "piece", "first_token", "n_tokens", "lot", "bin", "bin_offset", "capacity"]]
    return run


def _numbered(pieces: DataFrame) -> DataFrame:
    """Add `turn`: the number of a piece among equal ones, so that copies part and partitions do not matter.

    Equal pieces are counted in heaps by `salt` first: no task numbers more than one heap of them.
    """
    before = Window.partitionBy("spread").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("spread", "salt").agg(F.count("*").alias("n"))
    again = sums.groupBy("spread").agg(F.sum("n").alias("all")).where("all > 1").select("spread")
    begins = sums.join(again, "spread", "left_semi").select("spread", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("spread", "salt").orderBy("piece"))
    return pieces.withColumn("own", inside).join(begins, ["spread", "salt"], "left").withColumn("turn", F.coalesce("begin", F.lit(0)) + F.col("own") - 1).drop("salt", "own", "begin")


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None, sizes: Sequence[int] = SIZES, lot: int = LOT) -> DataFrame:
    """One row per piece: its document and tokens, and the sequence (`lot`, `bin`), place in it and capacity.

    A document's tokens are its words and one end, or what `length_column` says (null or less
    than one: none, so no piece).  A null or empty text is a single end.  Repeated rows are
    packed each; rows with a null id are packed as well.  The placement depends on the rows alone:
    a lot is dealt by the hash of a piece and its number among equal pieces, not by partitions.  Other columns are ignored.
    """
    greatest = max(sizes)
    base = docs.select(F.col(id_column).alias("id"), *([F.col(length_column).cast("long").alias("tokens")] if length_column else [F.col(text_column).cast("string").alias("text")]))
    kind = base.schema["id"].dataType.simpleString()
    if not length_column:
        base = base.mapInArrow(_pieces(greatest), f"id {kind}, tokens long")
    base = base.where("tokens > 0")
    firsts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / greatest))
    pieces = base.select("id", "tokens", F.explode(firsts).alias("piece")).select(
        "id", "piece", (F.col("piece") * greatest).alias("first_token"), F.least(F.lit(greatest).cast("long"), F.col("tokens") - F.col("piece") * greatest).alias("n_tokens"))
    pieces = pieces.withColumns({"spread": F.xxhash64("id", "piece", F.lit(5)), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))})
    pieces = store(pieces, "pieces")
    lots = max(1, -(-pieces.count() // lot))
    dealt = _numbered(pieces).withColumn("lot", F.pmod(F.xxhash64("spread", "turn"), F.lit(lots)))
    out = dealt.groupBy("lot").applyInPandas(_packed(tuple(sizes)), f"id {kind}, piece long, first_token long, n_tokens long, lot long, bin long, bin_offset long, capacity long")
    return out.withColumnRenamed("id", id_column)
