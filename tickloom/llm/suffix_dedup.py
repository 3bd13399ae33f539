"""Exact substring deduplication with a distributed, sampled suffix array.

Every string of `LENGTH` bytes is anchored at the least 32-byte gram inside it (by hash, the
leftmost of equal ones), so equal strings have their anchors at the same offset and only the
suffixes at anchors, one in some 185 bytes, need to be sorted.  A suffix can take part in a
match only if the 200 bytes after or before its anchor occur elsewhere; the others drop out
before any text moves.  The rest is partitioned by range on the leading bytes, with splitters
that Spark samples; each bucket is sorted by multikey quicksort.  A suffix's longest match to
the right is with a neighbour in that order, which rules out most strings; those left are
compared by hash together with their bytes before the anchor.  Equal leading bytes never lie in
two buckets, so no match crosses a border.

Anchors that more than `HOT` places share are not gathered in one bucket: their strings are
counted by hash with partial aggregation instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import partitions, store
from tickloom.llm.text import U, _power_tables, column_bytes, mix, signed, slices

LENGTH, GRAM = 400, 32
HOT = 50_000


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray] | None:
    """Anchors of one text: places, first and last start of the strings each one stands for, hashes; and starts repeated in the text.

    None if the text is too short.  If grams repeat so much that anchors crowd, strings that
    repeat inside the text are found at once, and anchors that stand for no first one drop out.
    """
    n = len(data)
    if n < length:
        return None
    sums, down = _prefix_sums(data)
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    bits = U(max(21, int(n).bit_length()))
    keys = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    width, count = length - gram + 1, n - length + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[width - 1: width - 1 + count])
    place = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    place, low, high = place[heads], heads, np.append(heads[1:], count) - 1
    repeated = np.zeros(0, dtype=np.int64)
    if len(place) > 20 + count // 60:
        strings = mix((sums[length:] - sums[:-length]) * down[:count])
        _, first, where, times = np.unique(strings, return_index=True, return_inverse=True, return_counts=True)
        repeated = np.flatnonzero(times[where] > 1)
        new = np.zeros(count + 1, dtype=np.int64)
        new[first + 1] = 1
        new = np.cumsum(new)
        keep = new[high + 1] > new[low]
        place, low, high = place[keep], low[keep], high[keep]
    half = length // 2
    right = np.where(place + half <= n, mix((sums[np.minimum(place + half, n)] - sums[place]) * down[place]), U(0))
    begin = np.maximum(place - half, 0)
    left = np.where(place >= half, mix((sums[place + gram] - sums[begin]) * down[begin]), U(0))
    return {"place": place, "low": low, "high": high, "gram": grams[place], "right": right, "left": left, "repeated": repeated}


def spans_of(starts: np.ndarray, length: int) -> list[list[int]]:
    """Maximal [begin, end) covered by strings of `length` at the given starts."""
    if not len(starts):
        return []
    starts = np.sort(starts)
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length], axis=1).tolist()


_LISTS = ["place", "low", "high", "gram", "right", "left"]


def _facts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, edges = column_bytes(part.column("text"))
                sha, own, lists = [], [], {c: [] for c in _LISTS}
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    sha.append(hashlib.sha256(data[a:b].tobytes()).hexdigest())
                    found = anchors(data[a:b], length)
                    own.append(spans_of(found["repeated"], length) if found else [])
                    for c in _LISTS:
                        values = found[c] if found else np.zeros(0, dtype=np.int64)
                        lists[c].append(values.view(np.int64) if values.dtype == np.uint64 else values)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists["place"]])]).astype(np.int32)
                nested = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists[c]) if lists[c] else [], pa.int64())) for c in _LISTS]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("k1"), part.column("k2"), pa.array(np.diff(edges), pa.int64()), pa.array(sha, pa.string()), pa.array(own, pa.list_(pa.list_(pa.int64()))), *nested],
                    names=["id", "k1", "k2", "n_bytes", "sha", "own", *_LISTS])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors whose right or left half occurs at another one; a partition has all anchors of its grams."""
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    keep = np.zeros(table.num_rows, dtype=bool)
    for side in ("right", "left"):
        values = table.column(side).to_numpy()
        _, where, times = np.unique(values, return_inverse=True, return_counts=True)
        keep |= (times[where] > 1) & (values != 0)
    yield from table.filter(pa.array(keep)).select(["gram", "k1", "k2", "place", "low", "high"]).to_batches(max_chunksize=50_000)


def _contexts(length: int):
    """The bytes around each anchor that its strings need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, edges = column_bytes(part.column("text"))
                rows: dict[str, list] = {c: [] for c in ("row", "gram", "place", "low", "high", "suffix", "prefix")}
                for i, found in enumerate(part.column("found").to_pylist()):
                    own = data[edges[i]: edges[i + 1]].tobytes()
                    for x in found:
                        rows["row"].append(i)
                        for c in ("gram", "place", "low", "high"):
                            rows[c].append(x[c])
                        rows["suffix"].append(own[x["place"]: x["high"] + length])
                        rows["prefix"].append(own[x["low"]: x["place"]])
                for begin in range(0, len(rows["row"]), 5_000):
                    cut = {c: v[begin: begin + 5_000] for c, v in rows.items()}
                    which = pa.array(cut["row"], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("k1").take(which), part.column("k2").take(which), *[pa.array(cut[c], pa.int64()) for c in ("gram", "place", "low", "high")],
                         pa.array([s[:GRAM] for s in cut["suffix"]], pa.binary()), pa.array(cut["suffix"], pa.binary()), pa.array(cut["prefix"], pa.binary())],
                        names=["k1", "k2", "gram", "place", "low", "high", "lead", "suffix", "prefix"])
    return run


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: three-way partitions on one word after the other."""
    out, todo = [], [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) < 2 or depth == words.shape[1]:
            out.append(rows)
            continue
        key = words[rows, depth]
        if len(rows) <= 64:
            out.append(rows[np.lexsort(words[rows, depth:].T[::-1])])
            continue
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        # The stack gives back the smaller keys first.
        todo += [(rows[key > pivot], depth), (rows[key == pivot], depth + 1), (rows[key < pivot], depth)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def longest_right(suffixes: list[bytes], length: int) -> np.ndarray:
    """Bytes that each suffix has in common with its nearest neighbour in suffix order.

    Suffixes are padded with zero bytes, so the figure can be too large, never too small.
    """
    wide = -(-length // 8) * 8
    packed = np.zeros((len(suffixes), wide), dtype=np.uint8)
    sizes = np.array([min(len(s), wide) for s in suffixes])
    flat = np.frombuffer(b"".join(s[:wide] for s in suffixes), dtype=np.uint8)
    rows = np.repeat(np.arange(len(suffixes)), sizes)
    packed[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    order = multikey_quicksort(packed.view(">u8"))
    best = np.zeros(len(suffixes), dtype=np.int64)
    for begin in range(0, len(order) - 1, 50_000):
        a, b = order[begin: begin + 50_000], order[begin + 1: begin + 50_001]
        a = a[: len(b)]
        differs = packed[a] != packed[b]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
        np.maximum.at(best, a, same)
        np.maximum.at(best, b, same)
    return best


def _strings(table: pa.Table, length: int, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, hash) of the strings that the anchors stand for, without those that reach beyond the longest match."""
    low, high, place = (table.column(c).to_numpy() for c in ("low", "high", "place"))
    begin = low.copy()
    last = high if reach is None else np.minimum(high, place + reach - length)
    both = [p + s for p, s in zip(table.column("prefix").to_pylist(), table.column("suffix").to_pylist())]
    sizes = np.array([len(x) for x in both], dtype=np.int64)
    at = np.cumsum(sizes) - sizes
    sums, down = _prefix_sums(np.frombuffer(b"".join(both), dtype=np.uint8))
    count = np.maximum(0, last - begin + 1)
    row = np.repeat(np.arange(len(low)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = at[row] + inside
    return row, begin[row] + inside, mix((sums[first + length] - sums[first]) * down[first])


def _match(length: int):
    """Repeated strings of a bucket: (k1, k2, spans)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept).sort_by("lead")
        lead = table.column("lead").to_pylist()
        borders = [0] + [i for i in range(1, len(lead)) if lead[i] != lead[i - 1]] + [len(lead)]
        begin = 0
        for k in range(1, len(borders)):
            if borders[k] - begin >= 8_000 or k == len(borders) - 1:
                yield from matched(table.slice(begin, borders[k] - begin).combine_chunks())
                begin = borders[k]

    def matched(table: pa.Table) -> Iterator[pa.RecordBatch]:
        reach = longest_right(table.column("suffix").to_pylist(), length)
        row, start, found = _strings(table, length, reach)
        _, where, times = np.unique(found, return_inverse=True, return_counts=True)
        hit = times[where] > 1
        row, start = row[hit], start[hit]
        if not len(row):
            return
        heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
        tails = np.append(heads[1:], len(row)) - 1
        which = pa.array(row[heads])
        yield pa.RecordBatch.from_arrays(
            [table.column("k1").combine_chunks().take(which), table.column("k2").combine_chunks().take(which), pa.array(start[heads]), pa.array(start[tails] + length)], names=["k1", "k2", "begin", "end"])
    return run


def _hot_strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                table = pa.Table.from_batches([batch.slice(begin, 500)])
                row, start, found = _strings(table, length, None)
                which = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[table.column(c).combine_chunks().take(which) for c in ("gram", "k1", "k2")], pa.array(start), pa.array(signed(found))], names=["gram", "k1", "k2", "begin", "string"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, edges = column_bytes(part.column("text"))
            removed, count, sha, kept, spans = [], [], [], [], []
            for i, rows in enumerate(part.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for a, b in sorted(rows):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                keep = np.ones(edges[i + 1] - edges[i], dtype=bool)
                for a, b in merged:
                    keep[a:b] = False
                removed.append(int((~keep).sum()))
                count.append(len(merged))
                rest = data[edges[i]: edges[i + 1]][keep].tobytes()
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "replace"))  # a cut may fall inside a character
                spans.append(merged)
            yield pa.RecordBatch.from_arrays(
                [part.column("k1"), part.column("k2"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per row of `docs`: bytes, removed bytes, maximal removed runs (`spans`), the hash of what is left, and that as text.

    A byte goes if a string of `length` bytes over it also starts anywhere else.  Null and empty
    texts have no bytes; repeated rows are copies of each other and lose what is long enough;
    rows with a null id take part.  Other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(F.col(id_column), text).alias("k1"), F.xxhash64(F.col(id_column), F.lit(1)).alias("k2"))
    kind = base.schema["id"].dataType.simpleString()
    facts = store(base.mapInArrow(_facts(length), f"id {kind}, k1 long, k2 long, n_bytes long, sha string, own array<array<bigint>>, " + ", ".join(f"{c} array<bigint>" for c in _LISTS)), "anchors")
    total = facts.agg(F.sum(F.size("place"))).first()[0] or 0
    suffixes = facts.select("k1", "k2", F.explode(F.arrays_zip(*_LISTS)).alias("a")).select("a.gram", "a.right", "a.left", "k1", "k2", "a.place", "a.low", "a.high")
    shared = suffixes.repartition(partitions(spark, total, 500_000), "gram").mapInArrow(_shared, "gram long, k1 long, k2 long, place long, low long, high long")
    found = store(shared.distinct(), "shared")
    often = store(found.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("gram", F.lit(True).alias("hot")), "hot")
    # A text that repeats itself, or a row that is repeated, needs no shared anchor to lose bytes.
    again = facts.groupBy("k1", "k2", "n_bytes").agg(F.count("*").alias("n")).where(f"n > 1 AND n_bytes >= {length}")
    alone = facts.where("size(own) > 0").select("k1", "k2", F.explode("own").alias("s")).select("k1", "k2", F.col("s")[0].alias("begin"), F.col("s")[1].alias("end"))
    alone = alone.union(again.select("k1", "k2", F.lit(0).cast("long"), F.col("n_bytes")))
    place = F.struct("gram", "place", "low", "high")
    touched = found.select("k1", "k2", place.alias("f")).union(alone.select("k1", "k2", F.lit(None).cast("struct<gram:bigint,place:bigint,low:bigint,high:bigint>")).distinct())
    lists = touched.groupBy("k1", "k2").agg(F.collect_list("f").alias("found"))
    texts = store(base.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "found"), "texts")
    around = texts.mapInArrow(_contexts(length), "k1 long, k2 long, gram long, place long, low long, high long, lead binary, suffix binary, prefix binary")
    held = found.count()
    parts = partitions(spark, held, 40_000)
    if often.limit(1).count():
        around = around.join(often, "gram", "left")
        strings = around.where("hot").mapInArrow(_hot_strings(length), "gram long, k1 long, k2 long, begin long, string long")
        strings = store(strings, "strings")
        twice = strings.groupBy("gram", "string").agg(F.count("*").alias("n")).where("n > 1").select("gram", "string")
        hits = strings.join(twice, ["gram", "string"]).select("k1", "k2", "begin", (F.col("begin") + length).alias("end"))
        around = around.where("hot IS NULL").drop("hot")
    else:
        hits = None
    spans = around.repartitionByRange(parts, "lead").mapInArrow(_match(length), "k1 long, k2 long, begin long, end long")
    spans = spans.union(hits) if hits is not None else spans
    per = spans.union(alone).groupBy("k1", "k2").agg(F.collect_list(F.array("begin", "end")).alias("spans"))
    cut = texts.select("k1", "k2", "text").join(per, ["k1", "k2"]).mapInArrow(_cut, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<array<bigint>>").dropDuplicates(["k1", "k2"])
    # Equal rows share their results; the texts come from the table itself once more, not from a stored copy.
    results = facts.select("k1", "k2", "n_bytes", "sha").dropDuplicates(["k1", "k2"]).join(cut, ["k1", "k2"], "left")
    out = base.join(results, ["k1", "k2"])
    return out.select(
        F.col("id").alias(id_column), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", F.expr("CAST(array() AS array<array<bigint>>)")).alias("spans"),
        F.coalesce("kept", "text").alias(text_column))
