"""Benchmark decontamination: test n-grams as a broadcast hash set, scanned over every text.

The windows of the test items are hashed and broadcast as sorted arrays.  Their number is
checked first: more than `BLOCK` windows are taken in blocks of that size, one scan of the
stored documents per block, and the blocks' spans are united per row.  One block at a time is
on the driver and in the tasks.  Every hash hit is compared word by word with the item's window
before it counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import store
from tickloom.llm.text import NOT_LETTER, Words, signed, slices

WIDTH = 10
#: Windows that are broadcast at once; a window takes about 100 bytes.
BLOCK = 500_000


@dataclass
class WindowSet:
    """Windows sorted by hash; one entry per window and item."""

    hashes: np.ndarray
    widths: np.ndarray
    words: list[bytes]
    items: list[str]

    def find(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        """(hit mark per word, items per text) for all texts of `words`."""
        hit = np.zeros(len(hashes) + 1, dtype=np.int32)
        items: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
        for width in np.unique(self.widths):
            text, at, found = words.windows(hashes, int(width))
            low = np.searchsorted(self.hashes, found)
            near = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == found)
            for i in near.tolist():
                begin, end = at[i], at[i] + width
                if end > words.first[text[i] + 1]:
                    continue  # a shorter text; the pass of its own width finds it
                own = b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[begin:end], words.ends[begin:end]))
                for k in range(low[i], len(self.hashes)):
                    if self.hashes[k] != found[i]:
                        break
                    if self.words[k] == own:
                        items[text[i]].add(self.items[k])
                        hit[begin] += 1
                        hit[end] -= 1
        return np.cumsum(hit[:-1]) > 0, items


def _item_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), NOT_LETTER)
                count = np.diff(words.first)
                text, at, found = words.windows(words.hashes(), width)
                wide = np.minimum(count[text], width)
                own = [b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[a:a + w], words.ends[a:a + w])) for a, w in zip(at, wide)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("item").take(pa.array(text)), pa.array(signed(found)), pa.array(wide.astype(np.int32)), pa.array(own, pa.binary())],
                    names=["item", "hash", "width", "words"])
    return run


def window_sets(bench: DataFrame, item_column: str = "item_id", text_column: str = "text", width: int = WIDTH, block: int = BLOCK) -> Iterator[WindowSet]:
    """The test items' distinct windows, at most `block` of them at a time."""
    base = bench.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text")).where("item IS NOT NULL")
    windows = base.mapInArrow(_item_windows(width), "item string, hash long, width int, words binary").distinct()
    blocks = max(1, -(-windows.count() // block))
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).toArrow().to_pydict()
        order = np.argsort(np.array(rows["hash"], dtype=np.int64).view(np.uint64), kind="stable")
        yield WindowSet(np.array(rows["hash"], dtype=np.int64).view(np.uint64)[order], np.array(rows["width"], dtype=np.int64)[order],
                        [rows["words"][i] for i in order], [rows["item"][i] for i in order])


def _runs(mark: np.ndarray) -> np.ndarray:
    """(first, past last) of each run of true values."""
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), NOT_LETTER)
                hit, items = known.find(words, words.hashes()) if len(known.hashes) else (np.zeros(len(words.starts), bool), [set()] * part.num_rows)
                spans = [_runs(hit[a:b]).tolist() if hit[a:b].any() else [] for a, b in zip(words.first[:-1], words.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(words.first), pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["id", "n_words", "spans", "items"])
    return run


_SPANS = "n_words long, spans array<array<bigint>>, items array<string>"


def _block_spans(keyed: DataFrame, sets: Iterator[WindowSet]) -> DataFrame:
    """(id, n_words, spans, items) of each row of `keyed` (id, text), whose ids are distinct; each block's hits are stored before the next block is read."""
    parts = []
    for known in sets:
        shared = keyed.sparkSession.sparkContext.broadcast(known)
        part = keyed.mapInArrow(_scan(shared), f"id long, {_SPANS}")
        # Rows without a hit are needed once.
        parts.append(store(part.where("size(items) > 0") if parts else part, "spans"))
        shared.unpersist()
    return reduce(DataFrame.union, parts).groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = []
        for spans in batch.column("spans").to_pylist():
            last = total = 0
            for a, b in sorted(spans):
                total += max(0, b - max(a, last))
                last = max(last, b)
            hits.append(total)
        items = [sorted(set(x)) for x in batch.column("items").to_pylist()]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()),
             pa.array([h > 0 for h in hits], pa.bool_()), pa.array(items, pa.list_(pa.string()))],
            names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def contamination(docs: DataFrame, bench: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                  bench_text: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: words, words inside any occurrence of a test window, and the items found.

    Null and empty texts have no words; items without words or id have no windows; repeated
    items count once.  Other columns are ignored.  Empty tables are fine on either side.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    sets = window_sets(bench, item_column, bench_text, width, block)
    first, second = next(sets), next(sets, None)
    if second is None:
        found = base.mapInArrow(_scan(spark.sparkContext.broadcast(first)), f"id {kind}, {_SPANS}")
    else:
        rows = store(base.withColumn("row", F.monotonically_increasing_id()), "rows")
        spans = _block_spans(rows.select(F.col("row").alias("id"), "text"), chain([first, second], sets)).withColumnRenamed("id", "row")
        found = rows.select("row", "id").join(spans, "row").drop("row")
    out = found.mapInArrow(_united, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")
    return out.withColumnRenamed("id", id_column)


def _without(text: str, words: Words, k: int, runs: np.ndarray) -> str:
    """Text k of `words` without the runs of words (counted from the text's first)."""
    raw, keep, last = text.encode(), [], 0
    for s, e in runs + words.first[k]:
        keep.append(raw[last: words.starts[s] - words.offsets[k]])
        last = words.ends[e - 1] - words.offsets[k]
    return b" ".join([*keep, raw[last:]]).decode()


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "_clean_text"):
                column = part.column("_clean_text")
                texts, marked = column.to_pylist(), [False] * part.num_rows
                todo = list(range(part.num_rows))
                while todo:
                    now = pa.array([texts[i] for i in todo], pa.string())
                    words = Words(now, NOT_LETTER)
                    hit = known.find(words, words.hashes())[0] if len(known.hashes) else np.zeros(len(words.starts), bool)
                    again = []
                    for k, i in enumerate(todo):
                        a, b = words.first[k], words.first[k + 1]
                        if hit[a:b].any():
                            texts[i], marked[i] = _without(texts[i], words, k, _runs(hit[a:b])), True
                            again.append(i)
                    todo = again
                words = Words(pa.array(texts, pa.string()), NOT_LETTER)
                keep = [not m or n > 0 for m, n in zip(marked, np.diff(words.first))]
                out = part.set_column(part.schema.get_field_index("_clean_text"), "_clean_text", pa.array(texts, column.type))
                yield out.filter(pa.array(keep, pa.bool_()))
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans, and the words left."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").to_pylist()
            words = Words(part.column("text"), NOT_LETTER)
            for k, spans in enumerate(part.column("spans").to_pylist()):
                hit = np.zeros(words.first[k + 1] - words.first[k], bool)
                for a, b in spans:
                    hit[a:b] = True
                texts[k] = _without(texts[k], words, k, _runs(hit))
            left = np.diff(Words(pa.array(texts, pa.string()), NOT_LETTER).first)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string()), pa.array(left, pa.int64())], names=["id", "text", "left_words"])


def remove_contamination(docs: DataFrame, bench: DataFrame, text_column: str = "text", item_column: str = "item_id", bench_text: str = "text",
                         width: int = WIDTH, block: int = BLOCK, whole_documents: bool = False, id_column: str = "doc_id") -> DataFrame:
    """`docs` without test passages: hit words are cut out, or with `whole_documents` contaminated rows go.

    Cutting repeats until a text holds no test window, since what is left can form one.  Rows
    that lose all their words go; rows without a hit stay as they are.  All columns are kept.
    Rows are told apart by a key of their own, so null and repeated ids are fine.
    """
    spark = docs.sparkSession
    names = [f"c{i}" if c != text_column else "_clean_text" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)
    if whole_documents:
        rows = store(plain.withColumn("_row", F.monotonically_increasing_id()), "rows")
        hit = contamination(rows, bench, "_row", "_clean_text", item_column, bench_text, width, block).where("contaminated").select("_row")
        return rows.join(hit, "_row", "left_anti").select(*names).toDF(*docs.columns)
    sets = window_sets(bench, item_column, bench_text, width, block)
    first, second = next(sets), next(sets, None)
    if second is None:
        return plain.mapInArrow(_clean(spark.sparkContext.broadcast(first)), plain.schema).toDF(*docs.columns)
    rows = store(plain.withColumn("_row", F.monotonically_increasing_id()), "rows")
    live, changed, sets = rows.select(F.col("_row").alias("id"), F.col("_clean_text").alias("text")), None, chain([first, second], sets)
    # The spans of all blocks are cut at once, as with one block; only texts that were cut are searched again.
    while True:
        hits = store(_block_spans(live, sets).where("size(items) > 0").select("id", "spans"), "hits")
        if hits.isEmpty():
            break
        cut = store(live.join(hits, "id").select("id", "text", "spans").mapInArrow(_cut, "id long, text string, left_words long"), "cut")
        changed = store(changed.join(cut, "id", "left_anti").union(cut), "changed") if changed is not None else cut
        live, sets = cut.select("id", "text"), window_sets(bench, item_column, bench_text, width, block)
    if changed is None:
        return rows.select(*names).toDF(*docs.columns)
    out = rows.join(changed.withColumnRenamed("id", "_row"), "_row", "left").where("left_words IS NULL OR left_words > 0")
    return out.withColumn("_clean_text", F.coalesce("text", "_clean_text")).select(*names).toDF(*docs.columns)
