"""Quality rules: an isolation forest over the statistics that rule filters use.

Each text becomes a row of statistics in one Arrow pass.  Trees split a bounded sample of rows
labelled good at random values; a text far from them is alone after few splits, so a short mean
path marks an anomaly.  The least path that is still kept is calibrated on all labelled rows.

Splits are drawn over the sample's range widened by its own width on both sides.  A value that
no good text has then soon stands in an empty half, which plain trees only do for values inside
the range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import store
from tickloom.llm.text import BLANK, SAME, U, Words, byte_class, mix, slices, span_hashes

#: Good rows gathered to grow the trees, rows per tree, trees.  The sample is the only bounded part.
SAMPLE, ROWS, TREES, SEED = 20_000, 1024, 128, 11
#: Base rules: fewest words, most percent of repeated words.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Paths are compared in steps of a hundredth.
STEP = 100

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = byte_class((0x41, 0x5A))
_MARK = byte_class((0x21, 0x21), (0x3F, 0x3F), (0x5B, 0x60), (0x7B, 0x7E))

FEATURES = ["word_length", "symbol_share", "mark_share", "upper_share", "dup_line_share", "symbol_word_share"]
_STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts for the base rules and shares for the forest, one value per text."""
    words = Words(column, BLANK, SAME)
    data, offsets, first = words.data, words.offsets, words.first
    size, n = len(offsets) - 1, np.diff(words.first)

    def per_text(mark: np.ndarray) -> np.ndarray:
        summed = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return summed[offsets[1:]] - summed[offsets[:-1]]

    def per_words(mark: np.ndarray) -> np.ndarray:
        summed = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return summed[first[1:]] - summed[first[:-1]]

    out = {"n_words": n.astype(np.int64), "word_chars": per_text(((data & 0xC0) != 0x80) & ~BLANK[data]), "n_symbols": per_text(_SYMBOL[data])}
    # Lines: cut at \n and at text borders; a line counts if a word begins in it.
    breaks = np.flatnonzero(data == 0x0A)
    heads = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    tails = np.sort(np.concatenate([offsets[1:], breaks]))
    owner = np.repeat(np.arange(size), np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=size) + 1)
    has = np.searchsorted(words.starts, tails) > np.searchsorted(words.starts, heads)
    owner, heads, tails = owner[has], heads[has], tails[has]
    lines = mix(span_hashes(data, heads, tails) + owner.astype(np.uint64) * U(0x5851F42D4C957F2D))
    new = np.zeros(len(lines), dtype=bool)
    new[np.unique(lines, return_index=True)[1]] = True
    count = np.bincount(owner, minlength=size)
    out["n_dup_lines"] = np.bincount(owner[~new], minlength=size).astype(np.int64)
    # Three-word windows found twice or more in the text.
    hashes = words.hashes()
    text, at, found = words.windows(hashes, 3)
    whole = n[text] >= 3
    text, at, found = text[whole], at[whole], found[whole]
    found = mix(found + text.astype(np.uint64) * U(0x5851F42D4C957F2D))
    _, where, times = np.unique(found, return_inverse=True, return_counts=True)
    cover = np.zeros(len(hashes) + 3, dtype=bool)
    hit = at[times[where] > 1]
    for k in range(3):
        cover[hit + k] = True
    out["n_repeat_words"] = per_words(cover[: len(hashes)])
    least, chars = np.maximum(n, 1), np.maximum(out["word_chars"], 1)
    symbol_words = per_words(_SYMBOL[data[words.ends - 1]]) if len(hashes) else np.zeros(size)
    out |= {
        "word_length": out["word_chars"] / least, "symbol_share": out["n_symbols"] / least, "mark_share": per_text(_MARK[data]) / least, "upper_share": per_text(_UPPER[data]) / chars,
        "dup_line_share": out["n_dup_lines"] / np.maximum(count, 1), "symbol_word_share": symbol_words / least}
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = statistics(part.column("text"))
            columns = [pa.array(found[c], pa.int64()) for c in _STATISTICS] + [pa.array(found[c].astype(np.float64)) for c in FEATURES]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", *_STATISTICS, *FEATURES])


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), split value, index of the left child (the right one follows), path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray

    @staticmethod
    def average(n: float) -> float:
        """Mean path of a search that fails in a random tree of n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def grow(cls, sample: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = SEED) -> Forest:
        random = np.random.default_rng(seed)
        depth = int(np.ceil(np.log2(max(2, rows)))) + 2
        grown = []
        for _ in range(trees):
            own = sample[random.choice(len(sample), min(rows, len(sample)), replace=False)] if len(sample) else sample
            feature, value, child, path = [-1], [0.0], [0], [0.0]
            todo = [(0, own, 0)]
            while todo:
                node, part, level = todo.pop()
                path[node] = level + cls.average(len(part))
                if len(part) < 2 or level >= depth:
                    continue
                low, high = part.min(axis=0), part.max(axis=0)
                usable = np.flatnonzero(high > low) if level else np.arange(part.shape[1])
                if not len(usable):
                    continue
                f = int(random.choice(usable))
                wide = max(high[f] - low[f], 1e-3)
                cut = random.uniform(low[f] - wide, high[f] + wide)
                feature[node], value[node], child[node] = f, cut, len(feature)
                for side in (part[part[:, f] < cut], part[part[:, f] >= cut]):
                    todo.append((len(feature), side, level + 1))
                    feature.append(-1), value.append(0.0), child.append(0), path.append(0.0)
            grown.append((feature, value, child, path))
        most = max(len(g[0]) for g in grown)
        pad = lambda k, kind: np.array([np.pad(np.array(g[k], dtype=kind), (0, most - len(g[k]))) for g in grown])
        return cls(pad(0, np.int32), pad(1, np.float64), pad(2, np.int32), pad(3, np.float64))

    def mean_path(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, value, child, path in zip(self.feature, self.value, self.child, self.path):
            at = np.zeros(len(rows), dtype=np.int32)
            live = np.arange(len(rows))
            while len(live):
                node = at[live]
                inner = feature[node] >= 0
                live, node = live[inner], node[inner]
                at[live] = child[node] + (rows[live, feature[node]] >= value[node])
            total += path[at]
        return total / len(self.feature)


def _paths(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in FEATURES], axis=1)
            path = np.floor(forest.mean_path(rows) * STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ["id", *_STATISTICS]] + [pa.array(path)], names=["id", *_STATISTICS, "path"])
    return run


def best_threshold(histogram: list[tuple[int, int, int]]) -> int:
    """The path below which rows are rejected, given (path, good rows, bad rows).

    It has the best balanced accuracy; of equal ones the middle, and 0 (reject nothing) without
    rows of both kinds.
    """
    histogram = sorted(histogram)
    good, bad = sum(h[1] for h in histogram), sum(h[2] for h in histogram)
    if not good or not bad:
        return 0
    scored, lost, caught = [(0.0, 0)], 0, 0
    for k, (path, g, b) in enumerate(histogram):
        lost, caught = lost + g, caught + b
        after = histogram[k + 1][0] if k + 1 < len(histogram) else path + 1
        scored.append((caught / bad - lost / good, (path + 1 + after) // 2))
    best = max(s for s, _ in scored)
    return [t for s, t in scored if s >= best - 1e-12][0]


_KINDS = ", ".join(f"{c} long" for c in _STATISTICS)
_FAILED = f"n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"


def _facts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return store(base.mapInArrow(_statistics, f"id {kind}, {_KINDS}, " + ", ".join(f"{c} double" for c in FEATURES)), "statistics")


def _fit(facts: DataFrame, labels: DataFrame, id_column: str, label_column: str, sample: int, trees: int, rows: int, seed: int) -> tuple[Forest, DataFrame, int]:
    """The forest, all rows with their paths, and the least path that is kept."""
    spark, kind = facts.sparkSession, facts.schema["id"].dataType.simpleString()
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    labelled = facts.where(f"NOT ({_FAILED})").join(known, "id")
    good = labelled.where("label = 1").orderBy(F.xxhash64(F.col("id"), F.lit(seed)), *FEATURES).limit(sample).select(*FEATURES).toArrow()
    forest = Forest.grow(np.stack([good.column(c).to_numpy() for c in FEATURES], axis=1), trees, rows, seed)
    scored = facts.mapInArrow(_paths(spark.sparkContext.broadcast(forest)), f"id {kind}, {_KINDS}, path long")
    histogram = scored.where(f"NOT ({_FAILED})").join(known, "id").groupBy("path").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    # As many rows as there are distinct paths: at most STEP times the depth of a tree.
    return forest, scored, best_threshold([tuple(r) for r in histogram.collect()])


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
          sample: int = SAMPLE, trees: int = TREES, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """One row per row of `docs`: statistics, `base_failed`, `path` (hundredths) and `kept`.

    `labels` has the id and 1 for good, 0 for bad; null labels or ids and labels of unknown ids
    are ignored, and of an id with several labels the least counts.  Without labels of both
    kinds only the base rules decide.  A null text has no words.  Clashing names in other
    columns do no harm: only the named columns are read.
    """
    _, scored, threshold = _fit(_facts(docs, id_column, text_column), labels, id_column, label_column, sample, trees, rows, seed)
    failed = F.expr(_FAILED)
    return scored.select(F.col("id").alias(id_column), *_STATISTICS, failed.alias("base_failed"), (~failed & (F.col("path") >= threshold)).alias("kept"), "path", F.lit(threshold).alias("threshold"))


def _kept(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, threshold = shared.value
        for batch in batches:
            for part in slices(batch, "_judged_text"):
                found = statistics(part.column("_judged_text"))
                path = np.floor(forest.mean_path(np.stack([found[c].astype(np.float64) for c in FEATURES], axis=1)) * STEP)
                failed = (found["n_words"] < FEWEST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
                yield part.filter(pa.array(~failed & (path >= threshold)))
    return run


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
              sample: int = SAMPLE, trees: int = TREES, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns.

    Texts are measured again where they lie, which is cheaper than to shuffle them to a join.
    """
    forest, _, threshold = _fit(_facts(docs, id_column, text_column), labels, id_column, label_column, sample, trees, rows, seed)
    shared = docs.sparkSession.sparkContext.broadcast((forest, threshold))
    plain = docs.toDF(*[f"c{i}" if c != text_column else "_judged_text" for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(_kept(shared), plain.schema).toDF(*docs.columns)
