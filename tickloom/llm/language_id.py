"""Language identification: multinomial naive Bayes over hashed character n-grams.

Tasks count the hashed n-grams of all training texts by language; the sums make one matrix of log
probabilities, whose size is buckets times languages.  It is broadcast after that size is checked,
and whole texts are scored in batches by sparse sums over its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import slices

#: Buckets of the hash, lengths of the n-grams, and the count added to every bucket.
BUCKETS, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.1
#: Most bytes of the broadcast matrix; beyond it the fit raises and asks for fewer buckets.
LARGEST_MODEL = 256 << 20
UNKNOWN = "und"
_SLICE = 1 << 19
_U = np.uint64
_tables: list[np.ndarray] = []


def held_out(ids: list) -> np.ndarray:
    """crc32 of the id as text, modulo 5, is 0.  A null id is the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in ids], dtype=bool)


def _folding() -> np.ndarray:
    """Code point -> lower-case code point of a letter, or a space for anything else; made once per process."""
    if not _tables:
        fold = np.full(0x110000, 32, dtype=np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                fold[k] = ord(low) if len(low) == 1 else k
        _tables.append(fold)
    return _tables[0]


def ngrams(texts: list[str | None], buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, text of each), in order of text.

    Letters are lower-cased, a run of anything else is one space, and each text begins and ends with
    one.  N-grams lie inside a word and the spaces beside it, and hold at least one letter.
    """
    lengths = np.array([0 if t is None else len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = np.concatenate([[np.uint32(32)], _folding()[points]])
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths + 1)])
    letter = chars != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters only the first stays, which belongs to the text of the letter before it
    keep[0] = True
    chars, owner, letter = chars[keep].astype(np.uint64), owner[keep], letter[keep]
    found, whose = [], []
    for order in orders:
        n = len(chars) - order + 1
        if n <= 0:
            continue
        mixed = np.zeros(n, dtype=np.uint64)
        fine = np.zeros(n, dtype=bool)
        for k in range(order):
            mixed = mixed * _U(0x100000001B3) + chars[k: k + n] + _U(1)
            fine |= letter[k: k + n]
        for k in range(1, order - 1):
            fine &= letter[k: k + n]
        at = np.flatnonzero(fine)
        mixed = (mixed[at] ^ (mixed[at] >> _U(29))) * _U(0x9E3779B97F4A7C15)
        found.append((mixed >> _U(40)).astype(np.int64) % buckets)
        whose.append(owner[at + (1 if order > 1 else 0)])  # the space before a text belongs to the text before
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found, whose = np.concatenate(found), np.concatenate(whose)
    rank = np.argsort(whose, kind="stable")
    return found[rank], whose[rank]


def _count(buckets: int, orders: tuple[int, ...]):
    """Per task: n-grams of each bucket by language, and texts by language (bucket -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for whole in batches:
            train = whole.filter(pa.array(~held_out(whole.column("id").to_pylist()), pa.bool_()))
            for batch in slices(train, "text", _SLICE):
                langs = batch.column("lang").to_pylist()
                names = sorted(set(langs))
                index = np.array([names.index(x) for x in langs])
                found, whose = ngrams(batch.column("text").to_pylist(), buckets, orders)
                seen = np.bincount(index[whose] * buckets + found, minlength=len(names) * buckets)
                for k, name in enumerate(names):
                    counts[name] = counts.get(name, 0) + seen[k * buckets: (k + 1) * buckets]
                    texts[name] = texts.get(name, 0) + int((index == k).sum())
        for name, seen in counts.items():
            used = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(used) + 1), pa.string()), pa.array(np.r_[used, -1], pa.int32()), pa.array(np.r_[seen[used], texts[name]], pa.int64())], names=["lang", "bucket", "n"])
    return run


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
        buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log prior, log probability by bucket and language) from all training rows.

    Rows that are held out, or whose text or language is null, teach nothing; texts without a letter
    count for the prior alone.  Each task hands on at most buckets times languages counts.
    """
    rows = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    summed = rows.mapInArrow(_count(buckets, orders), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if len(langs) * buckets * 8 > LARGEST_MODEL:
        raise ValueError(f"{len(langs)} languages times {buckets} buckets exceed {LARGEST_MODEL} bytes: use fewer buckets")
    place = {x: k for k, x in enumerate(langs)}
    counts, texts = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    lang, bucket, n = np.array([place[x] for x in table.column("lang").to_pylist()], dtype=np.int64), table.column("bucket").to_numpy(), table.column("n").to_numpy()
    gram = bucket >= 0
    counts[bucket[gram], lang[gram]] = n[gram]
    texts[lang[~gram]] = n[~gram]
    likely = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * buckets)
    return langs, np.log(texts / max(texts.sum(), 1)) if langs else texts, likely


def score(texts: list[str | None], prior: np.ndarray, likely: np.ndarray, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its posterior probability, whether the text has an n-gram) of each text."""
    found, whose = ngrams(texts, len(likely), orders)
    some = np.zeros(len(texts), dtype=bool)
    some[whose] = True
    total = np.tile(prior, (len(texts), 1))
    if len(found):
        heads = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
        for k in range(len(prior)):
            total[whose[heads], k] += np.add.reduceat(likely[:, k][found], heads)
    best = total.argmax(axis=1)
    top = total[np.arange(len(texts)), best]
    return best, 1 / np.exp(total - top[:, None]).sum(axis=1), some


def _predict(model, orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, likely = model.value
        likely = np.asfortranarray(likely)
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                if langs:
                    best, sure, some = score(batch.column("text").to_pylist(), prior, likely, orders)
                    names, sure = [langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, sure, 0.0)
                else:
                    names, sure = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                ids = batch.column("id")
                yield pa.RecordBatch.from_arrays([ids, pa.array(held_out(ids.to_pylist()), pa.bool_()), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
             buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, smoothing: float = SMOOTHING) -> DataFrame:
    """(id, held_out, lang_pred, score) per row of `docs`; the prediction reads the text alone.

    Null texts and texts without a letter are `und` with score 0, and so is everything if there is
    nothing to learn from.  Long texts count whole.  Of equal scores the first language in order
    wins.  Rows with a null id are held out; repeated rows come back repeated; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    langs, prior, likely = fit(docs, id_column, text_column, lang_column, buckets, orders, smoothing)
    model = spark.sparkContext.broadcast((langs, prior, likely))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_predict(model, orders), f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_column)
