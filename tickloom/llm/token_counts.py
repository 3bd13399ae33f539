"""Token counts from an exact histogram of encoded lengths.

Every text is encoded once; documents are then only counted by length.  With suffix sums of
the histogram (documents and tokens at or above each length) the total, any quantile and the
total after truncation are known for every context limit L without reading the corpus again:
`truncated(L) = total - (tokens_ge(L) - L * docs_ge(L))`.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published split pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths in one bucket of the suffix sums.
BUCKET = 1024

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The vocabulary file as an encoder, read once per process."""
    if path not in _loaded:
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        _loaded[path] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            for part in slices(batch, "text"):
                counts: dict[int, int] = {}
                for text in part.column("text").to_pylist():
                    n = len(encode(text)) if text else 0
                    counts[n] = counts.get(n, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["length", "n_docs"])
    return run


def length_histogram(docs: DataFrame, text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs) of the encoded texts.  Null and empty texts have length 0; repeated rows count each time."""
    base = docs.select(F.col(text_column).cast("string").alias("text"))
    return base.mapInArrow(_encoded(vocabulary), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with suffix sums and what they answer at the limit equal to each length.

    `docs_ge`, `tokens_ge`: documents and their tokens at or above the length; `truncated_total`:
    tokens left if every document is cut to the length; `quantile`: share of documents at or
    below it.  Sums run inside buckets of lengths, and bucket sums (as many as the longest
    length has buckets) carry over, so no task sorts all lengths.
    """
    rows = histogram.withColumn("bucket", F.floor(F.col("length") / BUCKET)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    total = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = total.select(
        "bucket", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("bucket", "length", "n_docs", "tokens", F.sum("n_docs").over(inside).alias("d"), F.sum("tokens").over(inside).alias("t")).join(carry, "bucket")
    out = out.withColumn("docs_ge", F.col("d") + F.col("docs_above")).withColumn("tokens_ge", F.col("t") + F.col("tokens_above"))
    return out.select(
        "length", "n_docs", "tokens", "docs_ge", "tokens_ge", (F.col("all_tokens") - (F.col("tokens_ge") - F.col("length") * F.col("docs_ge"))).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"))


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_total) for any limits, from the suffix sums alone."""
    limit = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    rows = sums.select("*", limit.alias("context_limit"))
    # The first length at or above the limit holds its suffix sums; above all lengths nothing is cut.
    reached = F.when(F.col("length") >= F.col("context_limit"), F.col("length"))
    facts = rows.groupBy("context_limit").agg(
        F.sum("tokens").alias("total"), F.min_by("tokens_ge", reached).alias("t"), F.min_by("docs_ge", reached).alias("d"),
        F.coalesce(F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs"))), F.lit(0)).alias("docs_over"))
    kept = F.col("total") - F.when(F.col("t").isNull(), 0).otherwise(F.col("t") - F.col("context_limit") * F.col("d"))
    return facts.select("context_limit", "docs_over", kept.alias("truncated_total"))


def at_quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the least length that at least the share of documents does not exceed."""
    share = F.explode(F.array(*[F.lit(float(x)) for x in shares]))
    return sums.select("length", "quantile", share.alias("share")).where(F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
