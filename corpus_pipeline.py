"""A training corpus from `documents`: rule out, deduplicate, decontaminate, redact, pack.

Every stage takes an empty table and gives one; columns it does not know pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.decontaminate import remove_contamination
from tickloom.llm.ngram_join import representatives
from tickloom.llm.packing import pack_documents
from tickloom.llm.pii import redact
from tickloom.llm.quality_forest import keep_good
from tickloom.llm.store import store, table
from tickloom.session import ship

#: Near duplicates in the pipeline: shingles of five words, similarity of 0.8 or more.
WORDS, NUM, DEN = 5, 80, 100


def _counted(docs: DataFrame) -> DataFrame:
    """`n_chars` after a stage that changes texts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go.

    Null, empty and very short texts fail the base rules; repeated rows are judged alike and both stay or go.
    """
    return keep_good(docs, table(ship(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the least id stays; rows without words link with nothing and stay."""
    return representatives(docs, width=WORDS, num=NUM, den=DEN)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents of which nothing is left go.

    Texts without words have no passages and stay; repeated rows are each cut; whole texts of any length are read.
    """
    return _counted(remove_contamination(docs, table(ship(spark), sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind.

    A null or empty text stays as it is; repeated rows are each redacted; ties between overlapping spans go to the first.
    """
    return _counted(redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its tokens and its place in a training sequence.

    A null or empty text is a single end token; repeated rows are packed each; long texts become several pieces.
    """
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("best_fit_packing", best_fit_packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written to the shared folder and read back."""
    docs = table(ship(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, name)
    return docs
