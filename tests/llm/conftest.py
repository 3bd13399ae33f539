import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tickloom.session import ship

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """A local session has no shared folder unless one is set."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    ship(spark)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a long one, repeated rows, and columns with clashing names."""
    words = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, words), (5, words), (6, words), (None, "free text without id"), (7, "Aé ünï " * 60)]
    return spark.createDataFrame([(i, t, "x", 1.0, "y", 2) for i, t in rows], "doc_id long, text string, id string, key double, component string, n int")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
