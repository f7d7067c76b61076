import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if i % 9 == 8 else "") for i in range(n))


@pytest.fixture(scope="session")
def texts():
    """Edge cases first, then prose with copies, near copies and shared passages."""
    rng = random.Random(5)
    passage = words(rng, 70, 10_000)
    out = [None, "", " ", "\n\n", "one", "Two words", "ÄÖ ß é😀 x\x00y a_b-c", "<|endoftext|> a<|endoftext|>b",
           "a" * 5000, ("lo " * 3000), "\t\x0b\x0c\r x  y\n z ", "x y z \x1f w", "12 34 !!", "   lead", "trail   "]
    base = [words(rng, rng.randrange(1, 300), 10_000) for _ in range(40)]
    out += base
    out += [base[3]] * 6 + [base[4] + "."] + [base[5] + " extra"]
    out += [f"{words(rng, 30, 10_000)} {passage} {words(rng, k, 10_000)}" for k in (1, 40, 55)]
    out += [passage, "\n".join([words(rng, 60, 10_000)] * 4), words(rng, 4000, 10_000)]
    out += [f"{passage} {passage}", " ".join(passage.split()[:50]), " ".join(passage.split()[:49])]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids in an order unlike the rows', one document without a source and lang."""
    n = len(texts)
    rows = [((i * 37) % n * 3 - 5, t, ["en", "de", None][i % 3], None if i % 5 == 0 else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def save(spark, tmp_path_factory):
    """A table folder from DataFrames, for the registered queries."""
    def run(**tables):
        folder = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)
    return run
