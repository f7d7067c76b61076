"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.session import checkpoint_dir

#: ASCII blanks of the contracts' word rule ``[^\\x20\\x09-\\x0D]+``: exactly what bytes.split() cuts at.
BLANKS = " \t\n\x0b\x0c\r"


#: rows go to Python workers in batches of about so many bytes where ``small_batches`` holds
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a
    lost executor costs nothing that was already written."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Write a table in buckets by ``keys``: joins on them deal only their other side."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, name)
    table_name = f"{name}_{path.rsplit('-', 1)[1]}"
    df.repartition(n, *keys).write.bucketBy(n, keys[0], *keys[1:]).sortBy(*keys).format("parquet").option("path", path).saveAsTable(table_name)
    return spark.table(table_name)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of ``fresh_path`` that no later step reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Jobs started inside send whole texts to Python in batches of ``BATCH_BYTES`` (one row at least),
    where a batch of 10,000 rows would be held several times: by the JVM outside its heap, and by the worker."""
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_CONF) if before is None else spark.conf.set(_BATCH_CONF, before)


def text_batches(column: pa.Array, chars: int = 8_000_000):
    """(first row, texts) slices of a string column; null reads as an empty text.
    Slices end once they hold ``chars`` characters, so Python never holds a whole
    Arrow batch as objects."""
    texts, size, first = [], 0, 0
    for i, x in enumerate(column):
        t = x.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= chars:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def row_results(fields: Sequence[tuple[str, pa.DataType, T.DataType]], fn: Callable[[str | None], tuple]):
    """A column function over one text column: each text gives one struct of ``fields``.
    Rows stay where they are; no other column is sent to Python."""
    spark_type = T.StructType([T.StructField(n, t) for n, _, t in fields])
    names, types = [n for n, _, _ in fields], [t for _, t, _ in fields]

    @F.arrow_udf(spark_type)
    def run(texts: pa.Array) -> pa.Array:
        out = [fn(x.as_py()) for x in texts]
        cols = list(zip(*out)) if out else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


LONG = (pa.int64(), T.LongType())
BOOL = (pa.bool_(), T.BooleanType())
STRING = (pa.string(), T.StringType())
DOUBLE = (pa.float64(), T.DoubleType())


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
