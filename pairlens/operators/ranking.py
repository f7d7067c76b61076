"""Global ranking (G1) and seeded orderings.

G1 numbers all rows 0..n-1 in a total order without pulling them into one
partition: a range-partitioned sort, a reliable checkpoint (range bounds are
sampled, so the partition contents must be fixed before they are counted),
one count per partition, prefix offsets over those counts (one number per
partition, not per row), and offset + position inside the partition.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row in partition


def global_rank(df: DataFrame, order: list[Column], out_col: str = "rank",
                total_col: str | None = None) -> DataFrame:
    """G1: dense 0-based row number in ``order`` (must be a total order: end it
    with a unique key). No window without partitioning; one shuffle (the sort).
    With ``total_col`` the row count (known from the partition counts) is added
    as a literal column, so callers need no second pass to count."""
    ordered = materialize(df.orderBy(*order))
    tagged = ordered.select(
        "*",
        F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    counts = {r["_pid"]: r["n"] for r in tagged.groupBy("_pid").agg(F.count("*").alias("n")).collect()}
    n_parts = (max(counts) + 1) if counts else 0
    sizes = [counts.get(p, 0) for p in range(n_parts)]
    starts = [0] + list(accumulate(sizes))[:-1]
    spark = df.sparkSession
    schema = T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_off", T.LongType())])
    offsets = spark.createDataFrame(list(zip(range(n_parts), starts)), schema)
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS)
    ranked = (tagged.join(F.broadcast(offsets), "_pid")
              .withColumn(out_col, F.col("_off") + local)
              .drop("_pid", "_mid", "_off"))
    if total_col:
        ranked = ranked.withColumn(total_col, F.lit(sum(sizes)).cast("long"))
    return ranked


def seeded_key(id_col: str, seed: int) -> Column:
    """Repeatable pseudo-random key: md5 of seed and id (same in any SQL engine)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int, out_col: str = "position") -> DataFrame:
    """Seeded, repeatable permutation, independent of partitioning."""
    return global_rank(df, [seeded_key(id_col, seed), F.col(id_col)], out_col)


def sample_ids(df: DataFrame, id_col: str, m: int, seed: int) -> DataFrame:
    """Uniform sample of min(m, n) ids by seeded key; original (id) order kept.

    The sample size m is the feature here (a sampling operator), so the limit
    is part of the semantics.
    """
    picked = df.orderBy(seeded_key(id_col, seed), F.col(id_col)).limit(m)
    return picked.orderBy(id_col)
