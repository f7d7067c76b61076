"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-repartition a raw scan by its key when it has fewer partitions than
    the cluster has cores.

    Text rows expand a lot (one text -> hundreds of chunks and segments), so a
    scan of a few large row groups would leave most cores idle. At scale the
    scan already has far more splits than cores and this is a no-op, so the
    raw corpus is never shuffled there.
    """
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys)
