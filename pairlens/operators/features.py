"""Feature sums, contrast, ranked feature lists and feature-list joins.

All inputs here are keyed by ``latent``; their size is bounded by the
dictionary size L, never by the corpus. The corpus-sized input is the sparse
activation table, which is reduced by a partial (map-side) aggregate before
the only shuffle on ``latent``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feature_sums(acts: DataFrame, latent_size: int, side_col: str = "side") -> DataFrame:
    """A1: activation sums per feature and side in one pass, dense 0..L-1.

    ``acts`` holds active values (V4 already applied). Output:
    ``latent int, v_chosen double, v_rejected double``.
    """
    sums = acts.groupBy("latent").agg(
        F.sum(F.when(F.col(side_col) == "chosen", F.col("value")).otherwise(0.0)).alias("v_chosen"),
        F.sum(F.when(F.col(side_col) == "rejected", F.col("value")).otherwise(0.0)).alias("v_rejected"),
    )
    spark = acts.sparkSession
    dense = spark.range(latent_size).select(F.col("id").cast("int").alias("latent"))
    # L rows on both sides; the sums side has at most L rows whatever the corpus size.
    return (dense.join(F.broadcast(sums), "latent", "left")
            .select("latent",
                    F.coalesce("v_chosen", F.lit(0.0)).alias("v_chosen"),
                    F.coalesce("v_rejected", F.lit(0.0)).alias("v_rejected")))


def smoothing_constant(sums: DataFrame) -> F.Column:
    """A2: 2 x mean over both dense value lists (zeros included), as a scalar subquery."""
    return sums.select(
        (F.lit(2.0) * (F.sum("v_chosen") + F.sum("v_rejected")) / (F.lit(2.0) * F.count("*")))
        .alias("c")
    ).scalar()


def feature_contrast(sums: DataFrame) -> DataFrame:
    """A3 (+J1 implicitly: both sides come from one pass): smoothed relative contrast
    ``(a - b) / (a + b + c)``, 0 when the denominator is 0."""
    c = smoothing_constant(sums)
    den = F.col("v_chosen") + F.col("v_rejected") + c
    return sums.select(
        "latent",
        F.when(den != 0, (F.col("v_chosen") - F.col("v_rejected")) / den).otherwise(F.lit(0.0)).alias("diff"),
        "v_chosen", "v_rejected",
    )


def top_by_abs(contrast: DataFrame, n: int, value_col: str = "diff") -> DataFrame:
    """Rank features by |diff| desc (latent breaks ties), keep the first n.

    ``row_number() <= n`` over a global order is planned with a
    WindowGroupLimit below the single-partition exchange, so each task ships
    at most n rows.
    """
    w = Window.orderBy(F.abs(F.col(value_col)).desc(), F.col("latent"))
    return contrast.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_in_rank(ranked: DataFrame, n: int) -> DataFrame:
    """First n rows of a ranked id list (rank is a column, 1-based)."""
    w = Window.orderBy(F.col("rank"), F.col("latent"))
    return (ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
            .drop("rank").withColumnRenamed("_r", "rank"))


def split_by_sign(ranked: DataFrame, value_col: str = "diff") -> DataFrame:
    """W3 tail: sign column, +1 for positive, -1 for negative; zero in neither list."""
    return (ranked.filter(F.col(value_col) != 0)
            .withColumn("sign", F.when(F.col(value_col) > 0, F.lit(1)).otherwise(F.lit(-1))))


def keep_listed(acts: DataFrame, ids: DataFrame) -> DataFrame:
    """Semi-join activations with a feature id list (ids bounded by L)."""
    return acts.join(F.broadcast(ids.select("latent").distinct()), "latent", "left_semi")


def keep_set(safe: DataFrame, unsafe: DataFrame) -> DataFrame:
    """Union of safe and unsafe ids into one keep set."""
    return safe.select("latent").unionByName(unsafe.select("latent")).distinct()


def safety_filter(ranked: DataFrame, results: DataFrame, threshold: int, n: int,
                  keep_unscored: bool = True) -> DataFrame:
    """J4 + W2: ranked ids whose interpretation score is >= threshold, or null
    unless ``keep_unscored`` is off; rank order kept, first n.
    ``results``: latent, score (nullable)."""
    passes = F.col("score") >= threshold
    if keep_unscored:
        passes = F.col("score").isNull() | passes
    passed = ranked.join(F.broadcast(results.select("latent", "score")), "latent", "inner").filter(passes)
    return first_in_rank(passed.select("rank", "latent"), n)


def restrict_contrast(contrast: DataFrame, ids: DataFrame) -> DataFrame:
    """Contrast rows of listed features."""
    return contrast.join(F.broadcast(ids.select("latent").distinct()), "latent", "left_semi")
