"""Pair scoring.

score(pair) = signed chosen sum / chosen segments - signed rejected sum / rejected segments,
where a feature of the safe list adds its activation and one of the unsafe
list subtracts it, and a zero segment count counts as 1. One shuffle on
``pair_id`` (partial sums are combined map-side); the sign list is bounded by
the dictionary size and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_side(col: F.Column, side: str) -> F.Column:
    return F.when(F.col("side") == side, col).otherwise(F.lit(0.0))


def segment_counts(chunks: DataFrame) -> DataFrame:
    """A4: selected segments per pair and side, active or not, from the chunk
    table's number of ends (no token is read). A pair without a segment has no row."""
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("n_ends")).otherwise(0))
    return chunks.filter("n_ends > 0").groupBy("pair_id").agg(
        n("chosen").alias("n_chosen"), n("rejected").alias("n_rejected"))


def signed_sums(acts: DataFrame, signs: DataFrame) -> DataFrame:
    """J2 + J3 + A5: activations of listed features (value > 0), signed,
    summed per pair and side. ``signs``: latent, sign (+1 safe, -1 unsafe)."""
    signed = acts.join(F.broadcast(signs.select("latent", "sign")), "latent")
    v = F.col("sign") * F.col("value")
    return signed.groupBy("pair_id").agg(
        F.sum(_by_side(v, "chosen")).alias("s_chosen"),
        F.sum(_by_side(v, "rejected")).alias("s_rejected"),
    )


def pair_scores(pairs: DataFrame, counts: DataFrame, sums: DataFrame) -> DataFrame:
    """A6 (+J6 shape): every pair gets a score; no kept activation gives 0."""
    nc = F.greatest(F.coalesce("n_chosen", F.lit(0)), F.lit(1))
    nr = F.greatest(F.coalesce("n_rejected", F.lit(0)), F.lit(1))
    sc = F.coalesce("s_chosen", F.lit(0.0))
    sr = F.coalesce("s_rejected", F.lit(0.0))
    return (pairs.select("pair_id")
            .join(counts, "pair_id", "left")
            .join(sums, "pair_id", "left")
            .select("pair_id", (sc / nc - sr / nr).alias("saescore")))
