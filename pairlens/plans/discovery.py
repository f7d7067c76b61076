"""Feature discovery on vectors: which features separate chosen from rejected?

Plan: dictionary (V8, V7) -> z-score (V1) -> encode (V2, V3) -> active (V4)
-> sums by side in one pass (A1) -> contrast (A2, A3) -> top by |diff| (W1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlens.config import TEST, Params
from pairlens.operators import features as feat
from pairlens.operators import vectors as vec
from pairlens.plans import inputs


def vector_activations(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """Top-k activations (V3, before the > 0 filter) of the side-tagged vectors."""
    d = inputs.test_dictionary(spark, sf_dir, p.latent_size)
    z = vec.zscore(inputs.side_vectors(spark, sf_dir), "vec", "x", p.eps)
    return vec.encode(z, d, p.k, keys=["vec_id", "side"])


def vector_feature_sums(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    acts = vec.active(vector_activations(spark, sf_dir, p))
    return feat.feature_sums(acts, p.latent_size)


def vector_contrast(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    return feat.feature_contrast(vector_feature_sums(spark, sf_dir, p))


def top_vector_features(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """Flagship: features ranked by |contrast|, first ``contrast_top``."""
    return feat.top_by_abs(vector_contrast(spark, sf_dir, p), p.contrast_top)
