import math

from pairlens.operators import features as feat
from pairlens.operators import scoring as sco


def test_contrast_smoothing_uses_both_dense_lists(spark):
    sums = spark.createDataFrame([(0, 3.0, 1.0), (1, 0.0, 0.0)], "latent int, v_chosen double, v_rejected double")
    rows = {r.latent: r.diff for r in feat.feature_contrast(sums).collect()}
    # c = 2 * (3 + 0 + 1 + 0) / 4 = 2
    assert math.isclose(rows[0], 2 / 6) and rows[1] == 0.0


def test_zero_denominator(spark):
    sums = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0)], "latent int, v_chosen double, v_rejected double")
    assert {r.diff for r in feat.feature_contrast(sums).collect()} == {0.0}


def test_dense_sums_fill_missing_features(spark):
    acts = spark.createDataFrame([(1, "chosen", 2.0), (1, "rejected", 1.0)], "latent int, side string, value double")
    rows = feat.feature_sums(acts, 3).orderBy("latent").collect()
    assert [(r.latent, r.v_chosen, r.v_rejected) for r in rows] == [(0, 0.0, 0.0), (1, 2.0, 1.0), (2, 0.0, 0.0)]


def test_pair_score(spark):
    pairs = spark.createDataFrame([(1,)], "pair_id long")
    chunks = spark.createDataFrame([(1, "chosen", 2), (1, "rejected", 0)], "pair_id long, side string, n_ends int")
    acts = spark.createDataFrame([(1, "chosen", 10, 4.0), (1, "chosen", 20, 1.0)],
                                 "pair_id long, side string, latent int, value double")
    signs = spark.createDataFrame([(10, 1), (20, -1)], "latent int, sign int")
    s = sco.pair_scores(pairs, sco.segment_counts(chunks), sco.signed_sums(acts, signs)).first()
    assert s.saescore == 1.5


def test_safety_filter_keeps_null_scores_in_rank_order(spark):
    ranked = spark.createDataFrame([(1, 7), (2, 3), (3, 9), (4, 1)], "rank int, latent int")
    results = spark.createDataFrame([(7, 5), (3, 4), (9, None)], "latent int, score int")
    rows = feat.safety_filter(ranked, results, 5, 32).orderBy("rank").collect()
    assert [r.latent for r in rows] == [7, 9]
