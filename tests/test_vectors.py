import math

import numpy as np
from pyspark.sql import functions as F

from pairlens.operators import vectors as vec
from pairlens.operators.vectors import FeatureDictionary, _topk_mask


def test_zscore_sample_std(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "id long, v array<double>")
    row = vec.zscore(df, "v", "x").first()
    assert row.std == 1.0 and row.mean == 2.0
    assert all(math.isclose(a, b, abs_tol=1e-5) for a, b in zip(row.x, [-1.0, 0.0, 1.0]))


def test_topk_keeps_non_positive_and_breaks_ties_by_id():
    m = _topk_mask(np.array([[-1.0, -2.0, -3.0]]), 2)
    assert m.tolist() == [[True, True, False]]
    m = _topk_mask(np.array([[1.0, 5.0, 1.0, 1.0]]), 2)
    assert m.tolist() == [[True, True, False, False]]


def _dictionary(spark, rng, L=12, d=6):
    enc = rng.normal(size=(L, d))
    rows = [(i, enc[i].tolist(), (enc[i] / np.linalg.norm(enc[i])).tolist(), float(rng.normal())) for i in range(L)]
    lat = spark.createDataFrame(rows, "latent int, enc array<double>, dec array<double>, latent_bias double")
    pb = spark.createDataFrame([(rng.normal(size=d).tolist(),)], "pre_bias array<double>")
    return FeatureDictionary(lat, pb)


def test_blocks_of_latents_give_the_same_encode(spark):
    rng = np.random.default_rng(7)
    d = _dictionary(spark, rng)
    x = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)], "id long, x array<double>")
    full = {(r.id, r.latent): r.value for r in vec.encode(x, d, 4, ["id"]).collect()}
    small = vec.encode(x, d, 4, ["id"], block_latents=3)
    blocked = {(r.id, r.latent): r.value for r in small.collect()}
    assert full.keys() == blocked.keys()
    assert all(math.isclose(full[k], blocked[k], rel_tol=1e-12) for k in full)
    assert len(full) == 40 * 4


def test_blocks_of_latents_give_the_same_reconstruction(spark):
    rng = np.random.default_rng(8)
    d = _dictionary(spark, rng)
    x = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(10)], "id long, x array<double>")
    a = {r.id: r.x_hat for r in vec.reconstruct(x, d, 3, ["id"]).collect()}
    b = {r.id: r.x_hat for r in vec.reconstruct(x, d, 3, ["id"], block_latents=2).collect()}
    for k in a:
        assert np.allclose(a[k], b[k], rtol=1e-12)


def test_ties_across_blocks_go_to_the_lower_latent():
    enc = np.ones((7, 2))
    for block in (1, 2, 3, 7):
        tiles = [enc[s:s + block] for s in range(0, 7, block)]
        idx, vals = vec._running_topk(np.array([[1.0, 1.0], [0.0, 2.0]]), tiles, np.array([0, 0, 0, 0, 0, 0, 1.0]), 3)
        assert idx.tolist() == [[0, 1, 6], [0, 1, 6]] and vals.tolist() == [[2, 2, 3], [2, 2, 3]]


def test_at_most_k_activations(spark):
    rng = np.random.default_rng(9)
    d = _dictionary(spark, rng)
    x = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(30)], "id long, x array<double>")
    counts = vec.encode(x, d, 5, ["id"]).groupBy("id").count().select(F.max("count")).first()[0]
    assert counts == 5


def test_degenerate_rows_do_not_fail_the_job(spark):
    from pairlens.operators import evaluate as ev
    df = spark.createDataFrame([(0, [5.0]), (1, [0.0, 0.0])], "id long, v array<double>")
    z = {r.id: r for r in vec.zscore(df, "v", "x").collect()}
    assert z[0].std is None                      # one element: sample std undefined
    zeros = spark.createDataFrame([(0, 0, [0.0, 0.0], [1.0, 1.0])], "id long, b long, x array<double>, x_hat array<double>")
    m = ev.normalized_mse_both(zeros, "b").first()
    assert (m.nmse, m.nmse_batch_mean, m.n_skipped) == (None, None, 1)
    lat = spark.createDataFrame([(0, [0.0, 0.0], [0.0, 0.0], 0.0)], "latent int, enc array<double>, dec array<double>, latent_bias double")
    assert vec.unit_norm_decoder(lat).first().dec == [None, None]
