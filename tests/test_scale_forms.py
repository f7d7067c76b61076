"""Forms of the operators that hold at the original's sizes, against the plain ones."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import chat
from pairlens.operators import evaluate as ev
from pairlens.operators import text as txo
from pairlens.operators import vectors as vec
from pairlens.operators.vectors import FeatureDictionary
from pairlens.sinks import files as sink
from pairlens.sources import files as src


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ A8

def test_divergence_of_a_vocabulary_in_blocks(spark):
    """128k entries in blocks of 8k: equal to the divergence of whole rows."""
    rng = np.random.default_rng(1)
    n, size = 131_072, 8192
    a, b = rng.normal(0, 5, (6, n)), rng.normal(0, 5, (6, n)) + 200
    rows = [(r, r // 2, a[r, s:s + size].tolist(), b[r, s:s + size].tolist()) for r in range(6) for s in range(0, n, size)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "row int, seq int, x array<double>, y array<double>").repartition(7)
    la = a - a.max(1, keepdims=True) - np.log(np.exp(a - a.max(1, keepdims=True)).sum(1, keepdims=True))
    lb = b - b.max(1, keepdims=True) - np.log(np.exp(b - b.max(1, keepdims=True)).sum(1, keepdims=True))
    got = ev.kl_divergence_blocks(df, "row", "seq", "x", "y").first()
    assert got.n_sequences == 3 and got.kl == pytest.approx((np.exp(la) * (la - lb)).sum() / 3, rel=1e-9)


def test_blocks_of_any_size_give_the_plain_divergence(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 4, rng.normal(0, 30, 11).tolist(), rng.normal(0, 30, 11).tolist()) for i in range(20)]
    whole = spark.createDataFrame(rows, "row int, seq int, x array<double>, y array<double>")
    want = ev.kl_divergence(whole, "x", "y", "seq").first().kl
    for size in (1, 4, 11):
        cut = [(r, s, x[k:k + size], y[k:k + size]) for r, s, x, y in rows for k in range(0, 11, size)] + [(0, 0, [], [])]
        blocks = spark.createDataFrame(cut, "row int, seq int, x array<double>, y array<double>")
        assert ev.kl_divergence_blocks(blocks, "row", "seq", "x", "y").first().kl == pytest.approx(want, rel=1e-9)


# ------------------------------------------------------------------ A12

@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 1001])
@pytest.mark.parametrize("parts", ["3", "13"])
def test_adjacent_rows_pair_across_borders(spark, n, parts):
    rows = [(i * 3 - 50, math.sin(i)) for i in range(n)]
    random.Random(n).shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ev.adjacent_pairs(spark.createDataFrame(rows, "place long, reward double"), "place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, got)) == [(i, math.sin(2 * i), math.sin(2 * i + 1)) for i in range(n // 2)]


def test_long_loss_equals_the_wide_form(spark):
    wide = spark.range(501).select(F.col("id").alias("pair_id"), F.sin("id").alias("r_chosen"), F.cos("id").alias("r_rejected"))
    long = wide.select("pair_id", F.explode(F.array("r_chosen", "r_rejected")).alias("reward")).select(F.monotonically_increasing_id().alias("k"), "reward")
    assert ev.pairwise_loss(ev.adjacent_pairs(long, "k")).first().loss == pytest.approx(ev.pairwise_loss(wide).first().loss)


# ------------------------------------------------------------------ T11, T12

def test_a_conversation_of_a_million_turns(spark):
    n, keep = 1_000_000, 64
    turns = spark.range(0, n, 1, 8).select((F.col("id") % 1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                           F.concat(F.lit("words of "), F.col("id").cast("string")).alias("text"))
    tails = chat.last_turns(turns, chat.turns_for(keep))
    assert "WindowGroupLimit" in _plan(tails) and tails.count() == keep + 2
    got = chat.tokenize_pairs(chat.conversation_pairs(tails), keep).first()
    piece = lambda i: f"<|start_header_id|>{('user', 'assistant')[i % 2]}<|end_header_id|>\n\nwords of {i}<|eot_id|>"
    whole = "".join(map(piece, range(n - 200, n)))
    assert got.tokens_j == whole.split()[-keep:] and got.tokens_k == "".join(map(piece, range(n - 200, n - 1))).split()[-keep:]


def test_tails_give_the_sequences_of_whole_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", " ", "one", "two words", "a b c d e", None])) for c in range(40) for t in range(rng.randrange(1, 30))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").na.fill("")
    seqs = lambda df: sorted(map(str, chat.pairs_to_sequences(chat.tokenize_pairs(chat.conversation_pairs(df), 5)).collect()))
    assert seqs(turns) == seqs(chat.last_turns(turns, chat.turns_for(5)))


# ------------------------------------------------------------------ V2, V3 at the reference size

def test_encode_at_the_original_dimensions(spark):
    """d 2048, L 16384, k 64: tasks write the weights, the driver never holds a row of them."""
    d, L, k = 2048, 16384, 64
    value = lambda a, b, salt: ((F.xxhash64(a, b, F.lit(salt)) % 1000) / 1000.0)
    lat = spark.range(0, L, 1, 16).select(F.col("id").cast("int").alias("latent"), F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: value(F.col("id"), i, 1)).alias("enc"))
    lat = lat.withColumn("dec", F.col("enc")).withColumn("latent_bias", F.col("latent") % 7 * 0.5)
    pre = spark.range(1).select(F.array_repeat(F.lit(0.01), d).alias("pre_bias"))
    lat.write.mode("overwrite").parquet(path := sink.scratch_path(spark, "big-dictionary"))
    dictionary = FeatureDictionary(spark.read.parquet(path), pre)
    x = spark.range(0, 12, 1, 3).select("id", F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: value(F.col("id"), i, 2)).alias("x"))
    calls = []
    whole = vec._weight_files
    try:
        vec._weight_files = lambda *a: calls.append(whole(*a)) or calls[-1]
        rows = vec.encode(x, dictionary, k, ["id"]).collect()
    finally:
        vec._weight_files = whole
    assert len(calls[0].enc) == 2 and not calls[0].dec
    assert len(rows) == 12 * k
    import pyarrow.parquet as pq
    enc = pq.read_table(path.removeprefix("file:"), columns=["latent", "enc"]).sort_by("latent")["enc"].combine_chunks().flatten().to_numpy().reshape(L, d)
    own = {r.id: np.array(r.x) for r in x.collect()}
    for i, v in own.items():
        want = (v - 0.01) @ enc.T + np.arange(L) % 7 * 0.5
        top = np.argsort(-want, kind="stable")[:k]
        got = {r.latent: r.value for r in rows if r.id == i}
        assert set(got) == set(top.tolist()) and all(got[j] == pytest.approx(want[j], abs=1e-9) for j in got)


# ------------------------------------------------------------------ K3, W9

def test_one_sorted_context_file(spark, tmp_path):
    rows = [(latent, c, k, f"text {latent} \"é\"\n{k}", 5.0 - k / 3) for latent in (3, 17, 100, 2000) for c in ("", "ġa", "b") for k in (1, 2, 3)]
    top = spark.createDataFrame(rows, "latent int, token_class string, ctx_rank int, context string, value double")
    keep = spark.createDataFrame([(100,), (3,), (2000,)], "latent int")
    meta = {"threshold": 0.0, "max_length": 128, "max_per_token": 10, "lines": 4}
    made = []
    for parts in ("1", "2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            sink.write_context_file(top.repartition(5), keep, meta, f"{tmp_path}/{parts}.json")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        with open(f"{tmp_path}/{parts}.json", encoding="utf-8") as f:
            made.append(f.read())
    want = {"total_latents": 3, **meta, "latent_context_map": {str(n): {c: [{"context": x, "activation": v} for m, d, _, x, v in rows if (m, d) == (n, c)]
                                                                         for c in ("", "b", "ġa")} for n in (3, 100, 2000)}}
    assert set(made) == {json.dumps(want, ensure_ascii=False, indent=4)}
    back = src.read_context_map(spark, f"{tmp_path}/9.json")
    assert sorted(map(tuple, back.collect())) == sorted((str(n), c, x, v) for n, c, _, x, v in rows if n != 17)
    sink.write_context_file(top, keep.limit(0), meta, f"{tmp_path}/none.json")
    with open(f"{tmp_path}/none.json", encoding="utf-8") as f:
        assert f.read() == json.dumps({"total_latents": 0, **meta, "latent_context_map": {}}, indent=4)


# ------------------------------------------------------------------ T9

def test_given_vectors_are_not_shuffled(spark, tmp_path):
    given = spark.range(3000).select((F.col("id") % 50).alias("doc_id"), (F.col("id") % 3).alias("chunk_id"), F.expr("cast(id div 150 as int)").alias("pos"),
                                     F.transform(F.sequence(F.lit(1), F.lit(2048)), lambda i: i * F.col("id") / 7.0).alias("vec"))
    table = txo.store_vectors(given, "given_vectors_test", ["doc_id", "chunk_id"], 5, f"{tmp_path}/given")
    segs = given.filter("pos % 4 = 1").select("doc_id", "chunk_id", F.col("pos").alias("end_pos"), F.lit(0).alias("seg_no"))
    out = txo.gather_vectors(segs, table, ["doc_id", "chunk_id"], 5)
    rows = out.select("doc_id", "chunk_id", "end_pos", F.element_at("vec", 2).alias("v")).collect()
    assert sorted(map(tuple, rows)) == sorted((i % 50, i % 3, i // 150, 2 * i / 7.0) for i in range(3000) if i // 150 % 4 == 1)
    plan = _plan(out)
    scan = plan[plan.index("FileScan parquet"):]
    side = plan[:plan.index("FileScan parquet")].rsplit("SortMergeJoin", 1)[1]
    assert "Bucketed: true" in scan
    assert side.count("Exchange") == 1  # that of the segments
