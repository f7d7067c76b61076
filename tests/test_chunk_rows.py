"""Activations held in their chunk's row, against rows of segments and activations."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.config import EOS, MARKER
from pairlens.functions import text as tx
from pairlens.operators import contexts as ctx
from pairlens.operators import text as txo
from pairlens.operators import vectors as vec
from pairlens.sources import arrow_dataset

WIDTH, LENGTH, K = 16, 40, 3


@pytest.fixture(scope="module")
def sequences(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(
        F.lit("w"), ((F.col("id") * 7 + i * i) % 13).cast("string"), F.when((i + F.col("id")) % 6 == 5, ".").otherwise("")))
    texts = spark.range(40).select("id", F.when(F.col("id") % 10 == 9, f"{EOS} a. b c d e f. é\xa0 g").otherwise(F.array_join(words, " ")).alias("text"))
    chunks = txo.chunk_words(texts, ["id"], 24, 2)
    return txo.segment_ends(txo.to_sequences(chunks, LENGTH), 4), txo.segment_ends(txo.to_sequences(chunks, LENGTH, pads=False), 4)


@pytest.fixture(scope="module")
def dictionary(spark):
    rows = spark.range(6).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.sin(
        (F.col("id") * 5 + i).cast("double"))).alias("v"))
    return vec.dictionary_from_vectors(rows, "vec_id", "v")


def test_chunk_rows_hold_the_same_activations(sequences, dictionary):
    padded, real = sequences
    keys = ["id", "chunk_id", "seg_no", "end_pos", "end_ok"]
    plain = vec.active(vec.encode(txo.segments(padded, ["id"], WIDTH), dictionary, K, keys, "buckets", counts_width=WIDTH))
    want = {tuple(r[:6]): r.value for r in plain.collect()}
    chunks = real.select("id", "chunk_id", F.col("tokens").alias("words"), "ends")
    got = vec.encode_chunks(chunks, dictionary, K, WIDTH, LENGTH, 2, end_token=True)
    rows = got.select("id", "chunk_id", F.inline("segs")).select(*keys, F.inline("feats"))
    found = {tuple(r[:6]): r.value for r in rows.collect()}
    assert len(want) > 100 and found == pytest.approx(want)
    strong = {(r.id, r.chunk_id, r.seg_no, r.latent) for r in got.select("id", "chunk_id", F.inline("strong")).collect()}
    for latent in {k[5] for k in want}:
        values = sorted((v for k, v in want.items() if k[5] == latent and k[4]), reverse=True)
        top = {(*k[:3], latent) for k, v in want.items() if k[5] == latent and k[4] and v >= values[:2][-1]}
        assert top <= strong
    tokens = {(r.id, r.chunk_id): r.tokens for r in real.select("id", "chunk_id", "tokens").collect()}
    for r in got.select("id", "chunk_id", F.inline("strong")).collect():
        assert r.end_token == tokens[r.id, r.chunk_id][r.end_pos]


def test_windows_are_cut_in_the_chunk_row(sequences, dictionary):
    """No token array and no activation is dealt out, and the rows are those of the join."""
    padded, real = sequences
    chunks = real.select("id", "chunk_id", F.col("tokens").alias("words"), "ends")
    held = vec.encode_chunks(chunks, dictionary, K, WIDTH, LENGTH, 2).withColumn("tokens", F.concat("words", F.array(F.lit(EOS)))).localCheckpoint()
    own = ctx.chunk_contexts(held, ["id", "chunk_id"], 10)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    acts = held.select("id", "chunk_id", F.inline("segs")).select("id", "chunk_id", "seg_no", "end_pos", "end_ok", F.inline("feats"))
    met = ctx.activation_contexts(acts, held.select("id", "chunk_id", "tokens"), ["id", "chunk_id"], 10)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, met.select(own.columns).collect())) and own.count() > 100


def test_blank_runs_are_evened_out(spark):
    blanks = [" ", "  ", "\t", "\xa0", "  ", "　 ", "\n", " \x85\x1c ", "​", "\r\n  \x0b"]
    texts = [f"{a}a{b}é{c}ß.{a}" for a in blanks for b in blanks for c in blanks] + ["", " ", "\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = lambda t: " ".join(((t or "") + ("" if (t or "").endswith("\n") else "\n")).replace("\n", " <N> ").split()).replace("<N>", "\n")
    for r in df.select("text", tx.normalize("text").alias("n")).collect():
        assert r.n == plain(r.text)
    assert MARKER in df.select(tx.mark_boundaries(tx.normalize("text")).alias("m")).first().m


def test_batches_of_a_dataset_are_bounded(spark, tmp_path):
    """24 MB of long rows in one partition: no batch of a shard much over the bound."""
    n = 2400
    df = spark.range(0, n, 1, 1).select("id", F.repeat(F.concat(F.col("id").cast("string"), F.lit("x" * 50)), 200).alias("chosen"))
    arrow_dataset.write(df, f"{tmp_path}/d")
    sizes = []
    for f in (tmp_path / "d").glob("*.arrow"):
        with pa.OSFile(str(f)) as src, pa.ipc.open_stream(src) as stream:
            sizes += [b.nbytes for b in stream]
    assert len(sizes) >= 3 and max(sizes) <= 1.2 * arrow_dataset.BATCH_BYTES
    assert arrow_dataset.read(spark, f"{tmp_path}/d").select("id").distinct().count() == n
    assert spark.conf.get(arrow_dataset._BATCH_CONF) != str(arrow_dataset.BATCH_BYTES)
