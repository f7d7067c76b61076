"""The encode summed by text, and windows cut in Arrow batches."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.config import EOS, MARKER
from pairlens.operators import contexts as ctx
from pairlens.operators import text as txo
from pairlens.operators import vectors as vec
from pairlens.plans import corpus, inputs
from pairlens.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_windows_of_a_batch_are_those_of_the_column(spark):
    rnd = random.Random(7)
    words = ["a", "b\"", '"', "é", MARKER, MARKER, EOS, "[PAD]", "", " ", "c\t"]
    rows = [[rnd.choice(words) if rnd.random() < 0.5 else f"w{i}" for i in range(rnd.randint(0, 40))] for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, tokens array<string>")
    for window in (4, 9, 60):
        at = df.select("id", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens"))).alias("p"))
        want = {(r.id, r.p): r.context for r in ctx.with_context(at, "tokens", "p", window).collect()}
        row, pos = (np.array(x) for x in zip(*want))
        got = txo.batch_windows(pa.array(rows, pa.list_(pa.string())), row, pos, window).to_pylist()
        assert dict(zip(want, got)) == want
    bound = txo.batch_windows(pa.array([["x", "y"]]), np.array([0, 0]), np.array([0, 1]), 8, 3).to_pylist()
    assert bound == ["<ACTIVATED>  y", "x <ACTIVATED>"]


def test_texts_are_dealt_once_and_not_sorted(spark):
    keys = inputs.pair_keys(spark, SF)
    plan = corpus.pair_sequences(spark, SF, keys, corpus.TEST, flagged=True)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_sums_leave_nothing_of_the_corpus_behind(spark):
    folder = f"{checkpoint_dir(spark).removeprefix('file:')}/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus.corpus_contrast(corpus.run_sums(spark, SF)).count() == corpus.TEST.latent_size
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith(("chunks", "texts"))]


@pytest.mark.parametrize("copies", [1, 2])
def test_text_rows_sum_up_the_chunk_rows(spark, copies):
    words = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(
        F.lit("w"), ((F.col("id") * 7 + i * i) % 13).cast("string"), F.when((i + F.col("id")) % 6 == 5, ".").otherwise("")))
    texts = spark.range(0, 40, 1, 3).select("id", F.lit(copies > 1).alias("repeated"), F.array_join(words, " ").alias("text"))
    seqs = txo.segment_ends(txo.to_sequences(txo.chunk_words(texts, ["id", "repeated"], 24, 2), 40, pads=False), 4)
    chunks = seqs.select("id", "repeated", "chunk_id", F.col("tokens").alias("words"), "ends").localCheckpoint()
    rows = spark.range(6).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sin(
        (F.col("id") * 5 + i).cast("double"))).alias("v"))
    d = vec.dictionary_from_vectors(rows, "vec_id", "v")
    held = vec.encode_chunks(chunks, d, 3, 16, 40, 2).localCheckpoint()
    got = vec.encode_texts(chunks, ["id"], d, 3, 16, 40, 2, 10).localCheckpoint()
    acts = held.select("id", "chunk_id", F.inline("segs")).select("id", "chunk_id", "seg_no", "end_pos", "end_ok", F.inline("feats"))
    total = lambda df: {(r.id, r.latent): r.v for r in df.groupBy("id", "latent").agg(F.sum("value").alias("v")).collect()}
    assert total(got.select("id", F.inline("sums"))) == pytest.approx(total(acts)) and acts.count() > 100
    assert got.agg(F.sum("n_ends")).first()[0] == chunks.agg(F.sum(F.size("ends"))).first()[0]
    tokens = chunks.select("id", "chunk_id", F.concat("words", F.array(F.lit(EOS))).alias("tokens"))
    strong = got.select("id", F.inline("strong")).withColumn("end_ok", F.lit(True))
    assert strong.filter(F.col("context").isNull()).count() == (strong.count() if copies > 1 else 0)
    assert got.select("id", F.inline("chunks")).count() == (chunks.count() if copies > 1 else 0)
    top = lambda a: {(r.latent, r.ctx_rank): (round(r.value, 6), r.context) for r in ctx.strongest_contexts(
        a, tokens, ["id", "chunk_id"], 10, 2).collect()}
    assert top(strong) == top(acts) != {}
