"""What the encode and the windows of its strongest activations leave out gives the same rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairlens.config import EOS, MARKER
from pairlens.operators import contexts as ctx
from pairlens.operators import text as txo
from pairlens.operators import vectors as vec
from pairlens.plans import corpus


def test_windows_of_activations_are_cut_in_arrow_batches(spark):
    chunks = spark.createDataFrame([(1, ["a", "b", MARKER, "c", EOS]), (2, ["x", "é"]), (2, ["y"]), (3, []), (None, ["n"])],
                                   "id long, tokens array<string>")
    acts = spark.createDataFrame([(1, 0, 7, 0.5), (1, 0, 8, 0.25), (1, 3, 7, 1.0), (1, 4, 7, 1.0), (1, 9, 7, 1.0), (2, 0, 7, 2.0), (2, 0, 7, 2.0),
                                  (2, 1, 9, 3.0), (2, None, 9, 3.0), (3, 0, 7, 1.0), (None, 0, 7, 1.0), (4, 0, 7, 1.0)],
                                 "id long, end_pos int, latent int, value double")
    got = ctx.cut_contexts(acts, chunks, ["id"], 4)
    want = ctx.with_context(acts.join(chunks, "id"), "tokens", "end_pos", 4).filter("context is not null").drop("tokens")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "transform(" not in plan


def test_windows_look_at_the_asked_rows_only():
    rows = [[f"w{i}", "b", "c"] for i in range(500)]
    held = pa.array(rows, pa.list_(pa.string()))

    class Words:
        """An Arrow list column that counts the rows taken from it."""
        offsets, values, taken = held.offsets, None, None

        def __len__(self):
            return len(held)

        def take(self, at):
            self.taken = at.to_pylist()
            return held.take(at)

    words = Words()
    got = txo.batch_windows(words, np.array([400, 7, 400]), np.array([1, 0, 0]), 10)
    assert got.to_pylist() == ["w400 <ACTIVATED>", "<ACTIVATED>  b", "<ACTIVATED>  b"] and words.taken == [7, 400]
    assert txo.batch_windows(words, np.zeros(0, np.int64), np.zeros(0, np.int64), 10).to_pylist() == []


def test_activations_below_the_strongest_are_not_sorted(spark, monkeypatch):
    texts = spark.range(0, 400, 1, 1).select("id", F.lit(False).alias("repeated"), F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 7 + i * i) % 31).cast("string"), F.when(i % 6 == 5, ".").otherwise(""))),
        " ").alias("text"))
    seqs = txo.segment_ends(txo.to_sequences(txo.chunk_words(texts, ["id", "repeated"], 24, 2), 40, pads=False), 4)
    chunks = seqs.select("id", "repeated", "chunk_id", F.col("tokens").alias("words"), "ends").orderBy("id", "chunk_id").toArrow().combine_chunks()
    rng = np.random.default_rng(3)

    class Weights(vec.WeightFiles):
        def tiles(self, names):
            return [rng_rows]

    rng_rows = rng.normal(size=(6, 16))
    w = Weights([], [], np.arange(6, dtype=np.int32), np.zeros(6), np.zeros(16))
    sorted_, largest = [], vec._largest
    monkeypatch.setattr(vec, "_largest", lambda values, group, n: sorted_.append(len(values)) or largest(values, group, n))
    out = list(vec._encode_texts_fn(["id"], 16, 40, 1e-6, 3, w, 8192, 2, 10)(chunks.to_batches(max_chunksize=600)))
    every = list(vec._encode_texts_fn(["id"], 16, 40, 1e-6, 3, w, 8192, 10 ** 6, 10)(chunks.to_batches(max_chunksize=600)))
    rows = lambda bs: [x for b in bs for own in b.column("strong").to_pylist() for x in own]
    total = len(rows(every))
    assert total > 3000 and sum(sorted_[:4]) < total / 2
    top = lambda own: {j: sorted((round(x["value"], 9) for x in own if x["latent"] == j), reverse=True)[:2] for j in range(6)}
    assert top(rows(out)) == top(rows(every)) and len(rows(out)) < total / 2


def test_token_contexts_are_cut_in_the_rows_and_dealt_once(spark):
    words = ["alpha", "beta", "alpha", "gamma", MARKER, "delta", "beta"]
    strong = [(0, 2, 0, 0.5, "Alpha"), (1, 5, 0, 0.25, "delta"), (1, 5, 1, 0.125, "delta")]
    schema = ("pair_id long, side string, chunk_id int, repeated boolean, n_tokens int, words array<string>, "
              "strong array<struct<seg_no: int, end_pos: int, latent: int, value: double, end_token: string>>")
    rows = spark.createDataFrame([(1, "chosen", 0, False, 7, words, strong), (2, "chosen", 0, True, 7, words, strong[:1]),
                                  (2, "chosen", 0, True, 7, [w if w == MARKER else w.upper() for w in words], strong[:1])], schema)
    run = corpus.PairRun(None, rows, None, corpus.TEST, {"listed": spark.createDataFrame([(0,)], "latent int")})
    got = corpus.corpus_token_contexts(run)
    assert sorted((r.latent, r.token_class, r.ctx_rank, r.context) for r in got.collect()) == sorted(
        [(0, "alpha", k + 1, c) for k, c in enumerate(sorted(  # each of the repeated text's activations meets both texts
            ["alpha beta <ACTIVATED>  gamma delta beta"] + 2 * ["alpha beta <ACTIVATED>  gamma delta beta", "ALPHA BETA <ACTIVATED>  GAMMA DELTA BETA"], reverse=True))]
        + [(0, "delta", 1, "alpha beta alpha gamma <ACTIVATED>  beta")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") <= 1 and "WindowGroupLimit" in plan
