"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query runs over the whole test tables. Output columns are cast and
rounded the same way as the matching SQL in ``pairlens.plans.oracle``
(integers as bigint, doubles rounded to 6 decimals).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.config import MARKER, REFERENCE, TEST, Params
from pairlens.functions.arrays import explode_indexed, round6
from pairlens.operators import chat, curate
from pairlens.operators import contexts as ctx
from pairlens.operators import evaluate as ev
from pairlens.operators import interpret as itp
from pairlens.operators import scoring as sco
from pairlens.operators import text as txo
from pairlens.operators import vectors as vec
from pairlens.operators.ranking import sample_ids, seeded_shuffle
from pairlens.operators.validate import violations
from pairlens.plans import corpus, discovery, inputs
from pairlens.plans import roundtrip as rt
from pairlens.session import stored
from pairlens.sinks.files import scratch_path
from pairlens.sources.tables import spread
from pairlens.streaming import feature_stream as fs

P = TEST
MARKER_RE = re.escape(MARKER)
Query = Callable[[SparkSession, str], DataFrame]


def _long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


def _dbl(c: str) -> F.Column:
    return round6(c).alias(c)


# ---------------------------------------------------------------- step 1: vectors

def q_feature_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.full_dictionary(spark, sf_dir)
    return d.latents.select(
        "latent", "latent_bias",
        explode_indexed(F.arrays_zip("enc", "dec")).alias("dim", "w"),
    ).select(_long("latent"), _long("dim"), round6("w.enc").alias("enc"),
             round6("w.dec").alias("dec"), _dbl("latent_bias"))


def q_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = vec.zscore(inputs.side_vectors(spark, sf_dir), "vec", "x", P.eps)
    return z.select("vec_id", "mean", "std", explode_indexed("x").alias("dim", "x")).select(
        _long("vec_id"), _long("dim"), _dbl("x"), _dbl("mean"), _dbl("std"))


def q_sparse_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = discovery.vector_activations(spark, sf_dir, P)
    return acts.select(_long("vec_id"), "side", _long("latent"), _dbl("value"),
                       (F.col("value") > 0).alias("active"))


def q_feature_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = discovery.vector_feature_sums(spark, sf_dir, P)
    return s.select(_long("latent"), _dbl("v_chosen"), _dbl("v_rejected"))


def q_feature_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = discovery.vector_contrast(spark, sf_dir, P)
    return c.select(_long("latent"), _dbl("diff"), _dbl("v_chosen"), _dbl("v_rejected"))


def q_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = discovery.top_vector_features(spark, sf_dir, P)
    return t.select(_long("rank"), _long("latent"), _dbl("diff"), _dbl("v_chosen"), _dbl("v_rejected"))


QUERIES: dict[str, Query] = {
    "feature_dictionary": q_feature_dictionary,
    "zscore": q_zscore,
    "sparse_encode": q_sparse_encode,
    "feature_sums": q_feature_sums,
    "feature_contrast": q_feature_contrast,
    "top_features": q_top_features,
}


# ---------------------------------------------------------------- steps 2-3: text


DOC_KEYS = ["doc_id"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"), DOC_KEYS)


def _csv(col: str) -> F.Column:
    return F.array_join(F.transform(col, lambda v: v.cast("string")), ",")


def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = txo.normalize_text(_docs(spark, sf_dir))
    return d.select(_long("doc_id"), "norm", F.size(F.split("norm", " ", -1)).cast("long").alias("n_words"))


def q_mark_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = txo.mark_boundaries(txo.normalize_text(_docs(spark, sf_dir)))
    n_marks = F.size(F.split("marked", F.lit(MARKER_RE), -1)) - 1
    return d.select(_long("doc_id"), "marked", n_marks.cast("long").alias("n_marks"))


def q_chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = txo.chunk_words(_docs(spark, sf_dir), DOC_KEYS, P.chunk_words, P.min_tail)
    return c.select(_long("doc_id"), _long("chunk_id"), _long("start"), "chunk")


def q_chunk_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = txo.chunk_plain(_docs(spark, sf_dir), DOC_KEYS, P.plain_words, P.plain_min_tail)
    return c.select(_long("doc_id"), _long("chunk_id"), _long("start"), "chunk")


def _doc_sequences(spark: SparkSession, sf_dir: str, p: Params = P) -> DataFrame:
    c = txo.chunk_words(_docs(spark, sf_dir), DOC_KEYS, p.chunk_words, p.min_tail)
    return txo.to_sequences(c, p.max_length)


def q_fixed_length_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _doc_sequences(spark, sf_dir)
    return s.select(_long("doc_id"), _long("chunk_id"), _long("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"),
                    F.array_join(F.transform("mask", lambda m: m.cast("string")), "").alias("mask"))


def q_plain_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = txo.chunk_plain(_docs(spark, sf_dir), DOC_KEYS, P.plain_words, P.plain_min_tail)
    seqs = txo.to_sequences(c, P.plain_words)
    rows = [txo.used_tokens(seqs, pad).select(
        _long("doc_id"), _long("chunk_id"), F.lit(pad).alias("include_pad"), F.size("tokens").cast("long").alias("n"),
        F.array_join("tokens", " ").alias("tokens")) for pad in (False, True)]
    return rows[0].union(rows[1])


def q_segment_ends(spark: SparkSession, sf_dir: str, p: Params = P) -> DataFrame:
    s = txo.segment_ends(_doc_sequences(spark, sf_dir, p), p.gap)
    return s.select(_long("doc_id"), _long("chunk_id"), F.size("cands").cast("long").alias("n_cands"),
                    _csv("cands").alias("cands"), _csv("ends").alias("ends"))


def q_reference_segment_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T8 at the original's settings: 944 words, 1024 tokens."""
    return q_segment_ends(spark, sf_dir, REFERENCE)


def doc_segment_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = txo.segment_ends(_doc_sequences(spark, sf_dir), P.gap)
    return txo.segments(seqs, DOC_KEYS, P.vector_width)


def q_segment_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = doc_segment_vectors(spark, sf_dir)
    return (v.select("doc_id", "chunk_id", "seg_no", "end_pos", F.inline(txo.bucket_counts()))
            .select(_long("doc_id"), _long("chunk_id"), _long("seg_no"), _long("end_pos"),
                    _long("bucket"), _long("n")))


def q_given_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 on vectors that come from outside: one for every candidate position, here 8 numbers of the position."""
    # positions only, read by both sides
    seqs = stored(txo.segment_ends(_doc_sequences(spark, sf_dir), P.gap).select("doc_id", "chunk_id", "cands", "ends"), "ends")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.col("doc_id") * 31 + F.col("chunk_id") * 7 + F.col("pos") * 3
    given = seqs.select("doc_id", "chunk_id", F.explode("cands").alias("pos")).withColumn(
        "vec", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(at + i * 11, F.lit(97)) / 97.0))
    name = f"given_vectors_{uuid.uuid4().hex}"
    vectors = txo.store_vectors(given, name, ["doc_id", "chunk_id"], n, scratch_path(spark, name))
    segs = seqs.select("doc_id", "chunk_id", F.posexplode("ends").alias("seg_no", "end_pos"))
    v = txo.gather_vectors(segs, vectors, ["doc_id", "chunk_id"], n)
    return (v.select("doc_id", "chunk_id", "seg_no", "end_pos", F.posexplode("vec").alias("dim", "value"))
            .select(_long("doc_id"), _long("chunk_id"), _long("seg_no"), _long("end_pos"), _long("dim"), _dbl("value")))


QUERIES.update({
    "given_vectors": q_given_vectors,
    "normalize_text": q_normalize_text,
    "mark_boundaries": q_mark_boundaries,
    "chunk_words": q_chunk_words,
    "chunk_plain": q_chunk_plain,
    "fixed_length_sequences": q_fixed_length_sequences,
    "plain_sequences": q_plain_sequences,
    "segment_ends": q_segment_ends,
    "reference_segment_ends": q_reference_segment_ends,
    "segment_vectors": q_segment_vectors,
})


# ---------------------------------------------------------------- steps 4, 6, 7: pair corpus



def q_corpus_feature_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.corpus_contrast(corpus.run_sums(spark, sf_dir, P))
    return c.select(_long("latent"), _dbl("diff"), _dbl("v_chosen"), _dbl("v_rejected"))


def q_segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sco.segment_counts(corpus.segment_ends_of_pairs(spark, sf_dir, P))
    return c.select(_long("pair_id"), _long("n_chosen"), _long("n_rejected"))


def q_signed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.corpus_signed_sums(corpus.run_pairs(spark, sf_dir, P), spark, sf_dir)
    return s.select(_long("pair_id"), _dbl("s_chosen"), _dbl("s_rejected"))


def q_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.corpus_scores(corpus.run_pairs(spark, sf_dir, P), spark, sf_dir)
    return s.select(_long("pair_id"), _dbl("saescore"))


def q_activation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.corpus_contexts(corpus.run_chunks(spark, sf_dir, P))
    return c.select(_long("pair_id"), "side", _long("chunk_id"), _long("seg_no"), _long("end_pos"),
                    _long("latent"), _dbl("value"), "context", "token_class")


def q_top_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus.corpus_top_contexts(corpus.run_pairs(spark, sf_dir, P))
    return t.select(_long("latent"), "token_class", _long("ctx_rank"), _dbl("value"), "context")


def q_token_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus.corpus_token_contexts(corpus.run_chunks(spark, sf_dir, P, token_class=True))
    return t.select(_long("latent"), "token_class", _long("ctx_rank"), _dbl("value"), "context")


def q_context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = corpus.run_pairs(spark, sf_dir, P)
    f = ctx.context_features(corpus.corpus_top_contexts(run), P.max_classes, P.min_lines)
    return f.select(_long("latent"), _long("n_classes"), _long("n_contexts"))


def q_feature_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = corpus.corpus_prompts(corpus.run_pairs(spark, sf_dir, P))
    return pr.select(_long("latent"), "prompt")


def q_interpretation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus.corpus_results(corpus.run_pairs(spark, sf_dir, P), spark, sf_dir)
    return r.select("latent_key", _long("latent"), _long("score"), "explanation")


def q_safety_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.safety_list(corpus.run_pairs(spark, sf_dir, P), spark, sf_dir)
    return s.select(_long("rank"), _long("latent"))


def q_scored_safety_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.safety_list(corpus.run_pairs(spark, sf_dir, P), spark, sf_dir, keep_unscored=False)
    return s.select(_long("rank"), _long("latent"))


def q_signed_feature_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.signed_lists(corpus.run_pairs(spark, sf_dir, P), spark, sf_dir)
    return s.select(_long("rank"), _long("latent"), _dbl("diff"), _long("sign"))


def q_parse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = itp.interpretation_results(inputs.response_keys(spark, sf_dir), inputs.responses(spark, sf_dir))
    return r.select("latent_key", _long("latent"), _long("score"), "explanation")


def q_request_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = itp.request_costs(inputs.responses(spark, sf_dir), inputs.prices(spark), P.engine)
    return c.select(_long("latent"), _long("n_in"), _long("n_out"), _dbl("cost"))


def q_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    resp = inputs.responses(spark, sf_dir)
    r = itp.interpretation_results(inputs.response_keys(spark, sf_dir), resp)
    c = itp.request_costs(resp, inputs.prices(spark), P.engine)
    s = itp.score_summary(r, c, P.engine)
    return s.select("engine", _long("features_scored"), _dbl("average_score"), _dbl("cost"))


QUERIES.update({
    "corpus_feature_contrast": q_corpus_feature_contrast,
    "segment_counts": q_segment_counts,
    "signed_sums": q_signed_sums,
    "pair_scores": q_pair_scores,
    "activation_contexts": q_activation_contexts,
    "top_contexts": q_top_contexts,
    "token_contexts": q_token_contexts,
    "context_features": q_context_features,
    "feature_prompts": q_feature_prompts,
    "interpretation_results": q_interpretation_results,
    "safety_features": q_safety_features,
    "scored_safety_features": q_scored_safety_features,
    "signed_feature_lists": q_signed_feature_lists,
    "parse_scores": q_parse_scores,
    "request_cost": q_request_cost,
    "score_summary": q_score_summary,
})


# ---------------------------------------------------------------- step 5: curation



def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = corpus.run_pairs(spark, sf_dir, P)
    return curate.attach_scores(inputs.pairs_from_keys(spark, sf_dir, run.keys), corpus.corpus_scores(run, spark, sf_dir))


def q_scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select(_long("pair_id"), "chosen", "rejected", _dbl("saescore"))


def q_flip_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = curate.flip_variants(_scored(spark, sf_dir))
    return f.select("variant", _long("pair_id"), _long("rank"), "chosen", "rejected", _dbl("saescore"))


def q_drop_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = curate.drop_variants(_scored(spark, sf_dir))
    return d.select("variant", _long("pair_id"), _long("rank"), "chosen", "rejected", _dbl("saescore"))


QUERIES.update({
    "scored_pairs": q_scored_pairs,
    "flip_variants": q_flip_variants,
    "drop_variants": q_drop_variants,
})


# ---------------------------------------------------------------- step 8: reconstruction metrics



def _reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.test_dictionary(spark, sf_dir, P.latent_size)
    z = vec.zscore(inputs.side_vectors(spark, sf_dir), "vec", "x", P.eps)
    return vec.reconstruct(z, d, P.k, keys=["vec_id", "batch", "seq", "x", "mean", "std"])


def q_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = vec.undo_zscore(_reconstructed(spark, sf_dir), "x_hat", "y_hat")
    z = F.arrays_zip("x_hat", "y_hat")
    return (r.select("vec_id", explode_indexed(z).alias("dim", "v"))
            .select(_long("vec_id"), _long("dim"), round6("v.x_hat").alias("x_hat"), round6("v.y_hat").alias("y_hat")))


def q_normalized_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.normalized_mse_both(_reconstructed(spark, sf_dir), "batch")
    return m.select(_dbl("nmse"), _dbl("nmse_batch_mean"), _long("n_skipped"))


def q_kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ev.kl_divergence(_reconstructed(spark, sf_dir), "x", "x_hat", "seq")
    return k.select(_dbl("kl"), _long("n_sequences"))


def q_kl_divergence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 with the logits in blocks of 16 entries."""
    rows = _reconstructed(spark, sf_dir)
    block = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.struct(
        F.slice("x", b * 16 + 1, F.lit(16)).alias("x"), F.slice("x_hat", b * 16 + 1, F.lit(16)).alias("x_hat"))))
    k = ev.kl_divergence_blocks(rows.select("vec_id", "seq", block.alias("b")).select("vec_id", "seq", "b.*"), "vec_id", "seq", "x", "x_hat")
    return k.select(_dbl("kl"), _long("n_sequences"))


QUERIES.update({
    "kl_divergence_blocks": q_kl_divergence_blocks,
    "reconstruct": q_reconstruct,
    "normalized_mse": q_normalized_mse,
    "kl_divergence": q_kl_divergence,
})


# ---------------------------------------------------------------- step 9: chat, ordering, reward metrics



def _chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = inputs.table(spark, sf_dir, "conversations")
    return chat.conversation_pairs(turns)


def _chat_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with only the turns that the last tokens come from."""
    turns = inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_pairs(chat.last_turns(turns, chat.turns_for(P.rm_max_length)))


def q_render_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chat_pairs(spark, sf_dir)
    return c.select(_long("pair_id"), _long("n_turns"),
                    chat.render_messages(F.col("chosen")).alias("chosen"),
                    chat.render_messages(F.col("rejected")).alias("rejected"))


def q_tokenize_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chat.tokenize_pairs(_chat_tails(spark, sf_dir), P.rm_max_length)
    return t.select(_long("pair_id"),
                    F.size("tokens_j").cast("long").alias("n_j"), F.size("tokens_k").cast("long").alias("n_k"),
                    F.array_join("tokens_j", " ").alias("tokens_j"), F.array_join("tokens_k", " ").alias("tokens_k"))


def q_pairs_to_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chat.pairs_to_sequences(chat.tokenize_pairs(_chat_tails(spark, sf_dir), P.rm_max_length))
    return s.select(_long("pair_id"), "side", F.size("tokens").cast("long").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"),
                    F.aggregate("mask", F.lit(0), lambda a, m: a + m).cast("long").alias("mask_sum"))


def q_seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seeded_shuffle(inputs.pairs(spark, sf_dir).select("pair_id"), "pair_id", P.seed)
    return s.select(_long("pair_id"), _long("position"))


def q_sample_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = inputs.table(spark, sf_dir, "documents").select("doc_id")
    return sample_ids(ids, "doc_id", P.sample_features, P.seed).select(_long("doc_id"))


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.rewards(spark, sf_dir, inputs.pairs(spark, sf_dir))


def q_preference_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ev.preference_accuracy(_rewards(spark, sf_dir))
    return a.select(_dbl("accuracy"), _long("n_pairs"))


def q_pairwise_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ev.pairwise_loss(_rewards(spark, sf_dir))
    return a.select(_dbl("loss"), _long("n_pairs"))


def q_pairwise_loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 on a long table: rewards in row order, chosen and rejected in turn."""
    r = _rewards(spark, sf_dir).select(F.explode(F.array(
        F.struct((F.col("pair_id") * 2).alias("row"), F.col("r_chosen").alias("reward")),
        F.struct((F.col("pair_id") * 2 + 1).alias("row"), F.col("r_rejected").alias("reward")))).alias("x")).select("x.*")
    a = ev.pairwise_loss(ev.adjacent_pairs(r, "row"))
    return a.select(_dbl("loss"), _long("n_pairs"))


QUERIES.update({
    "pairwise_loss_rows": q_pairwise_loss_rows,
    "render_chat": q_render_chat,
    "tokenize_pairs": q_tokenize_pairs,
    "pairs_to_sequences": q_pairs_to_sequences,
    "seeded_shuffle": q_seeded_shuffle,
    "sample_features": q_sample_features,
    "preference_accuracy": q_preference_accuracy,
    "pairwise_loss": q_pairwise_loss,
})


# ---------------------------------------------------------------- step 10: sources and sinks



def q_jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.jsonl_scan(spark, sf_dir).select(_long("line_no"), "text")


def q_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.line_pairs(spark, sf_dir).select(_long("pair_id"), "side", "text")


def q_feature_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.feature_tsv(spark, sf_dir, P).select(_long("latent"), _dbl("diff"), _dbl("v_chosen"), _dbl("v_rejected"))


def q_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.id_lists(spark, sf_dir, P).select(_long("rank"), _long("latent"))


def q_contrast_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.contrast_scan(spark, sf_dir, P).select(_long("latent"), _dbl("diff"))


def q_context_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.context_json(spark, sf_dir, P).select(_long("latent_key"), "token_class", "context", _dbl("activation"),
                                                      _long("total_latents"), _long("lines"))


def q_context_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.context_file(spark, sf_dir, P).select(_long("latent_key"), "token_class", "context", _dbl("activation"),
                                                    _long("total_latents"), _long("lines"))


def q_interpretation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.interpretation_json(spark, sf_dir, P).select(
        "latent_key", _long("score"), "explanation", "engine", _long("features_scored"), _dbl("average_score"), _dbl("cost"))


def q_score_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.score_scan(spark, sf_dir, P).select(_long("pair_id"), _dbl("saescore"))


def q_dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.dataset_scan(spark, sf_dir).select(_long("pair_id"), "chosen", "rejected")


def q_dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.dataset_rows(spark, sf_dir).select(_long("pair_id"), "chosen", "rejected")


def q_variant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.variant_scan(spark, sf_dir, P).select(
        "variant", _long("pair_id"), _long("rank"), "chosen", "rejected", _dbl("saescore"))


def q_preference_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rt.preference_sequences(spark, sf_dir, P)
    return s.select(_long("pair_id"), "side", F.size("tokens").cast("long").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"),
                    F.aggregate("mask", F.lit(0), lambda a, m: a + m).cast("long").alias("mask_sum"))


def q_dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rt.dictionary_scan(spark, sf_dir, P)
    return d.latents.select("latent", "latent_bias", explode_indexed(F.arrays_zip("enc", "dec")).alias("dim", "w")).select(
        _long("latent"), _long("dim"), round6("w.enc").alias("enc"), round6("w.dec").alias("dec"), _dbl("latent_bias"))


def q_validate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the stored top-k rows before V4 (half of all features here, so some aren't positive)
    acts = discovery.vector_activations(spark, sf_dir, P.with_(k=P.latent_size // 2)).withColumn(
        "mode", F.when(F.col("side") == "chosen", 0).otherwise(1))
    v = violations(acts, P.latent_size)
    return v.select(_long("vec_id"), _long("latent"), _dbl("value"), _long("mode"), "violation")


QUERIES.update({
    "jsonl_scan": q_jsonl_scan,
    "line_pairs": q_line_pairs,
    "feature_tsv": q_feature_tsv,
    "id_lists": q_id_lists,
    "contrast_scan": q_contrast_scan,
    "context_json": q_context_json,
    "context_file": q_context_file,
    "interpretation_json": q_interpretation_json,
    "score_scan": q_score_scan,
    "dataset_scan": q_dataset_scan,
    "dataset_rows": q_dataset_rows,
    "variant_scan": q_variant_scan,
    "preference_sequences": q_preference_sequences,
    "dictionary_scan": q_dictionary_scan,
    "validate_features": q_validate_features,
})


# ---------------------------------------------------------------- streaming



def q_stream_feature_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 as a streaming aggregate over the documents folder (runs to the end of
    the available input, then reports the dense sums)."""
    name = f"stream_sums_{uuid.uuid4().hex[:8]}"
    labels = inputs.table(spark, sf_dir, "labels")
    d = inputs.test_dictionary(spark, sf_dir, P.latent_size)
    q = fs.start_feature_sums(spark, sf_dir, labels, d, P, name, glob="documents.parquet")
    q.awaitTermination()
    return fs.dense_sums(spark, name, P.latent_size).select(_long("latent"), _dbl("v_chosen"), _dbl("v_rejected"))


QUERIES["stream_feature_sums"] = q_stream_feature_sums
