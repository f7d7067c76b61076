"""Preference-pair pipeline: texts -> segments -> sparse activations ->
feature contrast -> contexts -> interpretation -> safety lists -> pair scores.

What several steps read is written once per run as Parquet in the shared
folder: the encode (a row per text with its sums per feature and the contexts
that can be among the strongest; or, where all contexts are asked for or classes
come from tokens, the chunk table without pads and masks, which follow from the
token count), and the small tables of sums, contexts, signs and scores. Nothing is
kept between runs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.config import EOS, TEST, Params
from pairlens.operators import contexts as ctx
from pairlens.operators import features as feat
from pairlens.operators import interpret as itp
from pairlens.operators import scoring as sco
from pairlens.operators import text as txo
from pairlens.operators import vectors as vec
from pairlens.operators.ranking import sample_ids
from pairlens.plans import inputs
from pairlens.session import checkpoint_dir, shuffles_dropped, stored

PAIR_KEYS = ["pair_id", "side"]
CHUNK_KEYS = PAIR_KEYS + ["chunk_id"]
#: The contexts of token classes are ranked in so many passes over features, which bounds what is dealt out at a time.
RANK_PASSES = 4
SEG_KEYS = CHUNK_KEYS + ["seg_no", "end_pos", "end_ok"]


def pair_sequences(spark: SparkSession, sf_dir: str, keys: DataFrame, p: Params, flagged: bool = False) -> DataFrame:
    """T1-T8 over both texts of every pair: chunk sequences (real tokens) with segment ends. A text becomes many
    chunks, so the texts are dealt out to all tasks first, by the join that brings them."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = inputs.pair_side_texts(spark, sf_dir, keys, flagged, n)
    chunks = txo.chunk_words(texts, [*PAIR_KEYS, *(["repeated"] if flagged else [])], p.chunk_words, p.min_tail)
    return txo.segment_ends(txo.to_sequences(chunks, p.max_length, pads=False), p.gap)


def context_tokens(chunks: DataFrame, p: Params, *more: str) -> DataFrame:
    """Tokens for context windows, from the stored chunk table: of the pads only the first can bound one."""
    bound = F.when(F.col("n_tokens") < p.max_length, F.array(F.lit(EOS))).otherwise(F.array().cast("array<string>"))
    return chunks.select(*CHUNK_KEYS, F.concat("words", bound).alias("tokens"), *more)


@dataclass
class PairRun:
    """One run over the corpus; the small tables are made when first asked for."""
    keys: DataFrame
    rows: DataFrame      # the encode: a row per text or per chunk
    sums: DataFrame      # per row, the sum of each feature's active values: pair_id, side, latent, value
    p: Params
    derived: dict

    def once(self, name: str, build) -> DataFrame:
        if name not in self.derived:
            self.derived[name] = stored(build(), name)
        return self.derived[name]


def _chunks(spark: SparkSession, sf_dir: str, keys: DataFrame, p: Params) -> DataFrame:
    seqs = pair_sequences(spark, sf_dir, keys, p, flagged=True)
    return seqs.select(*CHUNK_KEYS, "repeated", F.size("tokens").alias("n_tokens"), F.col("tokens").alias("words"), "ends")


def _run(keys: DataFrame, rows: DataFrame, p: Params) -> PairRun:
    sums = rows.select(*PAIR_KEYS, F.explode("sums").alias("f")).select(*PAIR_KEYS, "f.latent", "f.value")
    return PairRun(keys, rows, sums, p, {})


def run_sums(spark: SparkSession, sf_dir: str, p: Params = TEST) -> PairRun:
    """Chunk the pair corpus and encode its segments for one use of the sums: they are not stored."""
    keys = inputs.pair_keys(spark, sf_dir)
    return _run(keys, vec.encode_texts(_chunks(spark, sf_dir, keys, p), PAIR_KEYS, inputs.test_dictionary(spark, sf_dir, p.latent_size), p.k,
                                       p.vector_width, p.max_length, eps=p.eps), p)


def run_pairs(spark: SparkSession, sf_dir: str, p: Params = TEST) -> PairRun:
    """Chunk the pair corpus and encode its segments, all in one pass that is stored by text: sums, number of segments
    and the contexts of strong activations."""
    keys = inputs.pair_keys(spark, sf_dir)
    texts = vec.encode_texts(_chunks(spark, sf_dir, keys, p), PAIR_KEYS, inputs.test_dictionary(spark, sf_dir, p.latent_size), p.k,
                             p.vector_width, p.max_length, p.contexts_per_class, p.window, p.eps)
    with shuffles_dropped(spark):
        return _run(keys, stored(texts, "texts"), p)


def run_chunks(spark: SparkSession, sf_dir: str, p: Params = TEST, token_class: bool = False) -> PairRun:
    """As ``run_pairs``, stored by chunk with its tokens: with every segment's active features, or with ``token_class`` with the
    strong activations per class, which carry the token at their segment's end."""
    keys = inputs.pair_keys(spark, sf_dir)
    emit, carried = ("strong", "sums") if token_class else ("segs", "sums"), [*CHUNK_KEYS, "repeated", "n_tokens", "words"]
    chunks, more = _chunks(spark, sf_dir, keys, p), {}
    if token_class:  # the rows are met again by their place, and copies of a chunk told by its hash
        chunks, carried, more = chunks.withColumn("same", F.xxhash64("words")), [*carried, "same"], {"copies": "same", "sums_by": "side"}
    rows = vec.encode_chunks(chunks, inputs.test_dictionary(spark, sf_dir, p.latent_size), p.k, p.vector_width, p.max_length,
                             p.contexts_per_class, p.eps, token_class, emit=emit, carried=carried, **more)
    with shuffles_dropped(spark):
        if token_class:
            return _run(keys, stored(_placed(rows), "chunks", "zstd"), p)
        return _run(keys, stored(rows, "chunks"), p)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows to be stored with the place that they get there."""
    return rows.withColumn("place", F.monotonically_increasing_id())


def segment_ends_of_pairs(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """``pair_id, side, n_ends`` of every chunk; nothing is written."""
    seqs = pair_sequences(spark, sf_dir, inputs.pair_keys(spark, sf_dir), p)
    return seqs.select("pair_id", "side", F.size("ends").alias("n_ends"))


def corpus_sums(run: PairRun) -> DataFrame:
    return run.once("sums", lambda: feat.feature_sums(run.sums, run.p.latent_size))


def corpus_contrast(run: PairRun) -> DataFrame:
    return feat.feature_contrast(corpus_sums(run))


def corpus_top(run: PairRun) -> DataFrame:
    """W1 on the corpus contrast: the ranked feature list the context step uses."""
    return feat.top_by_abs(corpus_contrast(run), run.p.contrast_top)


def corpus_contexts(run: PairRun) -> DataFrame:
    """T14 + T15 for activations of the ranked features (J2 first); ``run`` is that of ``run_chunks``."""
    listed = run.once("listed", lambda: corpus_top(run).select("latent"))
    once = context_tokens(run.rows.filter(~F.col("repeated")), run.p, "segs")
    own = feat.keep_listed(ctx.chunk_contexts(once, CHUNK_KEYS, run.p.window), listed)
    # where a side has more texts than one, its activations meet the tokens of each
    more = run.rows.filter("repeated")
    segs = more.select(*CHUNK_KEYS, F.explode("segs").alias("s"))
    acts = (segs.select(*CHUNK_KEYS, "s.seg_no", "s.end_pos", "s.end_ok", F.explode("s.feats").alias("f"))
            .select(*SEG_KEYS, "f.latent", "f.value"))
    met = ctx.activation_contexts(feat.keep_listed(acts, listed), context_tokens(more, run.p), CHUNK_KEYS, run.p.window)
    return own.unionByName(met.select(own.columns))


def corpus_strongest(run: PairRun) -> DataFrame:
    """W4 over the contexts that the text rows hold; only repeated texts' activations are joined to tokens."""
    entries = run.rows.select(*PAIR_KEYS, F.explode("strong").alias("s")).select(*PAIR_KEYS, "s.*")
    strong = feat.keep_listed(entries, corpus_top(run)).withColumn("end_ok", F.lit(True))
    words = run.rows.filter(F.size("chunks") > 0).select(*PAIR_KEYS, F.explode("chunks").alias("c")).select(
        *PAIR_KEYS, "c.chunk_id", F.size("c.words").alias("n_tokens"), "c.words")
    return ctx.strongest_contexts(strong, context_tokens(words, run.p), CHUNK_KEYS, run.p.window, run.p.contexts_per_class)


def corpus_top_contexts(run: PairRun) -> DataFrame:
    """``corpus_strongest``. At most contexts_per_class x classes rows per
    ranked feature, so the table is small; it is stored on first use and
    shared by the interpretation, safety and scoring steps."""
    return run.once("top-contexts", lambda: corpus_strongest(run))


def corpus_token_contexts(run: PairRun) -> DataFrame:
    """T15 with real token classes and W4: the strongest contexts per ranked feature and token; ``run`` is that of
    ``run_chunks`` with ``token_class``. Most tokens are rare, so that nearly all activations of the rows are among the
    strongest of their class, and their contexts are many times the input: they are ranked by value without them, some
    features at a time, and the ranked ones stored by the place of their chunk. Windows are then cut in the chunk
    rows; only those of equal values are dealt out, to be ranked by context."""
    spark, n = run.rows.sparkSession, run.p.contexts_per_class
    listed = run.once("listed", lambda: corpus_top(run).select("latent"))
    if "place" not in run.rows.columns:
        run.rows = stored(_placed(run.rows.withColumn("same", F.xxhash64("words"))), "chunks", "zstd")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tables/places-{uuid.uuid4().hex}"
    once, more = run.rows.filter(~F.col("repeated")), run.rows.filter("repeated")
    some = not more.isEmpty()
    features = sorted(r.latent for r in listed.distinct().collect())  # at most contrast_top
    classed = ctx.token_class(F.col("s.end_token")).alias("token_class")
    with shuffles_dropped(spark):
        for k in range(RANK_PASSES):
            mine = F.col("s.latent").isin(features[k::RANK_PASSES])
            acts = once.select("place", "same", F.explode("strong").alias("s")).filter(mine).select(
                "place", "s.end_pos", "s.latent", "s.value", classed, F.lit(None).cast("string").alias("context"),
                F.xxhash64("same", "s.end_pos").alias("same"))
            if some:  # where a side has more texts than one, its activations meet the tokens of each
                apart = more.select(*CHUNK_KEYS, F.explode("strong").alias("s")).filter(mine).select(
                    *CHUNK_KEYS, "s.end_pos", "s.latent", "s.value", classed)
                met = ctx.cut_contexts(apart, context_tokens(more, run.p), CHUNK_KEYS, run.p.window)
                acts = acts.unionByName(met.select(F.lit(None).cast("bigint").alias("place"), "end_pos", "latent", "value", "token_class", "context",
                                                   F.xxhash64("context").alias("same")))
            ranked = ctx.ranked_places(acts, n)
            own = F.col("context").isNull()
            placed = ranked.select(F.when(own, F.shiftright("place", ctx.PLACE_BITS)).otherwise(-1).cast("int").alias("part"), "place", "end_pos",
                                   "latent", "value", "rank", "tied", F.when(~own, F.col("token_class")).alias("token_class"), "context")
            (placed.repartition("part", F.when(~own, F.xxhash64("context"))).sortWithinPartitions("part", "place", "end_pos", "latent")
             .write.mode("append").partitionBy("part").parquet(folder, compression="zstd"))
    apart = spark.read.schema(placed.schema).parquet(folder).filter("part = -1")

    def rows(tied: bool) -> DataFrame:
        cut = ctx.cut_placed(once, folder, tied, run.p.window, run.p.max_length)
        cut = cut.withColumn("token_class", ctx.token_class(F.col("end_token"))).drop("end_token")
        return cut.unionByName(apart.filter(F.col("tied") == tied).select(cut.columns)) if some else cut
    single = rows(False).withColumn("ctx_rank", F.col("rank"))
    return single.unionByName(ctx.rank_tied(rows(True), n)).drop("rank")


def context_feature_set(run: PairRun) -> DataFrame:
    """A13 then W8: the features the interpretation step sees."""
    kept = ctx.context_features(corpus_top_contexts(run), run.p.max_classes, run.p.min_lines)
    return sample_ids(kept.select("latent"), "latent", run.p.sample_features, run.p.seed)


def corpus_prompts(run: PairRun) -> DataFrame:
    by_feature = ctx.contexts_by_feature(corpus_top_contexts(run), context_feature_set(run))
    return itp.feature_prompts(by_feature)


def corpus_results(run: PairRun, spark: SparkSession, sf_dir: str) -> DataFrame:
    features = context_feature_set(run).select(F.col("latent").cast("string").alias("latent_key"))
    return itp.interpretation_results(features, inputs.responses(spark, sf_dir))


def safety_list(run: PairRun, spark: SparkSession, sf_dir: str, keep_unscored: bool = True) -> DataFrame:
    """J4 + W2: ranked features whose score is null (unless ``keep_unscored`` is off) or >= threshold, first n."""
    results = corpus_results(run, spark, sf_dir).filter(F.col("latent").isNotNull())
    return feat.safety_filter(corpus_top(run).select("rank", "latent"), results,
                              run.p.score_threshold, run.p.safety_top, keep_unscored)


def signed_lists(run: PairRun, spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + W3: contrast rows of the safety features, top by |diff|, split by sign
    (at most sign_top rows, stored once per run)."""
    def build():
        rows = feat.restrict_contrast(corpus_contrast(run), safety_list(run, spark, sf_dir))
        return feat.split_by_sign(feat.top_by_abs(rows, run.p.sign_top))
    return run.once("signs", build)


def corpus_segment_counts(run: PairRun) -> DataFrame:
    return sco.segment_counts(run.rows)


def corpus_signed_sums(run: PairRun, spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 + J2 (keep activations of the safe or unsafe features) then J3 + A5."""
    signs = signed_lists(run, spark, sf_dir)
    keep = feat.keep_set(signs.filter("sign > 0"), signs.filter("sign < 0"))
    return sco.signed_sums(feat.keep_listed(run.sums, keep), signs)


def corpus_scores(run: PairRun, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 for every pair (``pair_id, saescore``), stored once per run: the
    curation, the score file and the variants all read it."""
    return run.once("scores", lambda: sco.pair_scores(
        inputs.pair_ids(run.keys), corpus_segment_counts(run), corpus_signed_sums(run, spark, sf_dir)))
