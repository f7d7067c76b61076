"""Source/sink round trips on tables Spark derives from the test data.

Each query writes its input with a sink into a fresh folder under the shared
checkpoint folder and returns what the matching source reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.config import DROP_SHARES, FLIP_SHARES, TEST, Params
from pairlens.operators import chat
from pairlens.operators import contexts as ctx
from pairlens.operators import features as feat
from pairlens.operators import interpret as itp
from pairlens.plans import corpus, discovery, inputs
from pairlens.session import shuffles_dropped
from pairlens.sinks import files as sink
from pairlens.sources import arrow_dataset
from pairlens.sources import files as src


def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a JSON-lines corpus (line order = doc_id), read back."""
    path = sink.scratch_path(spark, "jsonl")
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    sink.write_jsonl_corpus(docs, [F.col("doc_id")], path, ["doc_id", "text"])
    return src.read_jsonl_corpus(spark, path, glob="*.txt")


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair texts written chosen-then-rejected per pair; identity from line numbers."""
    path = sink.scratch_path(spark, "pairs-jsonl")
    long = inputs.pair_side_texts(spark, sf_dir, inputs.pair_keys(spark, sf_dir)).withColumn(
        "p", F.col("pair_id") * 2 - F.when(F.col("side") == "chosen", 1).otherwise(0))
    sink.write_jsonl_corpus(long, [F.col("p")], path, ["text"])
    return src.line_pairs(src.read_jsonl_corpus(spark, path, glob="*.txt"))


def feature_tsv(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """K1 + S4 + J1: chosen and rejected sums written as two TSV files, read
    back, joined on the feature id and contrasted."""
    sums = discovery.vector_feature_sums(spark, sf_dir, p)
    pc, pr = sink.scratch_path(spark, "chosen"), sink.scratch_path(spark, "rejected")
    sink.write_tsv(sums.select("latent", "v_chosen"), pc)
    sink.write_tsv(sums.select("latent", "v_rejected"), pr)
    a = src.read_feature_values(spark, pc).withColumnRenamed("value", "v_chosen")
    b = src.read_feature_values(spark, pr).withColumnRenamed("value", "v_rejected")
    return feat.feature_contrast(a.join(b, "latent", "inner"))


def id_lists(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """K2 + S5: the ranked feature list written one id per line, rank read back."""
    path = sink.scratch_path(spark, "ids")
    sink.write_ranked_ids(discovery.top_vector_features(spark, sf_dir, p), path)
    return src.read_id_list(spark, path)


def contrast_scan(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """K1 + S6: contrast rows as ``latent diff chosen rejected`` text, read back."""
    path = sink.scratch_path(spark, "contrast")
    c = discovery.vector_contrast(spark, sf_dir, p)
    sink.write_tsv(c.select("latent", "diff", "v_chosen", "v_rejected"), path)
    return src.read_contrast(spark, path)


def _contexts(spark: SparkSession, sf_dir: str, p: Params) -> tuple[DataFrame, DataFrame, dict]:
    top = corpus.corpus_top_contexts(corpus.run_pairs(spark, sf_dir, p))
    return top, ctx.context_features(top, p.max_classes, p.min_lines), {
        "threshold": 0.0, "max_length": p.window, "max_per_token": p.contexts_per_class, "lines": p.min_lines}


def _read_contexts(spark: SparkSession, path: str) -> DataFrame:
    # the metadata row goes with every context
    return src.read_context_map(spark, path).crossJoin(F.broadcast(src.read_context_meta(spark, path).select("total_latents", "lines")))


def context_json(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """K3 + S7: the context map as nested JSON, flattened back."""
    path = sink.scratch_path(spark, "context")
    sink.write_context_map(*_contexts(spark, sf_dir, p), path)
    return _read_contexts(spark, path)


def context_file(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """K3 + W9 + S7: the context map as one sorted JSON file, flattened back."""
    path = sink.scratch_path(spark, "context-file") + ".json"
    sink.write_context_file(*_contexts(spark, sf_dir, p), path)
    return _read_contexts(spark, path)


def interpretation_json(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """K4 + S7: interpretation results and summary as JSON, read back."""
    resp = inputs.responses(spark, sf_dir)
    results = itp.interpretation_results(inputs.response_keys(spark, sf_dir), resp)
    summary = itp.score_summary(results, itp.request_costs(resp, inputs.prices(spark), p.engine), p.engine)
    path = sink.scratch_path(spark, "interpret")
    sink.write_interpretation(results, summary, path)
    back, total = src.read_interpretation(spark, path)
    # the summary row goes with every result
    return back.crossJoin(F.broadcast(total.select("engine", "features_scored", "average_score", "cost")))


def score_scan(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """K5 + S8: pair scores in the ``pair_id score`` text format, read back."""
    run = corpus.run_pairs(spark, sf_dir, p)
    path = sink.scratch_path(spark, "scores")
    sink.write_pair_scores(corpus.corpus_scores(run, spark, sf_dir), path)
    return src.read_pair_scores(spark, path)


def dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a preference dataset folder with a ``train`` and a ``test`` split."""
    path = sink.scratch_path(spark, "dataset")
    pairs = inputs.pairs(spark, sf_dir)
    arrow_dataset.write_splits({"train": pairs, "test": pairs.limit(0)}, path)
    return src.read_preference_dataset(spark, path)


def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 without ids: pairs in order, their number is their place in the dataset."""
    path = sink.scratch_path(spark, "dataset-rows")
    arrow_dataset.write(inputs.pairs(spark, sf_dir, in_order=True).select("chosen", "rejected"), path)
    rows = arrow_dataset.numbered(spark, path, ["chosen", "rejected"])
    return rows.select((F.col("row") + 1).alias("pair_id"), "chosen", "rejected")


def preference_sequences(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """S3 on message arrays through T11, T12 and T13: a preference dataset with
    chosen and rejected conversations, written with a ``train`` split, read back,
    rendered, tokenized and laid out as reward-model sequences."""
    path = sink.scratch_path(spark, "messages")
    arrow_dataset.write_splits({"train": chat.conversation_pairs(inputs.table(spark, sf_dir, "conversations"))}, path)
    return chat.pairs_to_sequences(chat.tokenize_pairs(src.read_preference_dataset(spark, path), p.rm_max_length))


def variant_scan(spark: SparkSession, sf_dir: str, p: Params = TEST) -> DataFrame:
    """K6: the flip set and the drop set, each in one write; every variant's
    content read back from its own folder."""
    from pairlens.operators import curate
    run = corpus.run_pairs(spark, sf_dir, p)
    scored = curate.attach_scores(inputs.pairs_from_keys(spark, sf_dir, run.keys), corpus.corpus_scores(run, spark, sf_dir))
    flips, drops = sink.scratch_path(spark, "flip-variants"), sink.scratch_path(spark, "drop-variants")
    flip_names, drop_names = [curate.flip_name(s) for s in FLIP_SHARES], [curate.drop_name(s) for s in DROP_SHARES]
    with shuffles_dropped(spark):  # both writes deal the texts
        sink.write_variants(curate.flip_variants(scored, grouped=True), flips, flip_names)
        sink.write_variants(curate.drop_variants(scored, grouped=True), drops, drop_names)
    return src.read_variants(spark, flips, flip_names).unionByName(src.read_variants(spark, drops, drop_names))


def dictionary_scan(spark: SparkSession, sf_dir: str, p: Params = TEST):
    """The dictionary written as parquet and read back."""
    path = sink.scratch_path(spark, "dictionary")
    sink.write_dictionary(inputs.full_dictionary(spark, sf_dir), path)
    return src.read_dictionary(spark, path)
