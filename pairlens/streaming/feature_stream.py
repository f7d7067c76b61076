"""Feature sums over a stream of documents (A1 as an incremental aggregate).

The text, segment and encode operators are stateless per row, so they run
unchanged on a streaming DataFrame; only the per-feature sums keep state (at
most L groups). The labels are a static table joined to the stream. The
query's checkpoint lives in the shared checkpoint folder, so a restarted
driver resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlens.config import Params
from pairlens.operators import features as feat
from pairlens.operators import text as txo
from pairlens.operators import vectors as vec
from pairlens.session import checkpoint_dir

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def labelled_documents(stream: DataFrame, labels: DataFrame, partitions: int) -> DataFrame:
    """Stream-static join: good labelled documents are chosen, the other labelled
    ones rejected; those without a label take the side of their id as in the pair
    corpus (even: chosen). The labels are joined by a shuffle on doc_id (the label table
    grows with the corpus, so it is not broadcast); the same shuffle spreads the
    text work of a micro-batch over ``partitions`` tasks, whatever the file
    layout of the batch."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("doc_id") % 2 == 0)
    side = F.when(good, F.lit("chosen")).otherwise(F.lit("rejected"))
    docs = stream.select("doc_id", "text").repartition(partitions, "doc_id")
    return docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left").select("doc_id", side.alias("side"), "text")


def stream_activations(docs: DataFrame, dictionary: vec.FeatureDictionary, p: Params) -> DataFrame:
    keys = ["doc_id", "side"]
    chunks = txo.chunk_words(docs, keys, p.chunk_words, p.min_tail)
    seqs = txo.segment_ends(txo.to_sequences(chunks, p.max_length), p.gap)
    segs = txo.segments(seqs, keys, p.vector_width)
    acts = vec.encode(segs, dictionary, p.k, keys=keys + ["chunk_id", "seg_no"], vec_col="buckets",
                      counts_width=p.vector_width, eps=p.eps)
    return vec.active(acts)


def start_feature_sums(spark: SparkSession, source_dir: str, labels: DataFrame,
                       dictionary: vec.FeatureDictionary, p: Params, name: str,
                       glob: str | None = None, available_now: bool = True,
                       files_per_batch: int = 1000) -> StreamingQuery:
    """Start the streaming sums over the parquet files arriving in ``source_dir``
    (optionally only names matching ``glob``); results go to the in-memory
    table ``name`` (at most L rows), state and progress to the shared
    checkpoint folder. Every micro-batch reads the label keys once, so a batch
    takes up to ``files_per_batch`` files."""
    reader = spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.parquet(source_dir)
    docs = labelled_documents(stream, labels, spark.sparkContext.defaultParallelism)
    acts = stream_activations(docs, dictionary, p)
    sums = acts.groupBy("latent").agg(
        F.sum(F.when(F.col("side") == "chosen", F.col("value")).otherwise(0.0)).alias("v_chosen"),
        F.sum(F.when(F.col("side") == "rejected", F.col("value")).otherwise(0.0)).alias("v_rejected"))
    # one folder per query name: restarting a query with the same name resumes it
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    writer = (sums.writeStream.outputMode("complete").format("memory").queryName(name)
              .option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def dense_sums(spark: SparkSession, name: str, latent_size: int) -> DataFrame:
    """The current sums of the in-memory table, dense over 0..L-1."""
    acts_like = spark.table(name).select(
        "latent", F.lit("chosen").alias("side"), F.col("v_chosen").alias("value")).unionByName(
        spark.table(name).select("latent", F.lit("rejected").alias("side"), F.col("v_rejected").alias("value")))
    return feat.feature_sums(acts_like, latent_size)
