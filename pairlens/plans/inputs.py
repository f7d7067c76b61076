"""Stand-in inputs derived from the generated test tables (FIXTURES.md part 2).

Every stand-in is computed by Spark from the given tables, so its size grows
with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.config import PRICES
from pairlens.operators.ranking import global_rank
from pairlens.operators.vectors import FeatureDictionary, dictionary_from_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a side: even label = chosen, odd = rejected."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("embedding").alias("vec"),
        F.when(F.col("label") % 2 == 0, F.lit("chosen")).otherwise(F.lit("rejected")).alias("side"),
        F.expr("vec_id div 8").alias("batch"),
        F.expr("vec_id div 4").alias("seq"),
    )


def full_dictionary(spark: SparkSession, sf_dir: str) -> FeatureDictionary:
    """V8 + V7 over all embeddings: one feature per vector."""
    return dictionary_from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def test_dictionary(spark: SparkSession, sf_dir: str, n_latents: int = 32) -> FeatureDictionary:
    """A dictionary of ``n_latents`` features (the model's size, fixed) from all
    embeddings: feature j is the mean of the vectors whose id is j modulo
    ``n_latents``. Sums per feature and dimension are partial per task."""
    dims = table(spark, sf_dir, "embeddings").select(
        F.pmod("vec_id", F.lit(n_latents)).cast("int").alias("latent"), F.posexplode("embedding").alias("dim", "v"))
    means = dims.groupBy("latent", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vectors = (means.groupBy("latent").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("_v"))
               .select("latent", F.col("_v.v").alias("vec")))
    return dictionary_from_vectors(vectors, "latent", "vec")


def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, pair_id, good``: consecutive documents by doc_id are the chosen
    (``good``) and the rejected side of a pair, as consecutive lines are in a
    pair corpus. Every document takes part; of an odd number the last one is the
    chosen side of a pair without a rejected one. Only keys are ranked and
    checkpointed, never texts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id")
    ranked = global_rank(docs, [F.col("doc_id")], "r")
    return ranked.select("doc_id", F.expr("r div 2 + 1").alias("pair_id"), (F.col("r") % 2 == 0).alias("good"))


def pair_ids(keys: DataFrame) -> DataFrame:
    """Pair ids, also of a pair with a chosen side only (no text read)."""
    return keys.filter("good").select("pair_id")


def pair_side_texts(spark: SparkSession, sf_dir: str, keys: DataFrame, flagged: bool = False, parts: int | None = None) -> DataFrame:
    """One row per (pair_id, side, text): texts join the ranked keys on doc_id. ``flagged`` adds ``repeated``: the
    document's id is there more than once, so that the pair's side has more texts than one. With ``parts`` the texts are
    dealt once, to as many tasks, and stream past a hash table of their task's keys instead of being sorted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if parts:
        docs, keys = docs.repartition(parts, "doc_id"), keys.repartition(parts, "doc_id")
    side = F.when(F.col("good"), F.lit("chosen")).otherwise(F.lit("rejected"))
    more = []
    if flagged:  # over ids only, dealt as the join needs them
        keys, more = keys.withColumn("repeated", F.count("*").over(Window.partitionBy("doc_id")) > 1), ["repeated"]
    keys = keys.hint("shuffle_hash") if parts else keys
    return keys.join(docs, "doc_id").select("pair_id", side.alias("side"), "text", *more)


def pairs_from_keys(spark: SparkSession, sf_dir: str, keys: DataFrame, in_order: bool = False) -> DataFrame:
    """``pair_id, chosen, rejected`` of the pairs with both sides: the dataset's rows. Texts are dealt once,
    by pair; ``in_order`` deals them by range, so that the rows come out in order of the pair."""
    texts = pair_side_texts(spark, sf_dir, keys)
    if in_order:
        texts = texts.repartitionByRange("pair_id")
    own = lambda side: F.first(F.when(F.col("side") == side, F.col("text")), ignorenulls=True).alias(side)
    both = texts.groupBy("pair_id").agg(own("chosen"), own("rejected"), F.count("*").alias("_n")).filter("_n = 2").drop("_n")
    return both.sortWithinPartitions("pair_id") if in_order else both


def pairs(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """Preference pairs ``pair_id, chosen, rejected`` of all documents."""
    return pairs_from_keys(spark, sf_dir, pair_keys(spark, sf_dir), in_order)


def response_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature key per conversation, and for every 7th one a key without a response and one that is no number."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    more = F.when(F.col("conv_id") % 7 == 0, F.array((-F.col("conv_id") - 1).cast("string"), F.concat(F.lit("x"), F.col("conv_id").cast("string"))))
    own = F.array(F.col("conv_id").cast("string"))
    return ids.select(F.explode(F.concat(own, F.coalesce(more, F.array().cast("array<string>")))).alias("latent_key"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpretation responses ``latent, response, n_in, n_out`` from all turns of all conversations: the
    feature is the conversation, the explanation its first assistant turn, the request twice as long as its other
    turns and the response as long as all assistant turns. After every 7th conversation one
    has only that turn, which can't be parsed; without an assistant turn there is no response."""
    turns = table(spark, sf_dir, "conversations")
    said = F.col("role") == "assistant"
    size = F.coalesce(F.length("text"), F.lit(0))
    first = turns.groupBy("conv_id").agg(
        F.min_by(F.when(said, F.col("text")), F.when(said, F.col("turn"))).alias("t"), F.count_if(said).alias("n"),
        F.sum(F.when(~said, size).otherwise(0)).alias("asked"), F.sum(F.when(said, size).otherwise(0)).alias("told")).filter("n > 0")
    t = F.coalesce("t", F.lit(""))
    text = F.when(F.col("conv_id") % 7 == 1, t).otherwise(
        F.concat(F.lit("Score: "), (F.lit(1) + F.col("conv_id") % 5).cast("string"), F.lit("\nExplanation: "), t, F.lit("\u00a0 ")))
    return first.select(
        F.col("conv_id").cast("int").alias("latent"),
        text.alias("response"),
        (F.lit(100) + F.col("asked") * 2).alias("n_in"),
        (F.lit(10) + F.col("told")).alias("n_out"),
    )


def prices(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("engine", T.StringType()),
                           T.StructField("price_in", T.DoubleType()),
                           T.StructField("price_out", T.DoubleType())])
    return spark.createDataFrame(list(PRICES), schema)


def rewards(spark: SparkSession, sf_dir: str, pairs_df: DataFrame) -> DataFrame:
    """``pair_id, r_chosen, r_rejected``: 100 x mean of vectors (2p) % n and (2p+1) % n."""
    emb = table(spark, sf_dir, "embeddings")
    n = emb.select(F.count("*")).scalar()
    means = emb.select("vec_id", (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
                                  / F.size("embedding") * 100.0).alias("m"))
    p = pairs_df.select("pair_id",
                        F.pmod(F.col("pair_id") * 2, n).alias("jc"),
                        F.pmod(F.col("pair_id") * 2 + 1, n).alias("jr"))
    # ``means`` has one row per vector; both joins are equi-joins on vec_id.
    return (p.join(means.select(F.col("vec_id").alias("jc"), F.col("m").alias("r_chosen")), "jc")
            .join(means.select(F.col("vec_id").alias("jr"), F.col("m").alias("r_rejected")), "jr")
            .select("pair_id", "r_chosen", "r_rejected"))
