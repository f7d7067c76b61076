"""Registered queries of the training-data operators: thin digests of each operator's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import (contamination, conversations, language, lexical, packing, prefix_counts, quality, secrets, simhash,
                          substrings, token_codes, toxicity, urls)
from pairlens.llm.common import fresh_path, stored, table
from pairlens.llm.sql import SQL  # noqa: F401  (registered by __spark_entry__)


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-codes")
    token_codes.write(table(spark, sf_dir, "documents"), folder)
    return token_codes.documents(spark, folder)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", substrings.digest("kept").alias("kept_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs, name="p").select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score", "p.rejected")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = contamination.mark(docs, table(spark, sf_dir, "benchmark"), name="hits")
    return hits.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), contamination.n_hit("hits").alias("n_hit"),
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
        contamination.contaminated("hits").alias("contaminated"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.empty_ledger(spark))
    base = secrets.of_kind(F.col("findings"), *(r.kind for r in secrets.BASE_RULES))
    count = lambda kind: F.size(secrets.of_kind(F.col("findings"), kind)).cast("bigint")
    return found.select(
        F.col("path").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("findings")).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.verdicts(docs, name="q").select("doc_id", "q.*")


def op8_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = stored(prefix_counts.prefix_table(docs, name="p").select("doc_id", "p"), "prefixes")
    answered = counted.select("doc_id", "p.n_bytes", prefix_counts.tokens_at("p", F.col("p.n_chars")).alias("n_tokens"),
                              prefix_counts.truncation("p", limit).alias("limit_chars"))
    return answered.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.classes(docs).select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.contract_rows(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.detect(docs, table(spark, sf_dir, "labels"), name="score")
    return scored.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (
    op1_token_codes, op2_substring_dedup, op3_language, op4_decontaminate, op5_packing, op6_secrets, op7_quality_rules,
    op8_token_counts, op9_url_filters, op10_simhash, op11_conversation_repair, op12_lexical_search,
    op13_toxicity)}
