"""File sources.

Line order matters for several inputs (pair identity comes from the line
number; id lists are ranked by line order): ``sources.lines`` numbers lines
while it reads them.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.vectors import FeatureDictionary
from pairlens.sources import arrow_dataset
from pairlens.sources.lines import numbered_lines


def json_field(line: bytes, field: str) -> str | None:
    """A field of a JSON line as the original's parser reads it: '' if the field is missing, None if
    the line does not parse or is no object. Values that are no strings come as JSON."""
    try:
        record = json.loads(line.decode("utf-8", "replace").strip())
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    value = record.get(field)
    if value is None:
        return ""
    # a lone surrogate (an escape without its partner) is no text
    value = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return value.encode("utf-8", "replace").decode("utf-8")


def read_jsonl_corpus(spark: SparkSession, path: str, field: str = "text",
                      glob: str = "*.jsonl") -> DataFrame:
    """JSON-lines corpus. Every line takes a number, bad lines included;
    lines that do not parse are dropped; a missing field gives ''.
    Output ``line_no, file, text``."""
    lines = numbered_lines(spark, path, glob, each=lambda line: json_field(line, field))
    return lines.withColumnRenamed("value", "text")


def bad_lines(spark: SparkSession, path: str, field: str = "text", glob: str = "*.jsonl") -> DataFrame:
    """S1's report: per file the number of lines and of those that do not parse."""
    lines = numbered_lines(spark, path, glob, each=lambda line: "bad" if json_field(line, field) is None else "")
    return lines.groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if(F.col("value") == "bad").alias("n_bad"))


def line_pairs(corpus: DataFrame) -> DataFrame:
    """Odd line = chosen, even = rejected, pair = (line + 1) div 2."""
    return corpus.select(
        F.expr("(line_no + 1) div 2").alias("pair_id"),
        F.when(F.col("line_no") % 2 == 1, F.lit("chosen")).otherwise(F.lit("rejected")).alias("side"),
        "text", "line_no")


def read_preference_dataset(spark: SparkSession, path: str) -> DataFrame:
    """S3: a preference dataset folder, its ``train`` split when there is one. Arrow dataset
    folders are known by their state file, others hold Parquet files."""
    if arrow_dataset.is_dataset(path) or arrow_dataset.is_dataset(os.path.join(path, "train")):
        return arrow_dataset.read(spark, path)
    train = os.path.join(path, "train")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(train)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(train if fs.exists(fs_path) else path)


def read_variants(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """K6 read back: the datasets of the named variants, tagged with ``variant``."""
    parts = [arrow_dataset.read(spark, f"{path.rstrip('/')}/{n}", split=None).withColumn("variant", F.lit(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_feature_values(spark: SparkSession, path: str) -> DataFrame:
    """``latent \\t value`` lines."""
    return spark.read.schema("latent INT, value DOUBLE").option("sep", "\t").csv(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line; rank = line order (1-based over kept lines), blank
    lines skipped, the leading integer of a line is the id."""
    lines = numbered_lines(spark, path, keep=r"[ \t\n\x0b\f\r]*[0-9]")
    return lines.select(F.col("line_no").alias("rank"), F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias("latent"))


def read_contrast(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated rows, fewer than 2 fields skipped; first field
    the feature, second the contrast value."""
    parts = spark.read.text(path).select(F.split(F.trim(F.col("value")), r"\s+").alias("f"))
    return (parts.filter((F.size("f") >= 2) & (F.col("f")[0] != ""))
            .select(F.col("f")[0].cast("int").alias("latent"),
                    F.col("f")[1].cast("double").alias("diff")))


CONTEXT_ROW = T.StructType([
    T.StructField("latent", T.StringType()),
    T.StructField("classes", T.MapType(T.StringType(), T.ArrayType(T.StructType([
        T.StructField("context", T.StringType()), T.StructField("activation", T.DoubleType())])))),
])


def _is_folder(spark: SparkSession, path: str) -> bool:
    """A folder that ``sinks.files`` wrote (several row files), rather than one JSON file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).isDirectory()


_CONTEXT_CLASSES = T.MapType(T.StringType(), T.ArrayType(T.StructType([
    T.StructField("context", T.StringType()), T.StructField("activation", T.DoubleType())])))


def read_context_map(spark: SparkSession, path: str) -> DataFrame:
    """A context map, flattened to ``latent_key, token_class, context, activation``.

    Reads the folder of ``sinks.files.write_context_map`` (one JSON object per
    feature) and the single-file layout: one JSON object with the features under
    ``latent_context_map``. A file of that layout holds the strongest contexts
    of one dictionary's features (bounded by L), so one task may parse it.
    """
    if _is_folder(spark, path):
        rows = spark.read.schema(CONTEXT_ROW).json(os.path.join(path, "features"))
        per_class = rows.select(F.col("latent").alias("latent_key"), F.explode("classes").alias("token_class", "items"))
    else:
        whole = spark.read.option("multiLine", True).schema(
            T.StructType([T.StructField("latent_context_map", T.MapType(T.StringType(), _CONTEXT_CLASSES))])).json(path)
        per_class = (whole.select(F.explode("latent_context_map").alias("latent_key", "classes"))
                     .select("latent_key", F.explode("classes").alias("token_class", "items")))
    return per_class.select("latent_key", "token_class", F.inline("items"))


def read_context_meta(spark: SparkSession, path: str) -> DataFrame:
    """The metadata row of a context map: ``total_latents, threshold, max_length, max_per_token, lines``."""
    kinds = "total_latents BIGINT, threshold DOUBLE, max_length BIGINT, max_per_token BIGINT, lines BIGINT"
    if _is_folder(spark, path):
        return spark.read.schema(kinds).json(os.path.join(path, "meta"))
    return spark.read.option("multiLine", True).schema(kinds).json(path)


RESULT_ROW = "latent STRING, score INT, explanation STRING"
SUMMARY_ROW = "cost DOUBLE, engine STRING, features_scored BIGINT, average_score DOUBLE"


def read_interpretation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Interpretation results ``latent_key, score, explanation`` and their
    summary row, from a folder of ``sinks.files.write_interpretation`` or from
    one JSON object with the results under ``results`` (a map by feature id)."""
    if _is_folder(spark, path):
        results = spark.read.schema(RESULT_ROW).json(os.path.join(path, "results"))
        summary = spark.read.schema(SUMMARY_ROW).json(os.path.join(path, "summary"))
        return results.withColumnRenamed("latent", "latent_key"), summary
    whole = spark.read.option("multiLine", True).schema(
        f"{SUMMARY_ROW}, results MAP<STRING, STRUCT<score: INT, explanation: STRING>>").json(path)
    results = whole.select(F.explode("results").alias("latent_key", "r")).select("latent_key", "r.score", "r.explanation")
    return results, whole.drop("results")


def read_pair_scores(spark: SparkSession, path: str) -> DataFrame:
    """``pair_id score`` lines; pair 0 is a placeholder and is dropped."""
    rows = spark.read.schema("pair_id BIGINT, saescore DOUBLE").option("sep", " ").csv(path)
    return rows.filter(F.col("pair_id") != 0)


def read_dictionary(spark: SparkSession, path: str) -> FeatureDictionary:
    """Dictionary folder with ``latents`` and ``pre_bias`` parquet tables."""
    latents = spark.read.schema(
        "latent INT, enc ARRAY<DOUBLE>, dec ARRAY<DOUBLE>, latent_bias DOUBLE").parquet(os.path.join(path, "latents"))
    pre_bias = spark.read.schema("pre_bias ARRAY<DOUBLE>").parquet(os.path.join(path, "pre_bias"))
    return FeatureDictionary(latents, pre_bias)
