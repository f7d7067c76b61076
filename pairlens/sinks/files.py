"""File sinks (K1-K6).

Ordered outputs (id lists, line-numbered corpora) are written from a global
sort: each task writes one contiguous range to its own part file, and part
file names sort in range order, so reading the files back in name order gives
the sorted order without a single writer.
"""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.session import checkpoint_dir
from pairlens.operators.vectors import FeatureDictionary
from pairlens.sources import arrow_dataset
from pairlens.sources.paths import open_path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex}")


def write_tsv(df: DataFrame, path: str) -> None:
    """K1: tab-separated, no header (feature sums, contrast rows)."""
    df.write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def write_ordered_lines(df: DataFrame, order: list, value: F.Column, path: str) -> None:
    """Lines in a global order (K2 id lists, line-numbered corpora)."""
    df.orderBy(*order).select(value.alias("value")).write.mode("overwrite").text(path)


def write_ranked_ids(ranked: DataFrame, path: str) -> None:
    """K2: one id per line in rank order."""
    write_ordered_lines(ranked, [F.col("rank")], F.col("latent").cast("string"), path)


def write_jsonl_corpus(df: DataFrame, order: list, path: str, fields: list[str]) -> None:
    """JSON-lines corpus in a global line order (input of S1/S2)."""
    write_ordered_lines(df, order, F.to_json(F.struct(*fields)), path)


def write_context_map(top: DataFrame, features: DataFrame, meta: dict, path: str) -> None:
    """K3: one JSON object per kept feature ``{latent, classes: {class: [{context,
    activation}]}}`` (contexts by activation desc), plus one metadata object.
    Nothing is gathered beyond one feature's bounded context list."""
    kept = top.join(F.broadcast(features.select("latent")), "latent", "left_semi")
    per_class = (kept.groupBy("latent", "token_class")
                 .agg(F.array_sort(F.collect_list(F.struct("ctx_rank", "context", F.col("value").alias("activation"))))
                      .alias("items")))
    items = F.transform("items", lambda s: F.struct(s["context"].alias("context"), s["activation"].alias("activation")))
    per_feature = (per_class.groupBy("latent")
                   .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token_class", items))))
                        .alias("classes")))
    (per_feature.select(F.col("latent").cast("string").alias("latent"), "classes")
     .write.mode("overwrite").json(os.path.join(path, "features")))
    spark = top.sparkSession
    n = per_feature.count()
    spark.createDataFrame([dict(meta, total_latents=n)]).write.mode("overwrite").json(os.path.join(path, "meta"))


def _context_fragments(batches):
    """A feature's part of the context file, as the original's writer lays it out."""
    for batch in batches:
        out = []
        for latent, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {latent: {c: [{"context": x["context"], "activation": x["activation"]} for x in items] for c, items in classes}}
            body = json.dumps(own, ensure_ascii=False, indent=4)
            out.append("\n".join("    " + line for line in body.split("\n")[1:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_context_file(top: DataFrame, features: DataFrame, meta: dict, path: str) -> None:
    """K3 + W9 as one sorted JSON file: features by number, classes by name, contexts by activation. Tasks
    write the features' text in range order; the parts are then joined in order, as streams, so
    the file is the same whatever the partitioning."""
    spark = top.sparkSession
    kept = top.join(features.select("latent"), "latent", "left_semi")
    per_class = kept.groupBy("latent", "token_class").agg(F.array_sort(F.collect_list(F.struct(
        "ctx_rank", "context", F.col("value").alias("activation")))).alias("items"))
    items = F.transform("items", lambda x: F.struct(x["context"].alias("context"), x["activation"].alias("activation")))
    per_feature = per_class.groupBy("latent").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token_class", items)))).alias("classes"))
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    (per_feature.orderBy("latent").select(F.col("latent").cast("string").alias("latent"), "classes")
     .mapInArrow(_context_fragments, "value string").write.option("lineSep", ",\n").text(parts))
    system, at = open_path(parts)
    files = sorted((i.path, i.size) for i in system.get_file_info(pafs.FileSelector(at)) if i.base_name.startswith("part-") and i.size)
    head = json.dumps(dict({"total_latents": features.count()}, **meta), ensure_ascii=False, indent=4)
    target, name = open_path(path)
    with target.open_output_stream(f"{name}.new") as out:
        out.write((head.removesuffix("\n}") + ',\n    "latent_context_map": {').encode())
        for k, (part, size) in enumerate(files):
            out.write(b"" if k else b"\n")
            left = size - (2 if k == len(files) - 1 else 0)  # nothing follows the last feature
            with system.open_input_stream(part) as f:
                while left:
                    piece = f.read(min(left, 4 << 20))
                    out.write(piece)
                    left -= len(piece)
        out.write(b"\n    }\n}" if files else b"}\n}")
    target.move(f"{name}.new", name)
    system.delete_dir(at)


def write_interpretation(results: DataFrame, summary: DataFrame, path: str) -> None:
    """K4: results (one JSON object per feature) and the summary row."""
    (results.select(F.col("latent_key").alias("latent"), "score", "explanation")
     .write.mode("overwrite").json(os.path.join(path, "results")))
    summary.write.mode("overwrite").json(os.path.join(path, "summary"))


def write_pair_scores(scores: DataFrame, path: str, placeholder: bool = True) -> None:
    """K5: ``pair_id score`` lines, with the pair-0 placeholder line of the original format."""
    rows = scores.select("pair_id", "saescore")
    if placeholder:
        rows = rows.unionByName(scores.sparkSession.createDataFrame([(0, 0.0)], "pair_id BIGINT, saescore DOUBLE"))
    rows.write.mode("overwrite").option("sep", " ").csv(path)


def write_variants(tagged: DataFrame, path: str, names: list[str] = ()) -> None:
    """K6: one Arrow dataset per variant under ``path``, each in a folder of the variant's name
    (``flip_5.00%``, ``remove_2.0%``), all in one pass. The folders of ``names`` are made even
    if no row has that variant. Rows that name their variants in a list, ``variants``, are stored
    once for all of them where files can have several names."""
    arrow_dataset.write(tagged, path, folder_column="variants" if "variants" in tagged.columns else "variant", folders=names, compression="zstd")


def write_dictionary(d: FeatureDictionary, path: str) -> None:
    d.latents.write.mode("overwrite").parquet(os.path.join(path, "latents"))
    d.pre_bias.write.mode("overwrite").parquet(os.path.join(path, "pre_bias"))
