"""Activation contexts (T14, T15), strongest contexts per feature.

A context is the window of chunk tokens around an activated position,
bounded by end tokens, with the activated token replaced by a mark. It depends
on the position only, so the activations of a chunk are gathered (at most k per
segment) and meet the chunk's tokens in one row: each token array is joined once, each
window is cut once, whatever the number of features that fire there, in an Arrow batch
(``operators.text.batch_windows``; ``context_of`` is the same for one row), and only
the window texts go on. The per-feature top-10 is a ranked window whose row limit Spark
applies map-side (WindowGroupLimit) before the shuffle, so a feature that
fires on a third of all rows still ships at most 10 rows per task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.arrays import let
from pairlens.config import ACTIVATED, CONTEXT_TRIM, MARKER, SENTENCE_ENDERS
from pairlens.operators.text import batch_windows
from pairlens.sources.paths import open_path

#: A chunk's place in its stored table: the task that wrote it, and its number there (monotonically_increasing_id).
PLACE_BITS = 33


def _member(t: Column, values) -> Column:
    return t.isin(*values)


def _leading(arr: Column, values) -> Column:
    """Number of leading elements of ``arr`` that are in ``values``."""
    init = F.struct(F.lit(True).alias("go"), F.lit(0).alias("n"))
    return F.aggregate(
        arr, init,
        lambda s, t: F.when(s["go"] & _member(t, values), F.struct(F.lit(True).alias("go"), (s["n"] + 1).alias("n")))
        .otherwise(F.struct(F.lit(False).alias("go"), s["n"].alias("n"))),
        lambda s: s["n"])


def _nearest(arr: Column, values) -> Column:
    """1-based position of the first element of ``arr`` in ``values``; null if none.
    The array is built once and searched once per value."""
    return let(arr, lambda a: F.least(*[F.nullif(F.array_position(a, v), F.lit(0)) for v in values]))


def _trim_ends(arr: Column, values) -> Column:
    """Drop leading and trailing elements in ``values`` (only scanned when one occurs)."""
    lead = _leading(arr, values)
    trail = _leading(F.reverse(arr), values)
    trimmed = F.slice(arr, lead + 1, F.greatest(F.size(arr) - lead - trail, F.lit(0)))
    return F.when(F.arrays_overlap(arr, F.array(*[F.lit(v) for v in values])), trimmed).otherwise(arr)


def context_of(t: Column, p: Column, window: int) -> Column:
    """The context of position ``p`` in the tokens ``t`` (null when there is no valid one).

    Bounds: scan left at most window//2 + 1 tokens and right at most
    window//2 + 1 (end exclusive), stopping at end tokens; if the span is longer
    than ``window``, re-clip to half + 1 + half around the position. The
    activated token becomes the mark; blank and end tokens are trimmed at both
    ends; markers render as nothing; the text is stripped of blanks, then of
    double quotes. Each stage is bound once (``let``) so the optimizer cannot
    multiply the expression when it pushes the validity filter down.
    """
    half = window // 2

    def bounds(b):
        lo, hi = b["lo"], b["hi"]
        back = _nearest(F.reverse(F.slice(t, lo + 1, p - lo)), SENTENCE_ENDERS)
        ahead = _nearest(F.slice(t, p + 1, F.greatest(hi - p, F.lit(0))), SENTENCE_ENDERS)
        start = F.when(back.isNull(), lo).otherwise(p - back + 1)
        end = F.when(ahead.isNull(), hi).otherwise(p + ahead - 1)
        return F.struct(start.alias("start"), (end - start).alias("length"))

    def window_of(b):
        start, length = b["start"], b["length"]
        a0 = p - start
        clip_l = F.when(length > window, F.greatest(F.lit(0), a0 - half)).otherwise(F.lit(0))
        clip_r = F.when(length > window, F.least(length, a0 + half + 1)).otherwise(length)
        ctx = F.slice(t, start + clip_l + 1, F.greatest(clip_r - clip_l, F.lit(0)))
        return F.struct(ctx.alias("ctx"), (a0 - clip_l).alias("a"))

    def render(w):
        ctx, a = w["ctx"], w["a"]
        valid = (a >= 0) & (a < F.size(ctx))
        marked = F.concat(F.slice(ctx, 1, a), F.array(F.lit(ACTIVATED + " ")),
                          F.slice(ctx, a + 2, F.greatest(F.size(ctx) - a - 1, F.lit(0))))
        text = F.array_join(F.array_remove(let(marked, lambda m: _trim_ends(m, CONTEXT_TRIM)), MARKER), " ")
        # strip blanks, then double quotes (after normalisation the only blanks
        # left are ASCII ones, so a character-set trim is exact)
        text = F.btrim(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), F.lit('"'))
        return F.when(valid, let(text, lambda x: F.when(x != "", x)))

    lo_hi = F.struct(F.greatest(p - (half + 1), F.lit(0)).alias("lo"),
                     F.least(F.size(t) - 1, p + half + 1).alias("hi"))
    return let(let(let(lo_hi, bounds), window_of), render)


def with_context(df: DataFrame, tokens: str, pos: str, window: int, out: str = "context") -> DataFrame:
    """T14 for one position per row: adds ``out``."""
    return df.withColumn(out, context_of(F.col(tokens), F.col(pos), window))


def cut_contexts(acts: DataFrame, chunks: DataFrame, chunk_keys: list[str], window: int) -> DataFrame:
    """T14 for every activation row (``chunk_keys``, end_pos and any other columns): adds ``context`` and drops
    rows without one. ``chunks`` holds ``chunk_keys`` and ``tokens``; what follows the real tokens may be cut
    to one end token. One row per chunk takes part in the join; its number of activations is bounded by the
    segments of a chunk times k."""
    carried = [c for c in acts.columns if c not in chunk_keys]
    by_chunk = acts.groupBy(*chunk_keys).agg(F.collect_list(F.struct(*carried)).alias("_acts"))
    held = by_chunk.join(chunks.select(*chunk_keys, "tokens"), chunk_keys).select(*chunk_keys, "tokens", "_acts")
    return cut_in_rows(held, "_acts", chunk_keys, window)


def cut_in_rows(chunks: DataFrame, acts: str, chunk_keys: list[str], window: int) -> DataFrame:
    """``cut_contexts`` where a chunk's row holds its ``tokens`` and, in the list ``acts``, its activations: nothing is dealt out."""
    held = chunks.select(*chunk_keys, "tokens", F.col(acts).alias("_acts"))
    schema = T.StructType([*(held.schema[c] for c in chunk_keys), held.schema["_acts"], T.StructField("context", T.StringType())])
    return held.mapInArrow(_cut_acts(chunk_keys, window), schema).select(*chunk_keys, F.inline("_acts"), "context")


# Rows of an Arrow batch whose windows are cut at a time.
_CUT_ROWS = 1024


def _cut_acts(keys: list[str], window: int):
    """Arrow batches of rows with ``tokens`` and ``_acts``: a row for each position that has a ``context``, with its activations."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in (b.slice(s, _CUT_ROWS) for b in batches for s in range(0, b.num_rows, _CUT_ROWS)):
            acts = batch.column("_acts")
            first = acts.offsets.to_numpy()
            flat = acts.values.slice(first[0], first[-1] - first[0])
            pos = pc.fill_null(flat.field("end_pos"), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.lexsort((pos, row))
            row, pos = row[order], pos[order]
            starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(pos) != 0)][:len(row)])
            context = batch_windows(batch.column("tokens"), row[starts], pos[starts], window)
            own = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), flat.take(pa.array(order)))
            out = [*batch.select(keys).take(pa.array(row[starts])).columns, own, context]
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "_acts", "context"]).filter(context.is_valid())
    return run


def _cut_segments(keys: list[str], window: int):
    """Arrow batches of rows with ``tokens`` and ``segs``: the segments get their ``context``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            segs = batch.column("segs")
            first = segs.offsets.to_numpy()
            flat = segs.values.slice(first[0], first[-1] - first[0])
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            context = batch_windows(batch.column("tokens"), row, flat.field("end_pos").to_numpy().astype(np.int64), window)
            fields = {flat.type.field(i).name: flat.field(i) for i in range(flat.type.num_fields)} | {"context": context}
            out = pa.ListArray.from_arrays(pa.array(first - first[0], pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, out], names=[*keys, "segs"])
    return run


def ranked_places(acts: DataFrame, per_class: int) -> DataFrame:
    """The rank of ``top_contexts`` without contexts, for the activations that can be among the strongest of their (feature,
    class): ``rank``, and ``tied`` where others have the same value and another context, so that ``rank`` is that of the first
    of them. ``same`` is equal where contexts are."""
    w = Window.partitionBy("latent", "token_class").orderBy(F.round("value", 9).desc())
    equal = Window.partitionBy("latent", "token_class", "rank")
    place = F.col("rank") + F.col("_n") - 1
    return (acts.withColumn("rank", F.rank().over(w)).filter(F.col("rank") <= per_class)
            .withColumn("tied", F.min("same").over(equal) != F.max("same").over(equal))
            .withColumn("_n", F.row_number().over(equal.orderBy("same")))
            .filter(F.col("tied") | (place <= per_class))
            .withColumn("rank", F.when(F.col("tied"), F.col("rank")).otherwise(place)).drop("_n", "same"))


def rank_tied(tied: DataFrame, per_class: int) -> DataFrame:
    """``ranked_places`` for the tied ones, by their context (descending): adds ``ctx_rank``."""
    w = Window.partitionBy("latent", "token_class", "rank").orderBy(F.col("context").desc())
    few = tied.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_class)
    return few.withColumn("ctx_rank", F.col("rank") + F.col("_n") - 1).filter(F.col("ctx_rank") <= per_class).drop("_n")


def cut_placed(chunks: DataFrame, folder: str, tied: bool, window: int, length: int) -> DataFrame:
    """T14 where the activations (``place, end_pos, latent, value, rank, tied``) are stored under ``folder`` by the part of their
    chunk's ``place``: a task reads those of the parts that it meets, so that no text is dealt out. ``chunks`` holds ``place``
    and ``words`` (real tokens of at most ``length``). Rows: ``latent, value, rank, end_token, context``."""
    return chunks.select("place", "words").mapInArrow(
        _cut_placed(folder, tied, window, length), "latent int, value double, rank int, end_token string, context string")


def _placed(system, folder: str, tied: bool):
    """The stored activations of a part, in order of their places."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs
    held = []
    for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if i.base_name.startswith("part-"):
            with system.open_input_file(i.path) as f:
                own = pq.ParquetFile(f).read(["place", "end_pos", "latent", "value", "rank", "tied"])
            held.append(own.filter(pc.equal(own.column("tied"), tied)).drop_columns("tied"))
    if not held:
        return None
    return pa.concat_tables(held).sort_by([("place", "ascending"), ("end_pos", "ascending")]).combine_chunks()


def _cut_placed(folder: str, tied: bool, window: int, length: int):
    import pyarrow as pa

    def run(batches):
        system, at = open_path(folder)
        part, held = None, None
        for batch in (b.slice(s, _CUT_ROWS) for b in batches for s in range(0, b.num_rows, _CUT_ROWS)):
            places, words = batch.column("place").to_numpy(), batch.column("words")
            for own in np.unique(places >> PLACE_BITS).tolist():
                if own != part:
                    part, held = own, _placed(system, f"{at}/part={own}", tied)
                    known = held.column("place").to_numpy() if held else None
                if not held:
                    continue
                first = np.searchsorted(known, places)
                n = np.searchsorted(known, places, "right") - first
                row = np.repeat(np.arange(len(places)), n)
                if not len(row):
                    continue
                acts = held.take(pa.array(np.arange(len(row)) + np.repeat(first - np.cumsum(n) + n, n)))
                pos = acts.column("end_pos").to_numpy().astype(np.int64)
                new = np.r_[True, (np.diff(row) != 0) | (np.diff(pos) != 0)]
                starts, which = np.flatnonzero(new), pa.array(np.cumsum(new) - 1)
                context = batch_windows(words, row[starts], pos[starts], window, length)
                token = words.values.take(pa.array(words.offsets.to_numpy()[row[starts]] + pos[starts]))
                yield pa.RecordBatch.from_arrays([*(acts.column(c).combine_chunks() for c in ("latent", "value", "rank")), token.take(which),
                                                  context.take(which)], names=["latent", "value", "rank", "end_token", "context"])
    return run


def token_class(token: Column) -> Column:
    """The class of an activated token."""
    return F.lower(F.trim(token))


def with_token_class(acts: DataFrame, chunks: DataFrame, chunk_keys: list[str]) -> DataFrame:
    """T15 for activations that don't carry the class of their token: it is looked up once per position."""
    at = acts.select(*chunk_keys, "end_pos").distinct().join(chunks.select(*chunk_keys, "tokens"), chunk_keys)
    classes = at.select(*chunk_keys, "end_pos", token_class(F.element_at("tokens", F.col("end_pos") + 1)).alias("token_class"))
    return acts.join(classes, [*chunk_keys, "end_pos"])


def _classed(acts: DataFrame, chunks: DataFrame, chunk_keys: list[str], class_from_token: bool) -> DataFrame:
    """The mark replaces the activated token before its class is read, so the original's class is always empty."""
    if not class_from_token:
        return acts.withColumn("token_class", F.lit(""))
    return acts if "token_class" in acts.columns else with_token_class(acts, chunks, chunk_keys)


def activation_contexts(acts: DataFrame, chunks: DataFrame, chunk_keys: list[str], window: int,
                        class_from_token: bool = False) -> DataFrame:
    """T14 + T15 for every activation row (``chunk_keys``, end_pos, latent, value).

    Output adds ``context`` and ``token_class``; activations without a valid
    context are dropped.
    """
    return cut_contexts(_classed(acts, chunks, chunk_keys, class_from_token), chunks, chunk_keys, window)


def chunk_contexts(chunks: DataFrame, chunk_keys: list[str], window: int) -> DataFrame:
    """T14 + T15 where a chunk's row holds its ``tokens`` and its ``segs`` (see operators.vectors.encode_chunks): each
    window is cut once, in that row, and nothing is dealt out. Rows as ``activation_contexts`` gives them."""
    held = chunks.select(*chunk_keys, "tokens", "segs")
    entry = T.StructType([*held.schema["segs"].dataType.elementType.fields, T.StructField("context", T.StringType())])
    schema = T.StructType([*(held.schema[c] for c in chunk_keys), T.StructField("segs", T.ArrayType(entry))])
    cut = held.mapInArrow(_cut_segments(chunk_keys, window), schema)
    rows = cut.select(*chunk_keys, F.inline("segs")).filter(F.col("context").isNotNull())
    return (rows.select(*chunk_keys, "seg_no", "end_pos", "end_ok", F.explode("feats").alias("f"), "context")
            .select(*chunk_keys, "seg_no", "end_pos", "end_ok", "f.latent", "f.value", "context", F.lit("").alias("token_class")))


def top_contexts(contexts: DataFrame, per_class: int) -> DataFrame:
    """The ``per_class`` strongest contexts per (feature, token class),
    by (activation, context) descending.

    Activations are compared at 1e-9: copies of a text give the same value up
    to the summation order of the encode, and must then rank by their context
    rather than by rounding noise.
    """
    w = Window.partitionBy("latent", "token_class").orderBy(
        F.round("value", 9).desc(), F.col("context").desc())
    return contexts.withColumn("ctx_rank", F.row_number().over(w)).filter(F.col("ctx_rank") <= per_class)


def strongest_contexts(acts: DataFrame, chunks: DataFrame, chunk_keys: list[str], window: int,
                       per_class: int, class_from_token: bool = False) -> DataFrame:
    """T14 + T15 + W4 with windows cut only for candidates (class '' as in the original, or with
    ``class_from_token`` that of the activated token: any number of classes).

    ``acts`` carries ``end_ok`` (the segment end has a window: see
    operators.text.segments). Among valid activations, the top ``per_class``
    by (activation, context) of a feature and class are at least as large as its
    ``per_class``-th largest activation. That bound comes from a window that each
    task limits to ``per_class`` rows per group, so ties are never gathered;
    then only activations that reach it (ties included, spread over all tasks)
    are joined to their chunk and cut, and W4 limits those per task again. Activations that
    hold their ``context`` already are not joined.
    """
    group = ["latent", "token_class"] if class_from_token else ["latent"]
    ok = _classed(acts, chunks, chunk_keys, class_from_token).filter(F.col("end_ok"))
    w_val = Window.partitionBy(*group).orderBy(F.col("_v").desc())
    least = (ok.select(*group, F.round("value", 9).alias("_v"))
             .withColumn("_n", F.row_number().over(w_val)).filter(F.col("_n") <= per_class)
             .groupBy(*group).agg(F.min("_v").alias("_least")))
    # one row per feature (at most L); features and classes have no such bound
    least = least if class_from_token else F.broadcast(least)
    cand = ok.join(least, group).filter(F.round("value", 9) >= F.col("_least")).drop("_least")
    if "context" not in acts.columns:
        return top_contexts(cut_contexts(cand, chunks, chunk_keys, window), per_class)
    cut = cut_contexts(cand.filter(F.col("context").isNull()).drop("context"), chunks, chunk_keys, window)
    return top_contexts(cand.filter(F.col("context").isNotNull()).unionByName(cut), per_class)


def context_features(top: DataFrame, max_classes: int, min_lines: int) -> DataFrame:
    """Features with at most ``max_classes`` classes and more than
    ``min_lines`` kept contexts."""
    return (top.groupBy("latent")
            .agg(F.countDistinct("token_class").alias("n_classes"), F.count("*").alias("n_contexts"))
            .filter((F.col("n_classes") <= max_classes) & (F.col("n_contexts") > min_lines)))


def contexts_by_feature(top: DataFrame, features: DataFrame) -> DataFrame:
    """J8 + W9: per kept feature, its contexts ordered by class, then activation
    desc (at most max_classes x per_class entries, bounded)."""
    kept = top.join(F.broadcast(features.select("latent")), "latent", "left_semi")
    item = F.struct(F.col("token_class"), F.col("ctx_rank"), F.col("context"), F.col("value"))
    return (kept.groupBy("latent")
            .agg(F.array_sort(F.collect_list(item)).alias("_items"))
            .select("latent", F.transform("_items", lambda s: F.struct(
                s["token_class"].alias("token_class"), s["context"].alias("context"),
                s["value"].alias("activation"))).alias("contexts")))
