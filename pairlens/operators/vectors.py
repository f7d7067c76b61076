"""Vector operators: feature dictionary, row z-score, sparse encode, decode.

A feature dictionary is a table with one row per feature
``(latent int, enc array<double>, dec array<double>, latent_bias double)``
plus a one-row table ``pre_bias array<double>``. Its size is L x d, a model
parameter that does not grow with the data.

Encoding multiplies every vector with the whole encoder (n x d x L
multiply-adds). That is dense linear algebra, so it runs as one Arrow-batched
NumPy step per partition (``mapInArrow``). Tasks write the weights once as tiles
of rows into the shared folder, Spark hands the tiles to every executor
(``addFile``) and its Python workers map them into memory, so a dictionary of any
size is held once per machine and never in the driver. Inside the step the latents are worked off in blocks with a running
top-k: one pass over the vectors, no shuffle, whatever the dictionary's size.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.text import batch_segments, batch_windows
from pairlens.functions.arrays import array_mean, array_norm, array_std, as_double_array, let
from pairlens.session import checkpoint_dir, stored
from pairlens.sources.paths import open_path

# Latents whose pre-activations are computed at a time; also the rows of a tile.
BLOCK_LATENTS = 8192
# Scratch bound for one rows x block matrix of pre-activations inside a task.
_SCRATCH_BYTES = 1 << 26


@dataclass
class FeatureDictionary:
    latents: DataFrame   # latent int, enc array<double>, dec array<double>, latent_bias double
    pre_bias: DataFrame  # one row: pre_bias array<double>


# --------------------------------------------------------------------------- V8, V7

def dictionary_from_vectors(vectors: DataFrame, id_col: str, vec_col: str,
                            condition: F.Column | None = None) -> FeatureDictionary:
    """V8: dictionary whose encoder rows are the chosen vectors, zero biases,
    decoder = encoder transposed, then V7 (unit-norm decoder columns)."""
    rows = vectors if condition is None else vectors.filter(condition)
    enc = as_double_array(vec_col)
    latents = rows.select(
        F.col(id_col).cast("int").alias("latent"),
        enc.alias("enc"),
        enc.alias("dec"),
        F.lit(0.0).alias("latent_bias"),
    )
    width = rows.select(F.size(vec_col).alias("d")).limit(1)
    pre_bias = width.select(F.array_repeat(F.lit(0.0), F.col("d")).alias("pre_bias"))
    return FeatureDictionary(unit_norm_decoder(latents), pre_bias)


def unit_norm_decoder(latents: DataFrame) -> DataFrame:
    """V7: every decoder column (one dictionary row here) divided by its norm."""
    norm = array_norm(F.col("dec"))
    return latents.withColumn("dec", F.transform("dec", lambda v: F.try_divide(v, norm)))


# --------------------------------------------------------------------------- V1, V6

def zscore(df: DataFrame, vec_col: str, out_col: str = "x", eps: float = 1e-6) -> DataFrame:
    """V1: row z-score with sample std and eps outside the root; keeps mean, std.

    Mean and std are bound once per row (``let``), so the per-element step is
    O(d), not O(d^2) as it would be with the statistics inlined in its lambda.
    """
    def stats(a):
        def with_mean(mean):
            return let(array_std(a, mean), lambda std: F.struct(
                mean.alias("mean"), std.alias("std"),
                F.transform(a, lambda x: (x - mean) / (std + F.lit(eps))).alias(out_col)))
        return let(array_mean(a), with_mean)
    z = let(as_double_array(vec_col), stats)
    return df.withColumn("_z", z).select("*", "_z.mean", "_z.std", f"_z.{out_col}").drop("_z")


def undo_zscore(df: DataFrame, col: str = "x_hat", out_col: str = "y_hat") -> DataFrame:
    """V6: x_hat * std + mean."""
    return df.withColumn(out_col, F.transform(col, lambda v: v * F.col("std") + F.col("mean")))


# --------------------------------------------------------------------------- weights

@dataclass
class WeightFiles:
    """Names of the tiles on each executor (rows in order of latent), and the small vectors beside them."""
    enc: list[str]
    dec: list[str]
    ids: np.ndarray
    bias: np.ndarray
    pre_bias: np.ndarray

    def tiles(self, names: list[str]) -> list[np.ndarray]:
        from pyspark import SparkFiles
        return [np.load(SparkFiles.get(n), mmap_mode="r") for n in names]


def _tile_writer(folder: str, sizes: list[int], width: int, columns: list[str]):
    """Rows come by tile and latent; each tile's matrices are written as they stream through.
    A file's name is its attempt's own, and only a finished task's names are used."""
    import pyarrow as pa
    schema = pa.schema([("tile", pa.int32()), ("column", pa.string()), ("name", pa.string()), ("n", pa.int64())])

    def run(batches):
        system, at = open_path(folder)
        system.create_dir(at)
        open_: dict = {}
        done: dict = {}
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            for tile in np.unique(tiles).tolist():
                rows = batch.slice(int(np.searchsorted(tiles, tile)), int((tiles == tile).sum()))
                if tile not in open_:
                    open_[tile] = {c: (f"{c}-{tile}-{uuid.uuid4().hex}.npy",) for c in columns}
                    for c in columns:
                        out = system.open_output_stream(f"{at}/{open_[tile][c][0]}")
                        np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": (sizes[tile], width)})
                        open_[tile][c] += (out,)
                    done[tile] = 0
                for c in columns:
                    open_[tile][c][1].write(_dense_rows(rows.column(c)).astype("<f8", copy=False).tobytes())
                done[tile] += rows.num_rows
        for tile, files in open_.items():
            for c, (name, out) in files.items():
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((tile, c, name, done[tile]), schema)], schema=schema)
    return run


def _weight_files(d: FeatureDictionary, with_dec: bool, block: int) -> WeightFiles:
    """Let tasks write the dictionary as tiles of ``block`` latents into the shared folder, and add them to the
    application. The driver sees ids, biases and the tiles' names."""
    spark = d.latents.sparkSession
    pre_bias = np.asarray(d.pre_bias.first()["pre_bias"], dtype=np.float64)
    latents = stored(d.latents, "dictionary")
    small = latents.select("latent", "latent_bias").toArrow().sort_by("latent")
    ids = small.column("latent").to_numpy().astype(np.int32)
    bias = small.column("latent_bias").to_numpy().astype(np.float64)
    columns = ["enc", "dec"] if with_dec else ["enc"]
    firsts = ids[::block].tolist()
    sizes = [min(block, len(ids) - s) for s in range(0, len(ids), block)]
    folder = f"{checkpoint_dir(spark).rstrip('/')}/weights"
    # a handful of bounds: the number of the last tile that begins at or before the latent
    tile = sum([(F.col("latent") >= f).cast("int") for f in firsts[1:]], F.lit(0))
    rows = (latents.select(tile.alias("tile"), "latent", *columns).repartition(max(1, len(firsts)), "tile")
            .sortWithinPartitions("tile", "latent"))
    written = rows.mapInArrow(_tile_writer(folder, sizes, len(pre_bias), columns), "tile int, column string, name string, n bigint").collect()
    names = {(r.tile, r.column): r.name for r in written if r.n == sizes[r.tile]}
    out = {c: [names[k, c] for k in range(len(firsts))] for c in columns}
    for n in names.values():
        spark.sparkContext.addFile(f"{folder}/{n}")
    return WeightFiles(out["enc"], out.get("dec", []), ids, bias, pre_bias)


# --------------------------------------------------------------------------- V2, V3

def _topk_mask(pre: np.ndarray, k: int) -> np.ndarray:
    """Exact row top-k; among equal values the lower latent (column) wins."""
    n, L = pre.shape
    if k >= L:
        return np.ones_like(pre, dtype=bool)
    kth = np.partition(pre, L - k, axis=1)[:, L - k][:, None]
    gt = pre > kth
    eq = pre == kth
    need = k - gt.sum(axis=1, keepdims=True)
    return gt | (eq & (np.cumsum(eq, axis=1) <= need))


def _topk(pre: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row top-k as (column indices, values), k per row.

    ``argpartition`` finds a top-k set in O(L); it is the exact answer unless
    the k-th value is tied with values outside the set, which only the rows
    with such ties resolve through ``_topk_mask`` (lower latent wins).
    """
    n, L = pre.shape
    if k >= L:
        idx = np.tile(np.arange(L), (n, 1))
        return idx, pre.copy()
    idx = np.argpartition(pre, L - k, axis=1)[:, L - k:]
    vals = np.take_along_axis(pre, idx, axis=1)
    kth = vals.min(axis=1)
    tied = np.nonzero((pre >= kth[:, None]).sum(axis=1) > k)[0]
    if len(tied):
        exact = _topk_mask(pre[tied], k)
        for j, row in enumerate(tied):
            cols = np.nonzero(exact[j])[0]
            idx[row] = cols
            vals[row] = pre[row, cols]
    return idx, vals


def _list_parts(col) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rebased to 0) and flat values of an Arrow list column."""
    offsets = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], values


def _dense_rows(col) -> np.ndarray:
    """Arrow list column of equal-length vectors -> (n, d) float64 matrix, no per-row Python."""
    offsets, values = _list_parts(col)
    n = len(offsets) - 1
    width = int(offsets[1]) if n else 0
    if n and not (np.diff(offsets) == width).all():
        raise ValueError("vectors of different widths in one column")
    return values.astype(np.float64, copy=False).reshape(n, width)


def _zscored_counts(width: int, eps: float):
    """Arrow list column of bucket ids -> dense count vectors -> row z-score (V1)."""
    def to_matrix(col) -> np.ndarray:
        offsets, ids = _list_parts(col)
        n = len(offsets) - 1
        dense = np.zeros((n, width), dtype=np.float64)
        rows = np.repeat(np.arange(n), np.diff(offsets))
        np.add.at(dense, (rows, ids.astype(np.int64)), 1.0)
        return _zscored(dense, eps)
    return to_matrix


def _zscored(x: np.ndarray, eps: float) -> np.ndarray:
    """V1 on the rows of a matrix."""
    return (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, ddof=1, keepdims=True) + eps)


def _running_topk(xs: np.ndarray, tiles: list[np.ndarray], bias: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row top-k over all latents as (latent rows in ascending order, values); the
    candidates so far stand before each tile, so among equal values the lower latent wins."""
    idx = np.zeros((len(xs), 0), np.int64)
    vals = np.zeros((len(xs), 0))
    s = 0
    for enc in tiles:
        pre = xs @ enc.T + bias[s:s + len(enc)]
        vals = np.concatenate([vals, pre], axis=1)
        idx = np.concatenate([idx, np.broadcast_to(np.arange(s, s + pre.shape[1]), pre.shape)], axis=1)
        own, vals = _topk(vals, k)
        idx = np.take_along_axis(idx, own, axis=1)
        order = np.argsort(idx, axis=1)
        idx, vals = np.take_along_axis(idx, order, axis=1), np.take_along_axis(vals, order, axis=1)
        s += len(enc)
    return idx, vals


def _decoded(idx: np.ndarray, vals: np.ndarray, tiles: list[np.ndarray], pre_bias: np.ndarray) -> np.ndarray:
    """pre_bias plus each row's values times their decoder rows, in order of latent."""
    x_hat = np.tile(pre_bias, (len(idx), 1))
    starts = np.cumsum([0, *(len(t) for t in tiles)])
    for j in range(idx.shape[1]):
        where = np.searchsorted(starts, idx[:, j], "right") - 1
        for k in np.unique(where).tolist():
            own = np.flatnonzero(where == k)
            x_hat[own] += vals[own, j, None] * tiles[k][idx[own, j] - starts[k]]
    return x_hat


def _encode_fn(keys: list[str], vec_col: str, to_matrix, k: int, w: WeightFiles, emit_dense: bool, block: int):
    """Arrow batches in, Arrow batches out: keys are carried with ``take``."""
    import pyarrow as pa

    def run(batches):
        enc, dec = w.tiles(w.enc), w.tiles(w.dec)
        rows_per_step = max(1, _SCRATCH_BYTES // max(8 * min(block, len(w.ids)), 1))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = to_matrix(batch.column(vec_col))
            key_cols = batch.select(keys)
            for s in range(0, batch.num_rows, rows_per_step):
                xs = x[s:s + rows_per_step]
                idx, vals = _running_topk(xs - w.pre_bias, enc, w.bias, k)
                part = key_cols.slice(s, len(xs))
                if emit_dense:
                    x_hat = _decoded(idx, vals, dec, w.pre_bias)
                    offs = pa.array(np.arange(0, x_hat.size + 1, x_hat.shape[1], dtype=np.int32))
                    arr = pa.ListArray.from_arrays(offs, pa.array(x_hat.ravel()))
                    yield pa.RecordBatch.from_arrays(list(part.columns) + [arr], names=keys + ["x_hat"])
                else:
                    r = pa.array(np.repeat(np.arange(len(xs)), idx.shape[1]))
                    taken = part.take(r)
                    yield pa.RecordBatch.from_arrays(
                        list(taken.columns) + [pa.array(w.ids[idx.ravel()], pa.int32()), pa.array(vals.ravel())],
                        names=keys + ["latent", "value"])
    return run


def encode(df: DataFrame, dictionary: FeatureDictionary, k: int, keys: list[str],
           vec_col: str = "x", block_latents: int = BLOCK_LATENTS,
           counts_width: int | None = None, eps: float = 1e-6) -> DataFrame:
    """V2 + V3: pre-activations and row top-k, as a long sparse table
    ``keys..., latent int, value double`` (k rows per vector, values may be <= 0).

    ``vec_col`` holds the (already normalised) vectors. With ``counts_width``
    it instead holds bucket-id arrays (T10 output): the dense count vector and
    its row z-score (V1) are built inside the same Arrow batch as the matmul.
    """
    to_matrix = _zscored_counts(counts_width, eps) if counts_width else _dense_rows
    key_fields = [df.schema[c] for c in keys]
    schema = T.StructType(key_fields + [T.StructField("latent", T.IntegerType()),
                                        T.StructField("value", T.DoubleType())])
    src = df.select(*dict.fromkeys([*keys, vec_col]))
    weights = _weight_files(dictionary, False, block_latents)
    return src.mapInArrow(_encode_fn(keys, vec_col, to_matrix, k, weights, False, block_latents), schema)


def active(acts: DataFrame) -> DataFrame:
    """V4: keep activations with value > 0."""
    return acts.filter(F.col("value") > 0)


# --------------------------------------------------------------------------- T9 - V4 by chunk

# Values that are equal when compared at 1e-9 differ by less.
_TIE = 1e-8


def _strongest(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Which values are among the ``n`` largest of their group, ties included."""
    order = np.lexsort((-values, group))
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0][:len(order)])
    sizes = np.diff(np.r_[starts, len(order)])
    least = np.where(sizes >= n, values[order][np.minimum(starts + n - 1, len(order) - 1)], -np.inf)
    keep = np.zeros(len(values), bool)
    keep[order] = values[order] >= np.repeat(least, sizes) - _TIE
    return keep


def _largest(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest values of each group."""
    order = np.lexsort((-values, group))
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0][:len(order)])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < n]


def _offsets(counts: np.ndarray):
    import pyarrow as pa
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _lists(group: np.ndarray, n: int, fields: dict):
    """Arrow lists of structs: ``group`` is each entry's list (ascending), of ``n``."""
    import pyarrow as pa
    return pa.ListArray.from_arrays(_offsets(np.bincount(group, minlength=n)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _sums(group: np.ndarray, n: int, idx: np.ndarray, vals: np.ndarray, ids: np.ndarray):
    """A list per group: the sum of each latent's values."""
    import pyarrow as pa
    at, inverse = np.unique(group * len(ids) + idx, return_inverse=True)
    return _lists(at // max(len(ids), 1), n, {"latent": pa.array(ids[at % max(len(ids), 1)], pa.int32()),
                                              "value": pa.array(np.bincount(inverse, weights=vals, minlength=len(at)))})


def _active_batches(width: int, length: int, eps: float, k: int, w: WeightFiles, block: int):
    """T9 + T10 + V1 - V4 by Arrow batch of chunks: the batch, its segments, and of its active values latent (row of the
    weights), value and segment, by segment."""
    def run(batches):
        enc = w.tiles(w.enc)
        step = max(1, _SCRATCH_BYTES // max(8 * max(min(block, len(w.ids)), width), 1))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            segs = batch_segments(batch.column("words"), batch.column("ends"), width, length)
            parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
            for s in range(0, len(segs), step):
                e = min(s + step, len(segs))
                idx, vals = _running_topk(_zscored(segs.counts(s, e, width), eps) - w.pre_bias, enc, w.bias, k)
                own = vals > 0
                parts.append((idx[own], vals[own], s + np.nonzero(own)[0]))
            yield batch, segs, *(np.concatenate(x) for x in zip(*parts))
    return run


def _encode_chunks_fn(carried: list[str], width: int, length: int, eps: float, k: int, w: WeightFiles, block: int,
                      strongest: int, end_token: bool, emit: tuple[str, ...], copies: str | None, sums_by: str | None):
    import pyarrow as pa
    encoded = _active_batches(width, length, eps, k, w, block)

    def run(batches):
        for batch, segs, idx, vals, seg in encoded(batches):
            latents, n = pa.array(w.ids[idx], pa.int32()), batch.num_rows
            out = {}
            if "segs" in emit:
                feats = _lists(seg, len(segs), {"latent": latents, "value": pa.array(vals)})
                out["segs"] = _lists(segs.chunk, n, {"seg_no": pa.array(segs.seg_no, pa.int32()), "end_pos": pa.array(segs.end_pos, pa.int32()),
                                                     "end_ok": pa.array(segs.end_ok), "feats": feats})
            if "strong" in emit:
                group = idx * max(len(segs.tokens), 1) + segs.end_code[seg] if end_token else idx
                top = np.flatnonzero(segs.end_ok[seg])
                if copies:
                    top = top[_few_copies(batch, copies, strongest)[segs.chunk[seg[top]]]]
                top = top[_strongest(vals[top], group[top], strongest)]
                at = seg[top]
                fields = {"seg_no": pa.array(segs.seg_no[at], pa.int32()), "end_pos": pa.array(segs.end_pos[at], pa.int32()),
                          "latent": latents.take(pa.array(top)), "value": pa.array(vals[top])}
                if end_token:
                    fields["end_token"] = segs.tokens.take(pa.array(segs.end_code[at])).cast(pa.string(), safe=False)
                out["strong"] = _lists(segs.chunk[at], n, fields)
            if "sums" in emit:
                own = _first_of_its_kind(batch.column(sums_by)) if sums_by else np.arange(n)
                out["sums"] = _sums(own[segs.chunk[seg]], n, idx, vals, w.ids)
            yield pa.RecordBatch.from_arrays([*batch.select(carried).columns, *(out[c] for c in emit)], names=[*carried, *emit])
    return run


def _first_of_its_kind(col) -> np.ndarray:
    """For each row the first one with its value."""
    codes = col.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.unique(codes, return_index=True)[1][codes]


def _few_copies(batch, copies: str, n: int) -> np.ndarray:
    """Which rows are among the first ``n`` with their value of ``copies``; rows that are ``repeated`` all count."""
    values = batch.column(copies).to_numpy()
    order = np.argsort(values, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(values[order]) != 0][:len(order)])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return (rank < n) | np.asarray(batch.column("repeated").to_numpy(zero_copy_only=False), bool)


_SUMS = "array<struct<latent: int, value: double>>"


def encode_chunks(chunks: DataFrame, dictionary: FeatureDictionary, k: int, width: int, length: int, strongest: int,
                  eps: float = 1e-6, end_token: bool = False, block_latents: int = BLOCK_LATENTS,
                  emit: tuple[str, ...] = ("segs", "strong"), carried: list[str] | None = None, copies: str | None = None,
                  sums_by: str | None = None) -> DataFrame:
    """T9 + T10 + V1 - V4 with a chunk's activations in its own row: ``segments``, ``encode`` and ``active`` in one Arrow
    step, so that neither segments nor activations are rows that are dealt out again.

    ``chunks`` holds ``words`` (real tokens) and ``ends``; all its columns (or those of ``carried``) go along. Added are
    those of ``emit``: ``segs``, an entry for every segment with its active features; ``strong``: of the segments that have
    a window (``end_ok``) the activations among the ``strongest`` largest of their feature (with ``end_token``: of feature
    and last token, which is added) in their batch, ties included, as no other can be among the largest of all; ``sums``,
    the chunk's sum of each active feature.

    ``copies`` names a column that is equal where chunks are: of a batch's equal ones (but those ``repeated``) ``strongest``
    enter ``strong``, as no more can be among the largest. With ``sums_by``, a column, the sums of all a batch's chunks
    with the same value stand in the first of them."""
    carried = chunks.columns if carried is None else carried
    seg = "seg_no int, end_pos int"
    kinds = {"segs": f"array<struct<{seg}, end_ok boolean, feats {_SUMS}>>",
             "strong": f"array<struct<{seg}, latent int, value double{', end_token string' if end_token else ''}>>", "sums": _SUMS}
    schema = T.StructType([*(chunks.schema[c] for c in carried), *T._parse_datatype_string(", ".join(f"{c} {kinds[c]}" for c in emit)).fields])
    weights = _weight_files(dictionary, False, block_latents)
    return chunks.mapInArrow(_encode_chunks_fn(carried, width, length, eps, k, weights, block_latents, strongest, end_token, tuple(emit),
                                               copies, sums_by), schema)


def _encode_texts_fn(keys: list[str], width: int, length: int, eps: float, k: int, w: WeightFiles, block: int, strongest: int, window: int):
    import pyarrow as pa
    import pyarrow.compute as pc
    encoded = _active_batches(width, length, eps, k, w, block)

    def run(batches):
        best, best_of, least = np.zeros(0), np.zeros(0, np.int64), np.full(len(w.ids), -np.inf)
        for batch, segs, idx, vals, seg in encoded(batches):
            chunk_id, words = batch.column("chunk_id").to_numpy(), batch.column("words")
            first = np.flatnonzero(np.r_[True, chunk_id[1:] == 0])
            part = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(chunk_id)]))
            out = [*batch.select(keys).take(pa.array(first)).columns,
                   pa.array(np.bincount(part[segs.chunk], minlength=len(first)), pa.int64()),
                   _sums(part[segs.chunk[seg]], len(first), idx, vals, w.ids)]
            if window:
                # what is less than the largest of the task's batches so far is not among the largest of all either
                top = np.flatnonzero(segs.end_ok[seg])
                for part_of in np.split(top, [len(top) // 16]):  # the first few tell most of the others off unsorted
                    more = part_of[vals[part_of] >= least[idx[part_of]]]
                    values, group = np.r_[best, vals[more]], np.r_[best_of, idx[more]]
                    most = _largest(values, group, strongest)
                    best, best_of = values[most], group[most]
                    smallest = np.full(len(least), np.inf)
                    np.minimum.at(smallest, best_of, best)
                    least = np.where(np.bincount(best_of, minlength=len(least)) >= strongest, smallest, -np.inf)
                top = top[vals[top] >= least[idx[top]] - _TIE]
                repeated = np.asarray(batch.column("repeated").to_numpy(zero_copy_only=False), bool)
                places, at = np.unique(seg[top], return_inverse=True)
                cut = batch_windows(words, segs.chunk[places], segs.end_pos[places], window, length)
                cut = pc.if_else(pa.array(repeated[segs.chunk[places]]), pa.scalar(None, pa.string()), cut)
                s = seg[top]
                out.append(_lists(part[segs.chunk[s]], len(first), {
                    "chunk_id": pa.array(chunk_id[segs.chunk[s]], pa.int32()), "seg_no": pa.array(segs.seg_no[s], pa.int32()),
                    "end_pos": pa.array(segs.end_pos[s], pa.int32()), "latent": pa.array(w.ids[idx[top]], pa.int32()),
                    "value": pa.array(vals[top]), "context": cut.take(pa.array(at))}))
                kept = np.flatnonzero(repeated)
                own = words.take(pa.array(kept))
                out.append(_lists(part[kept], len(first), {"chunk_id": pa.array(chunk_id[kept], pa.int32()), "words": own}))
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "n_ends", "sums", *(["strong", "chunks"] if window else [])])
    return run


def encode_texts(chunks: DataFrame, keys: list[str], dictionary: FeatureDictionary, k: int, width: int, length: int,
                 strongest: int = 0, window: int = 0, eps: float = 1e-6, block_latents: int = BLOCK_LATENTS) -> DataFrame:
    """The activations of ``encode_chunks`` summed by text: a row per run of a text's chunks in an Arrow batch, with ``keys``,
    ``n_ends`` and ``sums`` (latent, value). ``chunks`` holds ``words``, ``ends`` and ``chunk_id``, which begins at 0 in each text.

    With ``window`` (T14) also ``strong``: the activations among the ``strongest`` largest of their feature in the task's batches
    so far, ties included, with their context. A text whose ``repeated`` is true shares its keys with others, whose tokens its
    activations meet too: they have no context yet, and ``chunks`` holds the words."""
    more = ", strong array<struct<chunk_id int, seg_no int, end_pos int, latent int, value double, context string>>, chunks array<struct<chunk_id int, words array<string>>>"
    schema = T.StructType([*(chunks.schema[c] for c in keys), *T._parse_datatype_string(f"n_ends bigint, sums {_SUMS}{more if window else ''}").fields])
    weights = _weight_files(dictionary, False, block_latents)
    return chunks.mapInArrow(_encode_texts_fn(keys, width, length, eps, k, weights, block_latents, strongest, window), schema)


# --------------------------------------------------------------------------- V5

def reconstruct(df: DataFrame, dictionary: FeatureDictionary, k: int, keys: list[str],
                vec_col: str = "x", block_latents: int = BLOCK_LATENTS) -> DataFrame:
    """V2 + V3 + V5: encode and decode in one pass; adds ``x_hat array<double>``.
    ``keys`` go along unchanged and may hold the vector itself and its statistics,
    so metrics on (x, x_hat) need no join."""
    key_fields = [df.schema[c] for c in keys]
    src = df.select(*dict.fromkeys([*keys, vec_col]))
    schema = T.StructType(key_fields + [T.StructField("x_hat", T.ArrayType(T.DoubleType()))])
    weights = _weight_files(dictionary, True, block_latents)
    return src.mapInArrow(_encode_fn(keys, vec_col, _dense_rows, k, weights, True, block_latents), schema)
