"""Text and sequence operators.

Every operator is a row-local projection or an explode of one text row: a
text and everything cut from it stay in the task that read it, so the whole
chain up to the segment vectors runs without a shuffle. Texts are processed
whole (no prefixes); a long text simply yields more chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.config import ACTIVATED, CONTEXT_TRIM, EOS, MARKER, SENTENCE_ENDERS
from pairlens.functions import text as tx
from pairlens.functions.arrays import explode_indexed, let

try:  # the plain one takes a third of the time of OpenSSL's on single words
    from _md5 import md5
except ImportError:
    from hashlib import md5


def normalize_text(df: DataFrame, text_col: str = "text", out: str = "norm") -> DataFrame:
    """T1."""
    return df.withColumn(out, tx.normalize(text_col))


def mark_boundaries(df: DataFrame, col: str = "norm", out: str = "marked") -> DataFrame:
    """T2."""
    return df.withColumn(out, tx.mark_boundaries(col))


def _chunks(df: DataFrame, keys: list[str], words: F.Column, width: int, min_tail: int) -> DataFrame:
    """Chunks start at 0, width, 2*width, ... while start < n_words - min_tail."""
    def cut(w):
        n = F.size(w)
        starts = F.when(n > min_tail, F.sequence(F.lit(0), n - min_tail - 1, F.lit(width))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, width), " "))
    return (df.select(*keys, explode_indexed(let(words, cut)).alias("chunk_id", "chunk"))
            .filter(F.col("chunk_id").isNotNull())
            .select(*keys, "chunk_id", (F.col("chunk_id") * width).alias("start"), "chunk"))


def chunk_words(df: DataFrame, keys: list[str], width: int, min_tail: int,
                text_col: str = "text") -> DataFrame:
    """T1 + T2 + T3: strided chunks of ``width`` marked words; a chunk starts
    only where start < n_words - min_tail (short tails and texts vanish)."""
    marked = tx.mark_boundaries(tx.normalize(text_col))
    return _chunks(df, keys, tx.split_words(marked), width, min_tail)


def chunk_plain(df: DataFrame, keys: list[str], width: int, min_tail: int = 1,
                text_col: str = "text") -> DataFrame:
    """T4: plain chunks of ``width`` blank-separated words, no markers."""
    return _chunks(df, keys, tx.blank_words(text_col), width, min_tail)


def to_sequences(chunks: DataFrame, max_length: int, pad: str = EOS, pads: bool = True) -> DataFrame:
    """T5 + T6: word tokens, right-truncated and padded to ``max_length``;
    ``mask`` is 1 on real tokens, 0 on pads and markers. Without ``pads`` the tokens are
    the real ones only, and there is no mask: both follow from them and ``max_length``."""
    if not pads:
        return chunks.withColumn("tokens", F.slice(tx.word_tokens("chunk"), 1, max_length))
    def build(toks):
        n = F.size(toks)
        padded = F.concat(toks, F.array_repeat(F.lit(pad), F.lit(max_length) - n))
        mask = F.transform(padded, lambda t, i: F.when((i < n) & (t != MARKER), 1).otherwise(0))
        return F.struct(n.alias("n_tokens"), padded.alias("tokens"), mask.alias("mask"))
    seq = let(F.slice(tx.word_tokens("chunk"), 1, max_length), build)
    return chunks.withColumn("_s", seq).select("*", "_s.n_tokens", "_s.tokens", "_s.mask").drop("_s")


def used_tokens(seqs: DataFrame, include_pad: bool = False) -> DataFrame:
    """Token-grain sequences: the positions that take part. By default only real
    tokens (mask 1); ``include_pad`` keeps every position, as the original does."""
    if include_pad:
        return seqs
    real = F.filter(F.arrays_zip("tokens", "mask"), lambda x: x["mask"] == 1)
    return seqs.withColumn("tokens", F.transform(real, lambda x: x["tokens"]))


def segment_ends(seqs: DataFrame, gap: int) -> DataFrame:
    """T7 + T8: candidates = marker position - 1 (>= 0); keep a candidate when
    it is at least ``gap`` after the last kept one (the first must be >= gap)."""
    cands = F.filter(
        F.transform("tokens", lambda t, i: F.when(t == MARKER, i - 1).otherwise(F.lit(-1))),
        lambda p: p >= 0)
    init = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("acc"))
    ends = F.aggregate(
        F.col("cands"), init,
        lambda s, p: F.when(p >= s["last"] + gap,
                            F.struct(p.alias("last"), F.concat(s["acc"], F.array(p)).alias("acc")))
        .otherwise(s),
        lambda s: s["acc"])
    return seqs.withColumn("cands", cands).withColumn("ends", ends)


def segments(seqs: DataFrame, keys: list[str], width: int | None = None, end_token: bool = False) -> DataFrame:
    """T9 + T10: one row per selected segment end, keyed by keys + chunk_id +
    seg_no. A segment spans the tokens after the previous end up to this end.

    With ``width``, the real words of the segment (mask 1) are hashed into
    ``buckets`` (their bucket ids, 0..width-1). ``bucket_counts`` turns those
    into the sparse count vector. ``end_token`` adds the token at the segment's end.
    Each chunk hashes its tokens once and builds all its segments in one
    expression, so nothing is recomputed per segment.
    """
    def build(c):
        ends, bk, toks = c["ends"], c["buckets"], c["tokens"]

        def seg(e, j):
            begin = F.when(j == 0, F.lit(0)).otherwise(F.element_at(ends, j) + 1)
            # a context window around this end exists: the end is not the last
            # token and not an end token itself (see operators.contexts)
            end_ok = (e < F.size(toks) - 1) & ~F.element_at(toks, e + 1).isin(*SENTENCE_ENDERS)
            fields = [j.alias("seg_no"), begin.alias("begin_pos"), e.alias("end_pos"), end_ok.alias("end_ok")]
            if end_token:
                fields.append(F.element_at(toks, e + 1).alias("end_token"))
            if width is not None:
                part = F.filter(F.slice(bk, begin + 1, e - begin + 1), lambda b: b >= 0)
                fields.append(part.alias("buckets"))
            return F.struct(*fields)
        return F.transform(ends, seg)

    if width is not None:
        buckets = F.transform("tokens", lambda t, i: F.when(
            F.element_at("mask", i + 1) == 1, tx.hash_bucket(t, width)).otherwise(F.lit(-1)))
    else:
        buckets = F.array().cast("array<long>")
    segs = let(F.struct(F.col("ends").alias("ends"), buckets.alias("buckets"), F.col("tokens").alias("tokens")), build)
    return (seqs.select(*keys, "chunk_id", F.inline_outer(segs))
            .filter(F.col("seg_no").isNotNull()))


@dataclass
class BatchSegments:
    """T9 + T10 of a batch of chunks: a row per segment, chunk by chunk."""
    chunk: np.ndarray     # the chunk's row in the batch
    seg_no: np.ndarray
    end_pos: np.ndarray
    end_ok: np.ndarray
    end_code: np.ndarray  # number of the segment's last token among the batch's distinct ones
    tokens: object        # those distinct tokens (Arrow, binary)
    _owner: np.ndarray    # segment and bucket of each word that counts, in order of segments
    _bucket: np.ndarray

    def __len__(self) -> int:
        return len(self.chunk)

    def counts(self, start: int, stop: int, width: int) -> np.ndarray:
        """Dense word counts of some of the segments."""
        a, b = np.searchsorted(self._owner, [start, stop])
        flat = (self._owner[a:b] - start) * width + self._bucket[a:b]
        return np.bincount(flat, minlength=(stop - start) * width).reshape(stop - start, width).astype(np.float64)


def _hashes(raw: list[bytes]) -> np.ndarray:
    """First 32 bits of each token's md5."""
    digests = b"".join([md5(t, usedforsecurity=False).digest() for t in raw])
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64)


def batch_segments(words, ends, width: int, length: int) -> BatchSegments:
    """The segments of a batch from Arrow lists: each chunk's real tokens and its segment ends (see ``segments``,
    whose rows these are). Distinct tokens are hashed once. ``length`` is that of a padded sequence."""
    import pyarrow as pa
    import pyarrow.compute as pc
    first, at = words.offsets.to_numpy(), ends.offsets.to_numpy()
    coded = words.values.slice(first[0], first[-1] - first[0]).cast(pa.binary()).dictionary_encode()
    tokens, codes = coded.dictionary, coded.indices.to_numpy()
    end_pos = ends.values.to_numpy()[at[0]:at[-1]]
    first, at = first - first[0], at - at[0]
    chunk = np.repeat(np.arange(len(words)), np.diff(at))
    seg_no = np.arange(len(chunk)) - at[chunk]
    last = first[chunk] + end_pos

    bucket = _hashes(tokens.to_pylist()) % width
    bucket[pc.equal(tokens, MARKER.encode()).to_numpy(zero_copy_only=False)] = -1
    bounding = pc.is_in(tokens, pa.array([t.encode() for t in SENTENCE_ENDERS])).to_numpy(zero_copy_only=False)

    # a token's segment is the first that ends at or after it, if that one is of its chunk
    owner = np.repeat(np.arange(len(last) + 1), np.diff(np.r_[0, last + 1, len(codes)]))
    own = np.repeat(np.arange(len(words)), np.diff(first))
    counted = (owner < len(last)) & (bucket[codes] >= 0 if len(tokens) else False)
    counted[counted] = chunk[owner[counted]] == own[counted]
    end_code = codes[last]
    return BatchSegments(chunk, seg_no, end_pos, (end_pos < length - 1) & ~bounding[end_code], end_code, tokens,
                         owner[counted], bucket[codes[counted]])


def batch_windows(words, row: np.ndarray, pos: np.ndarray, window: int, length: int | None = None):
    """T14 in a batch: the context of each position ``pos`` in row ``row`` of an Arrow list column of tokens, as
    ``operators.contexts.context_of`` cuts it (null when there is no valid one). With ``length`` an end token
    follows the tokens of a row that has fewer."""
    import pyarrow as pa
    used, row = np.unique(row, return_inverse=True)
    if len(used) < len(words):  # few rows hold all that is asked for, or none
        words = words.take(pa.array(used))
    first = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.slice(first[0], first[-1] - first[0]).cast(pa.binary()).dictionary_encode()
    raw = [*coded.dictionary.to_pylist(), None]
    codes = coded.indices.fill_null(len(raw) - 1).to_numpy()
    first = first - first[0]
    base, size = first[row], np.diff(first)[row]
    if length is not None:
        size = size + (size < length)
    half = window // 2
    lo, hi = np.maximum(pos - (half + 1), 0), np.minimum(size - 1, pos + half + 1)
    enders, marker = {x.encode() for x in SENTENCE_ENDERS}, MARKER.encode()
    bounding = np.array([t in enders for t in raw], bool)
    at = np.r_[-1, np.flatnonzero(bounding[codes]), len(codes) + window]
    following = np.searchsorted(at, base + pos)
    before, ahead = at[np.maximum(following, 1) - 1] - base, at[np.minimum(following, len(at) - 1)] - base
    start = np.where(before >= lo, before + 1, lo)
    span = np.where(ahead < hi, ahead, hi) - start
    a = pos - start
    left = np.where(span > window, np.maximum(a - half, 0), 0)
    right = np.where(span > window, np.minimum(span, a + half + 1), span)
    valid = (a >= left) & (a < right)
    start, end = (start + left)[valid], (start + right)[valid]
    base, own = base[valid], pos[valid]

    trim = {x.encode() for x in CONTEXT_TRIM}
    if not trim.isdisjoint(raw):  # end tokens bound the window already
        trimmed = np.array([t in trim for t in raw], bool)[codes]
        for i, (b, p) in enumerate(zip(base.tolist(), own.tolist())):
            while start[i] < p and trimmed[b + start[i]]:
                start[i] += 1
            while end[i] > p + 1 and trimmed[b + end[i] - 1]:
                end[i] -= 1
    shown = np.array([t is not None and t != marker for t in raw], bool)[codes]
    place = np.r_[0, np.cumsum(shown)]
    tokens = np.empty(len(raw), object)
    tokens[:] = raw
    plain = tokens[codes[shown]].tolist()
    mark = [(ACTIVATED + " ").encode()]
    texts = [b" ".join(plain[s:m] + mark + plain[n:e]).strip(b" \t\n\r\x0b\x0c").strip(b'"') or None for s, m, n, e in zip(
        place[base + start].tolist(), place[base + own].tolist(), place[base + own + 1].tolist(), place[base + end].tolist())]
    where = np.cumsum(valid) - 1
    return pa.array(texts, pa.binary()).cast(pa.string(), safe=False).take(pa.array(where, mask=~valid))


def bucket_counts(buckets: str = "buckets") -> F.Column:
    """Sparse count vector: array<struct<bucket, n>> over the distinct buckets, from the ends of the runs of the
    sorted ids."""
    def runs(ids):
        last = F.size(ids) - 1
        ends = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i == last) | (F.get(ids, i + 1) != F.get(ids, i))))
        return let(F.coalesce(ends, F.array().cast("array<int>")), lambda own: F.transform(own, lambda e, j: F.struct(
            F.get(ids, e).alias("bucket"), (e - F.when(j == 0, F.lit(-1)).otherwise(F.get(own, j - 1))).alias("n"))))
    return let(F.sort_array(buckets), runs)


def store_vectors(vectors: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """Given vectors (any columns beside ``keys`` and ``pos``) as a table with buckets by chunk and position,
    dealt and sorted once. Returns the table."""
    at = [*keys, "pos"]
    writer = vectors.repartition(buckets, *at).write.bucketBy(buckets, at[0], *at[1:]).sortBy(*at).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return vectors.sparkSession.table(name)


def gather_vectors(segs: DataFrame, vectors: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """T9 on given vectors: each segment with the vector at its end. ``vectors`` is a table of ``store_vectors`` with
    the same keys and number of buckets: its files are read bucket by bucket and never shuffled; only the
    segments' small keys are dealt to the buckets."""
    ends = segs.repartition(buckets, *keys, "end_pos")
    return ends.join(vectors.withColumnRenamed("pos", "end_pos").hint("merge"), [*keys, "end_pos"])
