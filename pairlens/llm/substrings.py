"""Substring dedup with difference-cover anchors (operator 2).

A window of ``WINDOW`` = 50 consecutive words of a document is a repeat if the same
words also start in a document with a smaller doc_id; every word inside a repeat is
removed. Windows are judged on the input.

Difference cover: ``COVER`` is a set of residues modulo ``PERIOD`` = 31 whose
differences give every residue. So for any two positions there is a shift below 31
that brings both to cover positions, and any match of 50 words contains an anchor (20
words, 31 - 1 + 20 = 50) that starts at a cover position on both sides. Only those
6 of 31 positions are hashed:

1. Anchors of all documents, grouped by hash: those of two or more documents are shared.
2. Shared anchors go back to their documents (a join on the hash).
3. Extension: each window around a shared anchor is hashed as a whole (two
   independent 64-bit hashes of its words), grouped to its smallest doc_id, and
   joined back; windows of a larger doc_id are repeats. A word's own hash is a
   polynomial up to ``LONG_WORD`` bytes and XXH3 with a seed beyond: polynomials modulo
   2^64 have common collisions, but only between strings of hundreds of bytes.
   The hashes are worked off in ``PASSES`` rounds, so that only one round's shuffle
   is on disk at a time.
4. Repeats go back to their documents, whose words are then kept or removed.

Groups are only ever aggregated (minimum and maximum doc_id, first within each
Arrow batch, then per task), so a passage shared by any number of documents is a
few rows per task; the joins back are split by AQE where a hash is hot. No pairs of
documents are formed. Every step is written to the shared folder.

Defined cases: a null or empty text has no words; documents of fewer than 50 words
lose nothing; rows with one doc_id never remove from each other, and equal rows get
equal results; a null doc_id is neither smaller nor larger than another, so such a
row keeps all words; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import common as c

WINDOW = 50
PERIOD = 31
#: a perfect difference set modulo 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1

_U = np.uint64
#: odd multipliers: two for bytes in a word, two for words in a window
_BYTE_R = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_R = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@functools.lru_cache(maxsize=8)
def _powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _power_table(r: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of ``r`` modulo 2^64 (tables are kept by their size rounded up)."""
    return _powers(r, 1 << max(10, (n - 1).bit_length()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: bytes of a word that the polynomials hash
LONG_WORD = 32

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


#: texts are taken in slices of so many characters (one text at least), bytes in slices of so many
SLICE_CHARS, SLICE_BYTES = 1_000_000, 1 << 20
#: windows are judged in so many rounds by their hash; a round's shuffle is that part of all windows
PASSES = 4


class Words:
    """The words of several texts as one sequence: hashes, and each text's first word."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        blank = _BLANK[raw]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        self.raw, self.starts, self.ends = raw, edge[::2], edge[1::2]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.starts, text_ends)])
        self._hash: dict[int, np.ndarray] = {}

    def hashes(self, which: int) -> np.ndarray:
        """A 64-bit hash of every word; bytes are worked on in slices, whatever a text's length."""
        if which not in self._hash:
            parts = []
            cuts = np.searchsorted(self.starts, np.arange(0, len(self.raw), SLICE_BYTES)).tolist() + [len(self.starts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                lo, hi = int(self.starts[a]), int(self.ends[b - 1])
                raw, starts = self.raw[lo:hi], self.starts[a:b] - lo
                sizes = self.ends[a:b] - self.starts[a:b]
                inside = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
                table = _power_table(_BYTE_R[which], LONG_WORD)
                terms = (raw.astype(_U) + _U(1)) * table[np.minimum(inside, len(table) - 1)]
                terms[_BLANK[raw]] = 0
                own = _mixed(np.add.reduceat(terms, starts) + sizes.astype(_U) * _U(_BYTE_R[1 - which]))
                for i in np.flatnonzero(sizes > LONG_WORD).tolist():
                    own[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:starts[i] + sizes[i]], _BYTE_R[which])
                parts.append(own)
            self._hash[which] = np.concatenate(parts) if parts else np.zeros(0, _U)
        return self._hash[which]

    def window_hashes(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """A 64-bit hash of the ``n`` words from each of the positions ``at``."""
        own = self.hashes(which)
        r = _WORD_R[which]
        powers = _power_table(r, len(own) + 1)[:len(own)]
        back = _power_table(pow(r, -1, 1 << 64), len(own) + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(own * powers, dtype=_U)])
        return _mixed((sums[at + n] - sums[at]) * back[at])

    def cover_positions(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all anchors (in texts of a window or more) and their texts' numbers."""
        counts = np.diff(self.first)
        text = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(len(text)) - self.first[text]
        ok = np.isin(inside % PERIOD, COVER) & (inside + ANCHOR <= counts[text]) & (counts[text] >= WINDOW)
        at = np.flatnonzero(ok)
        return at, text[at]


def _utf8(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


# ------------------------------------------------------------------ steps inside tasks

def _anchor_groups(batches):
    """Per slice of documents: each anchor hash with its smallest and largest doc_id."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, texts in c.text_batches(batch.column(1), SLICE_CHARS):
            w = Words(_utf8(texts))
            at, text = w.cover_positions()
            if not len(at):
                continue
            h, doc = w.window_hashes(at, ANCHOR), ids[first + text]
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[new].view(np.int64)), pa.array(np.minimum.reduceat(doc, new)), pa.array(np.maximum.reduceat(doc, new))],
                ["h", "lo", "hi"])


def _anchors(batches):
    """Each document's distinct anchor hashes."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keys = batch.column(2).to_numpy(zero_copy_only=False)
        for first, texts in c.text_batches(batch.column(1), SLICE_CHARS):
            w = Words(_utf8(texts))
            at, text = w.cover_positions()
            if not len(at):
                continue
            h = w.window_hashes(at, ANCHOR)
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
            row = first + text[new]
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[row]), pa.array(keys[row])], ["h", "doc", "key"])


def _windows(batches):
    """Each document's windows that contain a shared anchor."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keys = batch.column(2).to_numpy(zero_copy_only=False)
        for first, texts in c.text_batches(batch.column(1), SLICE_CHARS):
            w = Words(_utf8(texts))
            at, text = w.cover_positions()
            if not len(at):
                continue
            h = w.window_hashes(at, ANCHOR).view(np.int64)
            marks = np.zeros(len(w.starts) + 1, np.int32)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            for k in range(len(texts)):
                own = slice(bounds[k], bounds[k + 1])
                shared = at[own][np.isin(h[own], batch.column(3)[first + k].values.to_numpy())]
                begin, end = w.first[k], w.first[k + 1] - WINDOW + 1
                np.add.at(marks, np.maximum(shared - (WINDOW - ANCHOR), begin), 1)
                np.add.at(marks, np.minimum(shared + 1, end), -1)
            p = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            if not len(p):
                continue
            text_of = np.searchsorted(w.first, p, side="right") - 1
            row = first + text_of
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.window_hashes(p, WINDOW, 0).view(np.int64)), pa.array(w.window_hashes(p, WINDOW, 1).view(np.int64)),
                 pa.array(ids[row]), pa.array(keys[row]), pa.array((p - w.first[text_of]).astype(np.int32))],
                ["k1", "k2", "doc", "key", "pos"])


def removed_mask(n: int, positions: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are inside a window that starts at one of ``positions``."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, positions, 1)
    np.add.at(marks, np.minimum(positions + WINDOW, n), -1)
    return np.cumsum(marks[:-1]) > 0


def _kept(batches):
    """Kept words of each document, in batches of about ``SLICE_CHARS`` bytes."""
    def rows(doc_ids, out):
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])

    for batch in batches:
        out: tuple[list, ...] = ([], [], [])
        first = size = 0
        for i, (t, r) in enumerate(zip(batch.column(1), batch.column(2)), 1):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            n = 0
            if r.is_valid:
                gone = removed_mask(len(words), r.values.to_numpy())
                n = int(np.count_nonzero(gone))
                kept = [w for w, x in zip(words, gone.tolist()) if not x]
            else:
                kept = words
            out[0].append(len(words))
            out[1].append(n)
            out[2].append(b" ".join(kept))
            size += len(out[2][-1])
            if size >= SLICE_CHARS or i == batch.num_rows:
                yield rows(batch.column(0).slice(first, i - first), out)
                out, first, size = ([], [], []), i, 0


# ------------------------------------------------------------------ steps between tasks

def _release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver has collected their handles; do that now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """``doc, key, positions``: first words of the repeated windows of each document that has any;
    ``key`` is the XXH64 of the text, so rows that share a doc_id stay apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("doc is not null")
    keyed = rows.withColumn("key", F.xxhash64("text"))
    with c.small_batches(spark):
        shared = c.stored(rows.mapInArrow(_anchor_groups, "h bigint, lo bigint, hi bigint").groupBy("h")
                          .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("h"), "shared-anchors")
        _release(spark)
        by_doc = c.stored(keyed.mapInArrow(_anchors, "h bigint, doc bigint, key bigint").join(shared, "h")
                          .groupBy("doc", "key").agg(F.collect_set("h").alias("hs")), "anchors-by-document")
        _release(spark)
        found = (keyed.join(by_doc, ["doc", "key"]).select("doc", "text", "key", "hs")
                 .mapInArrow(_windows, "k1 bigint, k2 bigint, doc bigint, key bigint, pos int")
                 .withColumn("part", F.pmod("k1", F.lit(passes)).cast("int")))
        path, schema = c.fresh_path(spark, "windows"), found.schema
        found.write.partitionBy("part").parquet(path)
        _release(spark)
    out = None
    for part in range(passes):
        own = spark.read.schema(schema).parquet(path).filter(F.col("part") == part)
        owner = c.stored(own.groupBy("k1", "k2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
                         .filter("lo < hi").select("k1", "k2", "lo"), "owners")
        gone = c.stored(own.join(owner, ["k1", "k2"]).filter("doc > lo").groupBy("doc", "key")
                        .agg(F.collect_set("pos").alias("positions")), "repeats")
        out = gone if out is None else out.union(gone)
        _release(spark)
    out = c.stored(out.groupBy("doc", "key").agg(F.flatten(F.collect_list("positions")).alias("positions")), "repeats")
    c.discard(spark, path)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept`` (kept words joined by one blank)."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    gone = repeats(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(doc_id).cast("bigint").alias("doc"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    return (rows.join(gone, ["doc", "key"], "left").select("doc_id", "text", "positions")
            .mapInArrow(_kept, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string"))


def digest(kept: str):
    return F.sha2(F.col(kept), 256)
