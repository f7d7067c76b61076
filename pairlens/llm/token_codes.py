"""Token ids as directly addressable codes (operator 1).

Every id is split into chunks of ``CHUNK_BITS`` bits, lowest first. Level 0 holds
the first chunk of all ids, level 1 the second chunk of those ids that have one,
and so on; a bitmap per level says which entries continue, and a rank directory
(set bits before every block of ``BLOCK`` bits) turns a position of one level into
its position on the next. Any token is read with one step per level, without
decoding anything before it.

File format: Parquet files in the shared folder, written by Spark's committer (a
lost executor's task is written again, never twice). A row is a segment of whole
documents, about ``SEGMENT_TOKENS`` ids, in ascending doc_id order by (shard,
segment): ``shard, segment, shard_start, n_tokens, doc_ids, starts, code``. ``code``
is little-endian: magic, number of levels (u32 each), number of ids (u64), then
per level the number of entries (u64), chunk bytes, and for all but the last level
the bitmap (u64 words, bit i of word i div 64) and the rank directory (u32), each
part padded to 8 bytes.

Documents are dealt by ranges of doc_id; each shard is written in order, and a
shard's first position is the sum of the shards before it (one row per shard).

Defined cases: a null or empty text is the end id alone; a null doc_id comes
first; rows with one doc_id are ordered by text; an empty table gives no rows. Only
doc_id and text are read, whatever further columns are called; a text of any length is
encoded whole and goes into one segment.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm import common as c
from pairlens.llm import tokens

MAGIC = 0x31434144  # "DAC1"
CHUNK_BITS = 8
BLOCK = 512
SEGMENT_TOKENS = 1 << 20


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def encode(ids: np.ndarray) -> bytes:
    """The code of unsigned 32-bit ids."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        chunk = (rest & 0xFF).astype(np.uint8).tobytes()
        above = rest >> CHUNK_BITS
        more = above != 0
        parts = [np.uint64(len(rest)).tobytes(), _padded(chunk)]
        last = not more.any()
        if not last:
            bits = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
            bits[:len(more)] = more
            counts = bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint32)
            before = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
            parts += [np.packbits(bits, bitorder="little").tobytes(), _padded(before.tobytes())]
        levels.append(b"".join(parts))
        if last:
            break
        rest = above[more]
    return np.array([MAGIC, len(levels)], "<u4").tobytes() + np.uint64(len(ids)).tobytes() + b"".join(levels)


class Codes:
    """Random access to the ids of a code; the buffer is viewed, never decoded as a whole."""

    def __init__(self, code):
        magic, n_levels = np.frombuffer(code, "<u4", 2)
        if magic != MAGIC:
            raise ValueError("not a token code")
        self.n = int(np.frombuffer(code, "<u8", 1, 8)[0])
        self.levels = []
        at = 16
        for k in range(n_levels):
            n = int(np.frombuffer(code, "<u8", 1, at)[0])
            chunk = np.frombuffer(code, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            words = ranks = None
            if k + 1 < n_levels:
                blocks = -(-n // BLOCK)
                words = np.frombuffer(code, "<u8", blocks * BLOCK // 64, at)
                at += blocks * BLOCK // 8
                ranks = np.frombuffer(code, "<u4", blocks + 1, at)
                at += 4 * (blocks + 1) + -4 * (blocks + 1) % 8
            self.levels.append((chunk, words, ranks))

    def __len__(self) -> int:
        return self.n

    def rank(self, level: int, i: int) -> int:
        """Entries before ``i`` that continue: one directory entry and the words of one block."""
        _, words, ranks = self.levels[level]
        block = i // BLOCK
        first, word = block * BLOCK // 64, i // 64
        own = int(ranks[block]) + int(np.bitwise_count(words[first:word]).sum())
        if i % 64:
            own += (int(words[word]) & ((1 << i % 64) - 1)).bit_count()
        return own

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunk, words, _) in enumerate(self.levels):
            value |= int(chunk[i]) << CHUNK_BITS * level
            if words is None or not int(words[i // 64]) >> i % 64 & 1:
                break
            i = self.rank(level, i)
        return value

    def ids(self, start: int, n: int, level: int = 0) -> np.ndarray:
        """``n`` ids from ``start`` on; touches only their own entries."""
        chunk, words, _ = self.levels[level]
        out = chunk[start:start + n].astype("<u4")
        if words is not None and n:
            own = words[start // 64:(start + n - 1) // 64 + 1]
            more = np.unpackbits(own.view(np.uint8), bitorder="little")[start % 64:start % 64 + n].astype(bool)
            k = int(np.count_nonzero(more))
            if k:
                out[more] |= self.ids(self.rank(level, start), k, level + 1) << CHUNK_BITS
        return out


# ------------------------------------------------------------------ files

def _segments(path: str, per_segment: int):
    def run(batches):
        enc = tokens.encoder(path)
        end = tokens.END_ID.to_bytes(4, "little")
        doc_ids, starts, parts, n, done, number, shard, kind = [], [], [], 0, 0, 0, None, None

        def segment():
            code = encode(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([done], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([doc_ids], pa.list_(kind)), pa.array([starts], pa.list_(pa.int64())), pa.array([code], pa.binary())],
                ["shard", "segment", "shard_start", "n_tokens", "doc_ids", "starts", "code"])

        for batch in batches:
            own, kind = batch.column(0).to_pylist(), batch.column(0).type
            if len(own):
                shard = batch.column(2)[0].as_py()
            for first, texts in c.text_batches(batch.column(1), 4_000_000):
                for k, raw in enumerate(enc.encode(texts), first):
                    doc_ids.append(own[k])
                    starts.append(n)
                    parts += [raw, end]
                    n += len(raw) // 4 + 1
                    if n >= per_segment:
                        yield segment()
                        number, done = number + 1, done + n
                        doc_ids, starts, parts, n = [], [], [], 0
        if n:
            yield segment()
    return run


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
          per_segment: int = SEGMENT_TOKENS) -> None:
    """Write the ids of all documents, each with an end id, in ascending doc_id order."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())
    ordered.mapInArrow(_segments(path or tokens.tokenizer_path(), per_segment),
                       f"shard int, segment int, shard_start bigint, n_tokens bigint, doc_ids array<{kind}>, starts array<bigint>, code binary"
                       ).write.parquet(folder)


def _documents(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
            codes = Codes(row["code"].as_buffer())
            starts = np.array(row["starts"].values, np.int64)
            counts = np.diff(starts, append=len(codes))
            # every id of the segment is asked for, so its levels are read once and not once a document
            raw, cuts = memoryview(codes.ids(0, len(codes)).tobytes()), [*(4 * starts).tolist(), 4 * len(codes)]
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
            m = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [row["doc_ids"].values, pa.array([row["shard"].as_py()] * m, pa.int32()),
                 pa.array(starts + row["shard_start"].as_py()), pa.array(counts), pa.array(crcs, pa.int64())],
                ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, first``: ids of all shards before. One row per written partition meets in the window."""
    sums = spark.read.parquet(folder).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sums.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("first"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32`` per document."""
    table = spark.read.parquet(folder)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    rows = table.select("shard", "shard_start", "doc_ids", "starts", "code").mapInArrow(
        _documents, f"doc_id {kind}, shard int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(shard_starts(spark, folder), "shard").select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, folder: str, positions: list[int]) -> DataFrame:
    """``position, id`` of a stated list of global token positions: each segment reads its own directly."""
    asked = sorted(set(positions))
    segments = spark.read.parquet(folder).join(F.broadcast(shard_starts(spark, folder)), "shard")  # a row per written partition

    def run(batches):
        for b in batches:
            for code, lo, n in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = asked[bisect.bisect_left(asked, lo):bisect.bisect_left(asked, lo + n)]
                codes = Codes(code.as_buffer()) if own else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array([codes[i - lo] for i in own], pa.int64())], ["position", "id"])

    return segments.select("code", (F.col("first") + F.col("shard_start")).alias("lo"), "n_tokens").mapInArrow(run, "position bigint, id bigint")
