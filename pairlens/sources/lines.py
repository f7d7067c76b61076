"""Text lines with their numbers, read by byte blocks.

A line's number is its place over all files in order, so a task that starts inside a
file has to know how many lines lie before it. One pass counts line ends per byte block;
the counts, one row per block, become an index (file, block, number of its first line) in
the shared folder. Reading takes the blocks of the index, not the splits of a text scan: a
task opens its file at the block, finds the first line that starts there and numbers on.
Texts are never copied, sorted or shuffled, and no setting can move a number between
building and running.

Lines end with ``\\n``, ``\\r\\n`` or a lone ``\\r``. Compressed files are one block each. With
``keep`` only lines that match it (bytes, from the line's start) count and come out.
Bytes that aren't UTF-8 read as replacement characters.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.session import stored
from pairlens.sources.paths import open_path

BLOCK_BYTES = 32 << 20
PIECE_BYTES = 4 << 20
#: step behind a block, for the rest of its last line
TAIL_BYTES = 1 << 16
_PACKED = (".gz", ".bz2", ".zst", ".lz4")


def list_files(path: str, glob: str | None = None) -> list[tuple[str, int]]:
    """(path, size) of the files below ``path`` in order of folder, part number (part-100000 comes after
    part-99999) and name; names that start with ``_`` or ``.`` are left out."""
    system, at = open_path(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(at, recursive=True))
    seen = [(i.path, i.size) for i in found if i.type == pafs.FileType.File and not re.search(r"/[_.]", i.path[len(at):])
            and (glob is None or fnmatch.fnmatch(i.base_name, glob))]

    def place(item: tuple[str, int]):
        folder, name = item[0].rsplit("/", 1)
        part = re.match(r"part-(\d+)", name)
        return folder, part is not None, int(part[1]) if part else 0, name

    return sorted(seen, key=place)


def _pieces(system: pafs.FileSystem, path: str, start: int, stop: int, size: int) -> Iterator[bytes]:
    """The bytes from ``start`` on, a piece at a time, for as long as more is asked for."""
    if path.endswith(_PACKED):
        with system.open_input_stream(path, compression="detect") as f:
            while raw := f.read(PIECE_BYTES):
                yield raw
        return
    with system.open_input_file(path) as f:
        while start < size:
            n = min(PIECE_BYTES, stop - start if start < stop else TAIL_BYTES, size - start)
            yield f.read_at(n, start)
            start += n


def _ends(data: np.ndarray) -> np.ndarray:
    """Places of line ends. A carriage return in the last place may be half of one and isn't counted."""
    end = data == 10
    lone = data[:-1] == 13
    if lone.any():
        end[:-1] |= lone & (data[1:] != 10)
    return np.flatnonzero(end)


def block_lines(system: pafs.FileSystem, path: str, start: int, stop: int, size: int) -> Iterator[pa.BinaryArray]:
    """The lines that start in a block, in order, a piece of the file at a time."""
    if path.endswith(_PACKED):
        stop = 1 << 62
    # from the byte before: the line that starts here is the one behind the first line end
    at, rest, skipping = max(start - 1, 0), b"", start > 0
    for piece in _pieces(system, path, at, stop, size):
        rest += piece
        data = np.frombuffer(rest, np.uint8)
        ends = _ends(data)
        if not len(ends):
            continue
        begins = np.concatenate([[0], ends[:-1] + 1])
        inside = begins + at < stop
        inside[0] &= not skipping
        skipping = False
        if inside.any():
            yield _lines(data, begins[inside], ends[inside])
        at, rest = at + int(ends[-1]) + 1, rest[int(ends[-1]) + 1:]
        if at >= stop:
            return
    if rest and not skipping:
        yield pa.array([rest.removesuffix(b"\r")], pa.binary())


def _lines(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Consecutive lines without their ends."""
    two = (ends > begins) & (data[ends] == 10) & (data[np.maximum(ends - 1, 0)] == 13)
    base = int(begins[0])
    text = np.ones(int(ends[-1]) + 1 - base, bool)
    text[ends - base] = False
    text[(ends - 1 - base)[two]] = False
    offsets = np.concatenate([[0], np.cumsum(ends - begins - two)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[base:base + len(text)][text])])


def _kept(lines: pa.BinaryArray, keep: str | None) -> pa.BinaryArray:
    if keep is None:
        return lines
    match = re.compile(keep.encode()).match
    return lines.filter(pa.array([match(x.as_py()) is not None for x in lines], pa.bool_()))


def _text(lines: pa.BinaryArray) -> pa.StringArray:
    try:
        return lines.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in lines], pa.string())


def _blocks(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("file_no", "file", "size", "start", "stop", "first")))


def index_lines(spark: SparkSession, path: str, glob: str | None = None, keep: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index ``file_no, file, size, start, stop, first``: a row per byte block with the number (from 1) of
    its first line, in the shared folder."""
    files = list_files(path, glob)
    names = spark.createDataFrame([(k, f, size) for k, (f, size) in enumerate(files)], "file_no int, file string, size bigint")
    packed = F.col("file").rlike(r"(?i)(" + "|".join(re.escape(x) for x in _PACKED) + ")$")
    starts = F.when(packed | (F.col("size") == 0), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(block_bytes).cast("bigint")))
    blocks = names.select("*", F.explode(starts).alias("start")).withColumn(
        "stop", F.when(packed, F.col("size")).otherwise(F.least(F.col("size"), F.col("start") + block_bytes))).withColumn("first", F.lit(0).cast("bigint"))
    n = sum(max(1, -(-size // block_bytes)) for _, size in files)

    def count(batches):
        for file_no, file, size, start, stop, _ in _blocks(batches):
            system, _ = open_path(path)
            total = sum(len(_kept(lines, keep)) for lines in block_lines(system, file, start, stop, size))
            yield pa.RecordBatch.from_pydict({"file_no": [file_no], "file": [file], "size": [size], "start": [start], "stop": [stop], "n": [total]},
                                             pa.schema([("file_no", pa.int32()), ("file", pa.string()), ("size", pa.int64()), ("start", pa.int64()),
                                                        ("stop", pa.int64()), ("n", pa.int64())]))

    counted = stored(blocks.repartition(max(1, min(n, 100_000))).mapInArrow(
        count, "file_no int, file string, size bigint, start bigint, stop bigint, n bigint"), "line-counts")
    in_file = F.sum("n").over(Window.partitionBy("file_no").orderBy("start")) - F.col("n")
    files_n = counted.groupBy("file_no").agg(F.sum("n").alias("_n"))
    # one row per file
    before = files_n.select("file_no", (F.sum("_n").over(Window.orderBy("file_no")) - F.col("_n")).alias("_before"))
    first = counted.withColumn("_in", in_file).join(before, "file_no").withColumn("first", F.col("_before") + F.col("_in") + 1)
    return stored(first.select("file_no", "file", "size", "start", "stop", "first"), "line-index")


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None, keep: str | None = None, block_bytes: int = BLOCK_BYTES,
                   each: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """``line_no`` (from 1, over all files in order), ``file``, ``value`` of every line. ``each`` turns a line
    into its value as it is read; lines it gives None for take a number and don't come out."""
    index = index_lines(spark, path, glob, keep, block_bytes)
    n = index.count()
    schema = pa.schema([("line_no", pa.int64()), ("file", pa.string()), ("value", pa.string())])

    def read(batches):
        for _, file, size, start, stop, first in _blocks(batches):
            system, _ = open_path(path)
            for lines in block_lines(system, file, start, stop, size):
                own = _kept(lines, keep)
                numbers, values = np.arange(first, first + len(own)), None
                if each is None:
                    values = _text(own)
                else:
                    made = pa.array([each(x.as_py()) for x in own], pa.string())
                    numbers, values = numbers[made.is_valid().to_numpy(zero_copy_only=False)], made.drop_null()
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([file] * len(values), pa.string()), values], schema=schema)
                first += len(own)

    return index.repartition(max(1, min(n, 100_000))).mapInArrow(read, "line_no bigint, file string, value string")
