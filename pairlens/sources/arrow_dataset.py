"""Datasets in Arrow folders (S3, K6): reading and writing as a Spark data source.

A dataset folder holds shards, Arrow record-batch streams, and ``state.json``, which
names them in order; ``dataset_info.json`` describes the columns. A folder of splits
has a ``dataset_dict.json`` and one such folder for each split.

Reading. A task takes a byte window of a shard: it walks the message headers from the
shard's start (each names its body's size, so bodies are skipped) and decodes the
batches that begin in its window, only the columns of the schema asked for. A shard of
any size is read by many tasks, and the driver only lists the shards. With the options
``file_index`` and ``row_index`` a row also carries its shard's number and its place in
it, known from the headers alone; ``numbered`` turns them into row numbers.

Writing. A task writes shards beside the dataset under a name of its own attempt; only
the committed attempts' shards are moved in, and the new ``state.json`` replaces the
old one in one rename, so a reader sees the old dataset or the new one, and a failed
task leaves nothing. With ``folder_column`` the rows go to one dataset per value of that
column, all in one pass; if that column holds a list of names the row is in each of those datasets, and where the
file system has hard links its bytes are written once: the shard has a name in every folder.

Paths are those that pyarrow's file systems open (local and mounted folders, HDFS and
object stores).
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from pairlens.sources.paths import exists, open_path

FORMAT = "arrow_dataset"
STATE, INFO, SPLITS = "state.json", "dataset_info.json", "dataset_dict.json"
WINDOW_BYTES = 64 << 20
#: Smaller shards are read by one task up to this many bytes.
PACK_BYTES = 8 << 20
SHARD_BYTES = 500 << 20
#: What a Python task holds at a time: rows that Spark hands over, and a batch of a shard.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_SCHEMA, _DICTIONARY, _BATCH = 1, 2, 3


def _json(fs: pafs.FileSystem, path: str) -> dict:
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def is_dataset(path: str) -> bool:
    """A folder with a state file, or one of splits."""
    fs, at = open_path(path)
    return exists(fs, f"{at}/{STATE}") or exists(fs, f"{at}/{SPLITS}")


def split_path(path: str, split: str = "train") -> str:
    """The folder of a split where there are splits, else the folder itself."""
    fs, at = open_path(path)
    return f"{path.rstrip('/')}/{split}" if exists(fs, f"{at}/{split}/{STATE}") else path


def _shards(fs: pafs.FileSystem, at: str) -> list[str]:
    return [f"{at}/{x['filename']}" for x in _json(fs, f"{at}/{STATE}")["_data_files"]]


# ------------------------------------------------------------------ messages of a stream

@dataclass(frozen=True)
class Message:
    kind: int
    rows: int
    start: int
    size: int


def _field(meta: bytes, table: int, number: int) -> int:
    """Place of a table's field in a message header, 0 where it is absent."""
    vtable = table - struct.unpack_from("<i", meta, table)[0]
    if 4 + 2 * number >= struct.unpack_from("<H", meta, vtable)[0]:
        return 0
    offset = struct.unpack_from("<H", meta, vtable + 4 + 2 * number)[0]
    return table + offset if offset else 0


def _message(meta: bytes) -> tuple[int, int, int]:
    """(kind, rows, size of the body) of a message header."""
    table = struct.unpack_from("<I", meta, 0)[0]
    kind, header, body = (_field(meta, table, n) for n in (1, 2, 3))
    rows = 0
    if meta[kind] == _BATCH:
        batch = header + struct.unpack_from("<I", meta, header)[0]
        length = _field(meta, batch, 0)
        rows = struct.unpack_from("<q", meta, length)[0] if length else 0
    return meta[kind], rows, struct.unpack_from("<q", meta, body)[0] if body else 0


def messages(f) -> Iterator[Message]:
    """The messages of a record-batch stream, from their headers only."""
    at, size = 0, f.size()
    while at + 8 <= size:
        head = f.read_at(8, at)
        mark, n = struct.unpack("<Ii", head)
        prefix = 8
        if mark != 0xFFFFFFFF:  # streams of before 2019 have no mark
            prefix, n = 4, mark
        if n == 0:
            return
        kind, rows, body = _message(f.read_at(n, at + prefix))
        yield Message(kind, rows, at, prefix + n + body)
        at += prefix + n + body


def _plain(schema: pa.Schema) -> pa.Schema:
    """Dictionary-coded columns as plain ones."""
    return pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type, f.nullable) for f in schema])


# ------------------------------------------------------------------ source

class ArrowDataset(DataSource):
    """``spark.read.format("arrow_dataset").load(folder)`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _index_fields(self) -> list[T.StructField]:
        names = {"file_index": T.IntegerType(), "row_index": T.LongType()}
        return [T.StructField(self.options[k], kind) for k, kind in names.items() if k in self.options]

    def schema(self) -> T.StructType:
        fs, at = open_path(self.options["path"])
        with fs.open_input_file(_shards(fs, at)[0]) as f, pa.ipc.open_stream(f) as stream:
            own = from_arrow_schema(_plain(stream.schema))
        return T.StructType([*own.fields, *self._index_fields()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.window = int(options.get("window_bytes", WINDOW_BYTES))
        self.file_index, self.row_index = options.get("file_index"), options.get("row_index")

    def partitions(self) -> list[InputPartition]:
        fs, at = open_path(self.path)
        infos = fs.get_file_info(_shards(fs, at))
        packs, room = [], 0
        for k, i in enumerate(infos):
            for start in range(0, i.size, self.window):
                own = min(self.window, i.size - start)
                if own > room:
                    packs.append([])
                    room = min(self.window, PACK_BYTES)
                packs[-1].append((k, i.path, start, start + self.window))
                room -= own
        return [InputPartition(p) for p in packs] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for piece in partition.value:
            yield from self._read(*piece)

    def _read(self, number: int, path: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        fs, _ = open_path(self.path)
        want = to_arrow_schema(self.schema)
        extra = {self.file_index, self.row_index} - {None}
        names = [n for n in want.names if n not in extra]
        with fs.open_input_file(path) as f:
            lead, options, row = b"", None, 0
            for m in messages(f):
                if m.start >= stop:
                    break
                if m.kind == _BATCH:
                    if m.start >= start:
                        batch = None
                        if names:
                            data = pa.py_buffer(lead + f.read_at(m.size, m.start))
                            if options is None:
                                fields = pa.ipc.open_stream(pa.py_buffer(lead)).schema.names
                                options = pa.ipc.IpcReadOptions(included_fields=sorted(fields.index(n) for n in names), use_threads=False)
                            batch = pa.ipc.open_stream(data, options=options).read_next_batch()
                        yield self._columns(want, batch, m.rows, number, row)
                    row += m.rows
                elif names:  # the schema, and dictionaries that the batches behind them use
                    lead += f.read_at(m.size, m.start)

    def _columns(self, want: pa.Schema, batch: pa.RecordBatch | None, rows: int, number: int, row: int) -> pa.RecordBatch:
        out = []
        for field in want:
            if field.name == self.file_index:
                out.append(pa.array([number] * rows, field.type))
            elif field.name == self.row_index:
                out.append(pa.array(range(row, row + rows), field.type))
            else:
                out.append(batch.column(field.name).cast(field.type))
        return pa.RecordBatch.from_arrays(out, schema=want)


# ------------------------------------------------------------------ sink

@dataclass
class _Written(WriterCommitMessage):
    #: (folders, partition, shard of the task, path, rows, bytes)
    shards: list[tuple]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"], schema, overwrite
        self.by = options.get("folder_column")
        self.folders = json.loads(options.get("folders", "[]"))
        self.shard_bytes = int(options.get("shard_bytes", SHARD_BYTES))
        self.compression = options.get("compression")
        self.write_id = uuid.uuid4().hex

    def _temporary(self) -> str:
        return f"{open_path(self.path)[1]}/_temporary-{self.write_id}"

    def _arrow(self) -> pa.Schema:
        return to_arrow_schema(T.StructType([f for f in self.schema if f.name != self.by]))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, _ = open_path(self.path)
        own = f"{self._temporary()}/{uuid.uuid4().hex}"
        fs.create_dir(own)
        part = TaskContext.get().partitionId()
        schema, shards, open_ = self._arrow(), [], {}
        options = pa.ipc.IpcWriteOptions(compression=self.compression)

        def close(folders: tuple[str, ...]) -> None:
            name, sink, stream, rows = open_.pop(folders)
            stream.close()
            shards.append((folders, part, len(shards), name, rows, sink.tell()))
            sink.close()

        for batch in iterator:
            for named, rows in self._by_folder(batch, schema):
                # without links each folder's shards are written by the tasks
                for folders in ([named] if _links(fs) else [(f,) for f in named]):
                    if folders not in open_:
                        name = f"{own}/{len(shards) + len(open_)}-{uuid.uuid4().hex}.arrow"
                        sink = fs.open_output_stream(name)
                        open_[folders] = [name, sink, pa.ipc.new_stream(sink, schema, options=options), 0]
                    for piece in _pieces(rows):
                        open_[folders][2].write_batch(piece)
                    open_[folders][3] += rows.num_rows
                    if open_[folders][1].tell() >= self.shard_bytes:
                        close(folders)
        for folders in list(open_):
            close(folders)
        return _Written(shards)

    def _by_folder(self, batch: pa.RecordBatch, schema: pa.Schema) -> Iterator[tuple[tuple[str, ...], pa.RecordBatch]]:
        rows = pa.RecordBatch.from_arrays([batch.column(n).cast(schema.field(n).type) for n in schema.names], schema=schema)
        if self.by is None:
            yield ("",), rows
            return
        values = batch.column(self.by)
        if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
            sets = values.to_pylist()
            place = {key: k for k, key in enumerate(dict.fromkeys(tuple(dict.fromkeys(s or ())) for s in sets))}
            number = pa.array([place[tuple(dict.fromkeys(s or ()))] for s in sets], pa.int32())
        else:
            place = {(value,): value for value in values.unique().to_pylist()}
            number = values
        for names, k in place.items():
            for value in names:
                if not isinstance(value, str) or not value or "/" in value or value in (".", ".."):
                    raise ValueError(f"{self.by} must name a folder, found {value!r}")
            yield names, rows.filter(pc.equal(number, k))

    def commit(self, messages: list) -> None:
        fs, at = open_path(self.path)
        found: dict[str, list[tuple]] = {f: [] for f in ([""] if self.by is None else self.folders)}
        for m in messages:
            for folders, *shard in (m.shards if m else ()):
                for folder in folders:
                    found.setdefault(folder, []).append((*shard, len(folders) > 1))
        for folder, shards in found.items():
            self._put(fs, f"{at}/{folder}" if folder else at, sorted(shards))
        fs.delete_dir(self._temporary())

    def _put(self, fs: pafs.FileSystem, target: str, shards: list[tuple]) -> None:
        """Move the shards in, point the state file at them, then drop what it named before."""
        fs.create_dir(target)
        old = _json(fs, f"{target}/{STATE}")["_data_files"] if exists(fs, f"{target}/{STATE}") else []
        schema = self._arrow()
        if not shards and (self.overwrite or not old):  # a dataset without rows still has its columns
            name = f"{self._temporary()}/empty-{uuid.uuid4().hex}.arrow"
            with fs.open_output_stream(name) as sink, pa.ipc.new_stream(sink, schema):
                pass
            shards = [(0, 0, name, 0, fs.get_file_info(name).size, False)]
        files = []
        for k, (_, _, name, _, _, shared) in enumerate(shards):
            files.append({"filename": f"data-{k:05d}-of-{len(shards):05d}-{self.write_id[:12]}.arrow"})
            (_link if shared else fs.move)(name, f"{target}/{files[-1]['filename']}")
        kept = [] if self.overwrite else old
        self._replace(fs, f"{target}/{INFO}", {
            "citation": "", "description": "", "homepage": "", "license": "", "features": {f.name: _feature(f.type) for f in schema}})
        self._replace(fs, f"{target}/{STATE}", {
            "_data_files": kept + files, "_fingerprint": self.write_id[:16], "_format_columns": None, "_format_kwargs": {}, "_format_type": None,
            "_output_all_columns": False, "_split": os.path.basename(target) if os.path.basename(target) in ("train", "test", "validation") else None})
        for x in old if self.overwrite else ():
            fs.delete_file(f"{target}/{x['filename']}")

    def _replace(self, fs: pafs.FileSystem, path: str, content: dict) -> None:
        with fs.open_output_stream(f"{path}.{self.write_id}") as f:
            f.write(json.dumps(content, indent=2).encode())
        fs.move(f"{path}.{self.write_id}", path)

    def abort(self, messages: list) -> None:
        fs, _ = open_path(self.path)
        if exists(fs, self._temporary()):
            fs.delete_dir(self._temporary())


def _links(fs: pafs.FileSystem) -> bool:
    """Files can have several names: each folder is complete without the others, and shards are never changed in place."""
    return isinstance(fs, pafs.LocalFileSystem)


def _link(name: str, target: str) -> None:
    try:
        os.link(name, target)
    except OSError:  # a mounted store without links
        shutil.copyfile(name, target)


def _pieces(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``BATCH_BYTES``, so that a reader never holds more."""
    step = max(1, rows.num_rows * BATCH_BYTES // max(rows.nbytes, 1))
    return (rows.slice(s, step) for s in range(0, rows.num_rows, step))


def _feature(kind: pa.DataType):
    """A column's type as the description file has it."""
    if pa.types.is_struct(kind):
        return {f.name: _feature(f.type) for f in kind}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return {"feature": _feature(kind.value_type), "_type": "Sequence"} if not pa.types.is_struct(kind.value_type) else [_feature(kind.value_type)]
    names = {"double": "float64", "float": "float32"}
    return {"dtype": names.get(str(kind), str(kind)), "_type": "Value"}


# ------------------------------------------------------------------ use

def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowDataset)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, split: str | None = "train", **options) -> DataFrame:
    """S3: a dataset folder (its ``split`` when it has splits); ``columns`` limits what is decoded."""
    register(spark)
    path = split_path(path, split) if split else path
    reader = spark.read.format(FORMAT).options(**options)
    if columns is None:
        return reader.load(path)
    whole = ArrowDataset({"path": path, **{k: str(v) for k, v in options.items()}}).schema()
    return reader.schema(T.StructType([whole[c] for c in columns])).load(path)


def numbered(spark: SparkSession, path: str, columns: list[str], number: str = "row", split: str | None = "train") -> DataFrame:
    """S3 with row numbers from 0 in the dataset's order. The sizes of the shards come from
    headers only; they are one row per shard."""
    index = {"file_index": f"_file_{number}", "row_index": f"_at_{number}"}
    rows = read(spark, path, [*columns, *index.values()], split, **index)
    places = read(spark, path, list(index.values()), split, **index)
    sizes = places.groupBy(index["file_index"]).agg(F.count("*").alias("_n"))
    # over shards, not rows
    before = sizes.select(index["file_index"], (F.sum("_n").over(Window.orderBy(index["file_index"])) - F.col("_n")).alias("_before"))
    return (rows.join(F.broadcast(before), index["file_index"])
            .select((F.col("_before") + F.col(index["row_index"])).alias(number), *columns))


def write(df: DataFrame, path: str, folder_column: str | None = None, folders: list[str] = (), mode: str = "overwrite", **options) -> None:
    """K6: a dataset, or one per value of ``folder_column`` (or per name in its lists); ``folders`` are made even without
    rows. With the option ``compression`` (zstd, lz4) the bodies of the batches are compressed, which readers see to themselves."""
    register(df.sparkSession)
    if folder_column:
        options |= {"folder_column": folder_column, "folders": json.dumps(list(folders))}
    conf = df.sparkSession.conf
    before = conf.get(_BATCH_CONF, None)
    conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        df.write.format(FORMAT).options(**options).mode(mode).save(path)
    finally:
        conf.unset(_BATCH_CONF) if before is None else conf.set(_BATCH_CONF, before)


def write_splits(splits: dict[str, DataFrame], path: str) -> None:
    """A folder of splits."""
    for name, df in splits.items():
        write(df, f"{path.rstrip('/')}/{name}")
    fs, at = open_path(path)
    with fs.open_output_stream(f"{at}/{SPLITS}") as f:
        f.write(json.dumps({"splits": list(splits)}).encode())
