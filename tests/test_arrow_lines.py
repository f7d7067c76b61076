"""Arrow dataset folders (S3, K6) and numbered lines."""

import gzip
import json
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.sources import arrow_dataset as ad
from pairlens.sources import lines
from pairlens.sources.paths import open_path

TURNS = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))


def plain_folder(path, tables, **options):
    """A dataset folder as a single-machine library saves it."""
    os.makedirs(path)
    names = []
    for k, t in enumerate(tables):
        names.append({"filename": f"data-{k:05d}-of-{len(tables):05d}.arrow"})
        with pa.OSFile(f"{path}/{names[-1]['filename']}", "wb") as f, pa.ipc.new_stream(f, t.schema, options=pa.ipc.IpcWriteOptions(**options)) as s:
            for batch in t.to_batches(max_chunksize=100):
                s.write_batch(batch)
    with open(f"{path}/state.json", "w") as f:
        json.dump({"_data_files": names, "_fingerprint": "x", "_split": "train"}, f)


def pairs_table(first, n):
    turn = lambda i, x: [{"role": "user", "content": f"q{i}"}, {"role": "assistant", "content": f"{x}{i}é" * (i % 7)}]
    ids = range(first, first + n)
    return pa.table({"chosen": pa.array([turn(i, "c") for i in ids], TURNS), "rejected": pa.array([turn(i, "r") if i % 11 else None for i in ids], TURNS),
                     "source": pa.array([f"s{i % 3}" for i in ids]).dictionary_encode(), "saescore": pa.array([i / 4 for i in ids])})


@pytest.mark.parametrize("compression", [None, "zstd"])
def test_shards_of_another_writer(spark, tmp_path, compression):
    path = str(tmp_path / "ds")
    plain_folder(f"{path}/train", [pairs_table(0, 1234), pairs_table(1234, 1), pairs_table(1235, 0), pairs_table(1235, 765)], compression=compression)
    plain_folder(f"{path}/test", [pairs_table(0, 5)])
    with open(f"{path}/dataset_dict.json", "w") as f:
        json.dump({"splits": ["train", "test"]}, f)
    whole = ad.read(spark, path, window_bytes=9000)
    assert whole.columns == ["chosen", "rejected", "source", "saescore"] and whole.schema["source"].dataType.simpleString() == "string"
    assert whole.rdd.getNumPartitions() > 8
    want = pairs_table(0, 2000).to_pylist()
    got = [r.asDict(recursive=True) for r in whole.orderBy("saescore").collect()]
    assert got == want
    assert ad.read(spark, path, split="test").count() == 5
    rows = ad.numbered(spark, path, ["saescore"])
    assert rows.count() == 2000 and rows.filter("row != saescore * 4").count() == 0


def test_only_asked_columns_are_decoded(spark, tmp_path):
    plain_folder(str(tmp_path / "ds"), [pairs_table(0, 300)])
    few = ad.read(spark, str(tmp_path / "ds"), ["saescore"])
    assert few.columns == ["saescore"] and few.agg(F.sum("saescore")).first()[0] == sum(i / 4 for i in range(300))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "saescore" in plan and "chosen" not in plan
    reader = ad._Reader({"path": str(tmp_path / "ds")}, few.schema)
    batch = next(iter(reader.read(reader.partitions()[0])))
    assert batch.schema.names == ["saescore"] and batch.num_rows == 100


def test_message_headers_agree_with_the_library(tmp_path):
    plain_folder(str(tmp_path / "ds"), [pairs_table(0, 450)])
    name = f"{tmp_path}/ds/data-00000-of-00001.arrow"
    system, at = open_path(f"file://{name}")
    with system.open_input_file(at) as f:
        own = list(ad.messages(f))
    with pa.OSFile(name) as f:
        reader, kinds = pa.ipc.MessageReader.open_stream(f), []
        for m in reader:
            kinds.append(m.type)
    assert [{1: "schema", 2: "dictionary", 3: "record batch"}[m.kind] for m in own] == kinds
    assert [m.rows for m in own if m.kind == 3] == [100, 100, 100, 100, 50]
    assert own[-1].start + own[-1].size <= os.path.getsize(name)


def library_rows(path):
    """The rows as a single-machine reader sees them: the state file's shards, in order."""
    with open(f"{path}/state.json") as f:
        names = [x["filename"] for x in json.load(f)["_data_files"]]
    out = []
    for n in names:
        with pa.OSFile(f"{path}/{n}") as f:
            out += pa.ipc.open_stream(f).read_all().to_pylist()
    return names, out


def test_written_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 5000, 1, 7).select(F.col("id").alias("pair_id"), F.concat(F.lit("t"), "id").alias("chosen"), (F.col("id") / 8).alias("saescore"))
    ad.write(df, path, shard_bytes=20_000)
    names, rows = library_rows(path)
    assert [r["pair_id"] for r in rows] == list(range(5000)) and len(names) >= 7
    assert sorted(os.listdir(path)) == sorted([*names, "dataset_info.json", "state.json"])
    with open(f"{path}/dataset_info.json") as f:
        assert json.load(f)["features"] == {"pair_id": {"dtype": "int64", "_type": "Value"}, "chosen": {"dtype": "string", "_type": "Value"},
                                            "saescore": {"dtype": "float64", "_type": "Value"}}
    ad.write(df.limit(3), path)  # the new state replaces the old, and its shards go
    names, rows = library_rows(path)
    assert len(rows) == 3 and sorted(os.listdir(path)) == sorted([*names, "dataset_info.json", "state.json"])
    ad.write(df.limit(2), path, mode="append")
    assert len(library_rows(path)[1]) == 5
    ad.write(df.limit(0), f"{path}0")
    assert ad.read(spark, f"{path}0").count() == 0 and ad.read(spark, f"{path}0").columns == df.columns


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 1000, 1, 4).select(F.col("id"))
    ad.write(df, path)
    before = sorted(os.listdir(path))
    bad = df.select(F.when(F.col("id") == 999, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="broken"):
        ad.write(bad, path)
    assert sorted(os.listdir(path)) == before and ad.read(spark, path).count() == 1000


def test_nine_variants_in_one_pass(spark, tmp_path):
    names = [f"flip_{x:.2f}%" for x in (0.5, 1, 2.5, 5)] + [f"remove_{x:.1f}%" for x in (2, 4, 6, 8, 10)]
    df = spark.range(0, 4000, 1, 5).select(F.element_at(F.array(*map(F.lit, names[:-1])), (F.col("id") % 8 + 1).cast("int")).alias("variant"), "id")
    ad.write(df, str(tmp_path), folder_column="variant", folders=names)
    assert sorted(os.listdir(tmp_path)) == sorted(names)
    for k, n in enumerate(names):
        back = ad.read(spark, f"{tmp_path}/{n}", split=None)
        assert back.columns == ["id"]
        assert sorted(r.id for r in back.collect()) == ([i for i in range(4000) if i % 8 == k] if k < 8 else [])
    with pytest.raises(Exception, match="must name a folder"):
        ad.write(df.withColumn("variant", F.lit("../x")), str(tmp_path), folder_column="variant")


# ------------------------------------------------------------------ lines

def plain_lines(raw):
    parts = re.split(b"\r\n|\n|\r", raw)
    return [p.decode("utf-8", "replace") for p in (parts[:-1] if parts[-1] == b"" else parts)]


@pytest.mark.parametrize("piece", [1, 3, 64, 1 << 20])
def test_blocks_part_a_file_at_any_byte(tmp_path, monkeypatch, piece):
    rng = random.Random(piece)
    monkeypatch.setattr(lines, "PIECE_BYTES", piece)
    monkeypatch.setattr(lines, "TAIL_BYTES", piece)
    for k in range(30):
        raw = b"".join(rng.choice([b"\n", b"\r\n", b"\r", b"ab", b"\xc3\xa9", b"xyz " * 5, b"\n\n"]) for _ in range(rng.randrange(0, 40)))
        name = str(tmp_path / f"{piece}-{k}.txt")
        with open(name, "wb") as f:
            f.write(raw)
        system, at = open_path(name)
        for size in (1, 2, 5, 1000):
            got = [x.as_py().decode() for start in range(0, len(raw), size)
                   for part in lines.block_lines(system, at, start, min(start + size, len(raw)), len(raw)) for x in part]
            assert got == plain_lines(raw), (raw, size)


def test_numbered_lines_over_files_and_blocks(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for k, name in enumerate(["a/x.txt", "a/part-00002.txt", "b/z.txt", "b/y.txt.gz", "b/empty.txt", "b/_hidden.txt"]):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        own = [f"{name} {i} " + "é" * rng.randrange(0, 40) for i in range(rng.randrange(50, 200))] if "empty" not in name else []
        raw = "\n".join(own).encode() + (b"\n" if k % 2 and own else b"")
        with (gzip.open if name.endswith("gz") else open)(tmp_path / name, "wb") as f:
            f.write(raw)
    order = ["a/x.txt", "a/part-00002.txt", "b/empty.txt", "b/y.txt.gz", "b/z.txt"]
    for name in order:
        with (gzip.open if name.endswith("gz") else open)(tmp_path / name, "rb") as f:
            want += plain_lines(f.read())
    for size in (100, 1 << 20):
        rows = lines.numbered_lines(spark, str(tmp_path), block_bytes=size).orderBy("line_no").collect()
        assert [(r.line_no, r.value) for r in rows] == list(enumerate(want, 1))
    kept = lines.numbered_lines(spark, str(tmp_path), "*.txt", keep=".*7", block_bytes=300).orderBy("line_no").collect()
    assert [r.value for r in kept] == [x for x in want if "7" in x and "y.txt" not in x]
    assert [r.line_no for r in kept] == list(range(1, len(kept) + 1))


def test_no_copy_of_the_text(spark, tmp_path):
    """The index has a row per block; reading has no shuffle of lines."""
    with open(tmp_path / "a.txt", "wb") as f:
        f.write(b"line\n" * 10_000)
    index = lines.index_lines(spark, str(tmp_path), block_bytes=5000)
    assert index.count() == 10 and index.columns == ["file_no", "file", "size", "start", "stop", "first"]
    assert [r["first"] for r in index.orderBy("start").collect()] == list(range(1, 10_001, 1000))


def test_bytes_that_are_no_text(spark, tmp_path):
    with open(tmp_path / "a.txt", "wb") as f:
        f.write(b"good\nb\xffd\n")
    assert [r.value for r in lines.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == ["good", "b�d"]
    assert np.array_equal(lines._ends(np.frombuffer(b"a\r\nb\rc\r", np.uint8)), [2, 4])
