"""What queries keep on disk: variants share their bytes, a finished write's shuffles go, contexts are ranked without texts."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.config import EOS, MARKER
from pairlens.operators import contexts as ctx
from pairlens.operators import curate
from pairlens.operators import vectors as vec
from pairlens.plans import corpus
from pairlens.session import shuffles_dropped
from pairlens.sinks import files as sink
from pairlens.sources import arrow_dataset as ad
from pairlens.sources import files as src

LENGTH = 16


def _scored(spark, n):
    score = F.when(F.col("id") % 7 == 0, F.lit(0.5)).otherwise((F.col("id") * 37 % n) / 8)  # with ties
    text = lambda c: F.when(F.col("id") % 11 != 3, F.concat(F.lit(c), F.repeat(F.md5(F.col("id").cast("string")), 20)))
    return spark.range(0, n, 1, 3).select(F.col("id").alias("pair_id"), text("c").alias("chosen"), text("r").alias("rejected"), score.alias("saescore"))


def _size(*folders):
    """Bytes on disk: a file counts once, whatever its names."""
    files = {os.stat(p).st_ino: os.stat(p).st_size for f in folders for d, _, names in os.walk(f) for p in (f"{d}/{x}" for x in names if x.endswith(".arrow"))}
    return sum(files.values())


@pytest.mark.parametrize("variants,shares", [(curate.flip_variants, (0.1, 0.2, 0.35, 0.5)), (curate.drop_variants, (0.0, 0.3, 1.0))])
def test_grouped_variants_hold_each_row_once(spark, tmp_path, variants, shares):
    scored = _scored(spark, 500).localCheckpoint()
    each, grouped = variants(scored, shares), variants(scored, shares, grouped=True)
    back = grouped.select(F.explode("variants").alias("variant"), *[c for c in grouped.columns if c != "variants"])
    assert back.columns == each.columns and grouped.count() <= 750
    rows = sorted(map(repr, each.collect()))
    assert sorted(map(repr, back.collect())) == rows and rows
    names = sorted({r.variant for r in each.select("variant").distinct().collect()} | {"none"})
    sink.write_variants(grouped, str(tmp_path / "grouped"), names)
    sink.write_variants(grouped, str(tmp_path / "grouped"), names)  # a second write replaces the first
    sink.write_variants(each, str(tmp_path / "each"), names)
    read = src.read_variants(spark, str(tmp_path / "grouped"), names)
    assert sorted(map(repr, read.select(each.columns).collect())) == rows
    assert sorted(os.listdir(tmp_path / "grouped")) == names
    assert _size(tmp_path / "grouped") < 0.7 * _size(tmp_path / "each") and _size(tmp_path / "each") < 0.5 * 500 * 1280 * len(names)


def test_variant_folders_are_complete_without_the_others(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b"], 1), (["b"], 2), (["a", "b"], 3), ([], 4), (["a", "a"], 5)], "variants array<string>, id long")
    ad.write(df, str(tmp_path), folder_column="variants", folders=["a", "b", "c"])
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "c"]
    ad.write(spark.createDataFrame([(["a"], 9)], df.schema), str(tmp_path), folder_column="variants")  # replaces a, not b
    held = {n: sorted(r.id for r in ad.read(spark, f"{tmp_path}/{n}", split=None).collect()) for n in "abc"}
    assert held == {"a": [9], "b": [1, 2, 3], "c": []}
    with pytest.raises(Exception, match="must name a folder"):
        ad.write(spark.createDataFrame([(["a", "../x"], 1)], df.schema), str(tmp_path), folder_column="variants")


def test_without_links_each_folder_has_its_own_shards(spark, tmp_path, monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = staticmethod(lambda: 0)
    monkeypatch.setattr(ad, "_links", lambda fs: False)
    monkeypatch.setattr(ad, "TaskContext", Task)
    schema = spark.createDataFrame([], "variants array<string>, id long").schema
    writer = ad._Writer({"path": str(tmp_path), "folder_column": "variants"}, schema, True)
    batch = pa.RecordBatch.from_pylist([{"variants": ["a", "b"], "id": 1}, {"variants": ["b"], "id": 2}])
    writer.commit([writer.write(iter([batch]))])
    assert [sorted(r.id for r in ad.read(spark, f"{tmp_path}/{n}", split=None).collect()) for n in "ab"] == [[1], [1, 2]]
    assert all(os.stat(f"{d}/{x}").st_nlink == 1 for d, _, names in os.walk(tmp_path) for x in names)


def test_small_shards_are_read_together(spark, tmp_path):
    ad.write(spark.range(0, 100, 1, 20), str(tmp_path / "ds"))
    reader = ad._Reader({"path": str(tmp_path / "ds")}, spark.range(1).schema)
    assert len(reader.partitions()) == 1
    rows = ad.numbered(spark, str(tmp_path / "ds"), ["id"])
    assert sorted(map(tuple, rows.collect())) == [(i, i) for i in range(100)]


def test_a_write_leaves_no_shuffle(spark, tmp_path):
    held = lambda: {s for s in range(10_000) if tracker.containsShuffle(s)}
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    df = spark.range(0, 1000, 1, 4).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before, conf = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(conf, None)
    with shuffles_dropped(spark):
        df.write.parquet(str(tmp_path / "p"))
        ad.write(df, str(tmp_path / "a"))
    assert held() <= before and spark.conf.get(conf, None) == was
    assert spark.read.parquet(str(tmp_path / "p")).count() == ad.read(spark, str(tmp_path / "a")).count() == 7


def _token_rows(spark):
    """Chunks with ties, more copies of one than a class keeps, and repeated texts; markers, quotes and end tokens inside."""
    rng = random.Random(5)
    words = ["alpha", "Alpha", "beta", '"', MARKER, EOS, "gam ma", "é", "x"]
    rows = []
    for i in range(300):
        n = rng.choice([2, 5, 12, LENGTH])
        own = ["alpha", "beta", "x", "Alpha", "x"] if i % 4 == 0 else [rng.choice(words) for _ in range(n)]
        strong = [(s, p, rng.randrange(4), rng.choice([0.5, 0.25, 0.125 + 1e-12, 0.125, rng.random()]), own[p])
                  for s, p in enumerate(range(0, len(own) - 1, 3)) if own[p] != EOS for _ in range(2)]
        if i % 4 == 0:
            strong = [(0, 0, 1, 0.5, "alpha"), (1, 3, 1, 0.75, "Alpha")]
        rows.append((i // 2 if i < 40 else i, rng.choice(["chosen", "rejected"]) if i >= 40 else "chosen", 0, i < 40, len(own), own, strong))
    return spark.createDataFrame(rows, "pair_id long, side string, chunk_id int, repeated boolean, n_tokens int, words array<string>, "
                                       "strong array<struct<seg_no: int, end_pos: int, latent: int, value: double, end_token: string>>")


def test_token_contexts_are_ranked_without_their_texts(spark):
    rows, p = _token_rows(spark), corpus.TEST.with_(contexts_per_class=3, max_length=LENGTH, window=6)
    listed = spark.createDataFrame([(0,), (1,), (3,)], "latent int")
    got = corpus.corpus_token_contexts(corpus.PairRun(None, rows, None, p, {"listed": listed}))
    once, more = rows.filter("not repeated"), rows.filter("repeated")
    own = ctx.cut_in_rows(corpus.context_tokens(once, p, "strong"), "strong", corpus.CHUNK_KEYS, p.window)
    acts = more.select(*corpus.CHUNK_KEYS, F.inline("strong"))
    met = ctx.cut_contexts(acts, corpus.context_tokens(more, p), corpus.CHUNK_KEYS, p.window)
    cut = own.unionByName(met.select(own.columns)).filter("latent in (0, 1, 3)").withColumn("token_class", ctx.token_class(F.col("end_token")))
    want = ctx.top_contexts(cut, p.contexts_per_class)
    shown = lambda df: sorted((r.latent, r.token_class, r.ctx_rank, round(r.value, 9), r.context) for r in df.collect())
    assert shown(got) == shown(want) and want.count() > 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((.*?)\)", plan)
    assert dealt and all(re.match(r"latent#\d+, token_class#\d+, rank#\d+,", x) for x in dealt)  # only ties


def test_no_text_is_cut_twice_where_all_values_differ(spark):
    rows = spark.createDataFrame([(i, "chosen", 0, False, 3, ["a", "b", f"c{i}"], [(0, 0, 0, 0.5 + i / 100, "a")]) for i in range(8)], _token_rows(spark).schema)
    run = corpus.PairRun(None, rows, None, corpus.TEST, {"listed": spark.createDataFrame([(0,)], "latent int")})
    got = corpus.corpus_token_contexts(run).orderBy("ctx_rank").collect()
    assert [(r.ctx_rank, r.value, r.context) for r in got] == [(8 - i, 0.5 + i / 100, f"<ACTIVATED>  b c{i}") for i in reversed(range(8))]


def test_copies_of_a_chunk_and_sums_by_side():
    batch = pa.RecordBatch.from_pydict({"same": pa.array([7, 7, 3, 7, 7, 3], pa.int64()), "repeated": [False, False, False, False, True, False],
                                        "side": ["c", "r", "c", "r", "c", None]})
    assert vec._few_copies(batch, "same", 2).tolist() == [True, True, True, False, True, True]
    assert vec._first_of_its_kind(batch.column("side")).tolist() == [0, 1, 0, 1, 0, 5]
