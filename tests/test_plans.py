"""Physical-plan properties the operators rely on at scale."""

from pyspark.sql import functions as F

from pairlens.operators import contexts as ctx
from pairlens.operators import features as feat
from pairlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_sums_aggregate_partially_before_the_shuffle(spark):
    acts = spark.range(0, 10000).select(
        (F.col("id") % 3).cast("int").alias("latent"),   # one hot feature holds a third of the rows
        F.when(F.col("id") % 2 == 0, "chosen").otherwise("rejected").alias("side"),
        F.lit(1.0).alias("value"))
    df = feat.feature_sums(acts, 8)
    plan = _plan(df)
    assert "partial_sum" in plan
    rows = {r.latent: (r.v_chosen, r.v_rejected) for r in df.collect()}
    assert rows[0] == (1667.0, 1667.0) and rows[7] == (0.0, 0.0)


def test_top_contexts_limit_groups_before_the_shuffle(spark):
    # feature 1 holds almost every row
    hot = spark.range(0, 5000).select(F.when(F.col("id") % 50 == 0, 2).otherwise(1).alias("latent"),
                                      F.lit("").alias("token_class"),
                                      (F.col("id") / 7).alias("value"),
                                      F.concat(F.lit("c"), F.col("id").cast("string")).alias("context"))
    df = ctx.top_contexts(hot, 10)
    rows = df.collect()
    assert "WindowGroupLimit" in _plan(df)
    assert len(rows) == 20
    assert sorted(r.ctx_rank for r in rows if r.latent == 1) == list(range(1, 11))


def test_flagship_scan_is_pruned_and_topn_is_take_ordered(spark):
    df = QUERIES["top_features"](spark, SF)
    plan = _plan(df)
    assert "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in \
        df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_reconstruction_metrics_need_no_join(spark):
    for name in ("reconstruct", "normalized_mse", "kl_divergence"):
        assert "Join" not in _plan(QUERIES[name](spark, SF))


def test_segment_counts_write_nothing(spark, tmp_path):
    import os
    from pairlens.session import checkpoint_dir
    folder = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    QUERIES["segment_counts"](spark, SF).collect()
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_one_token_array_per_chunk_in_the_context_join(spark, tmp_path):
    """Forty activations on each chunk: the join that brings the tokens has a row per chunk."""
    n = 300
    chunks = spark.range(n).select(F.col("id").alias("chunk_id"), F.array(*[F.concat(F.lit(f"w{i}x"), F.col("id").cast("string")) for i in range(20)]).alias("tokens"))
    acts = spark.range(n * 40).select((F.col("id") % n).alias("chunk_id"), (F.col("id") % 5 * 3 + 1).cast("int").alias("end_pos"),
                                      (F.col("id") % 7).cast("int").alias("latent"), (F.col("id") / 3).alias("value"))
    chunks.write.parquet(f"{tmp_path}/chunks")
    acts.write.parquet(f"{tmp_path}/acts")
    df = ctx.activation_contexts(spark.read.parquet(f"{tmp_path}/acts"), spark.read.parquet(f"{tmp_path}/chunks"), ["chunk_id"], 128)
    assert df.count() == n * 40
    plan = _plan(df)
    assert plan.index("Generate inline") < plan.index("Join") < plan.index("ObjectHashAggregate")
    got = {(r.chunk_id, r.end_pos): r.context for r in df.collect()}
    plain = ctx.with_context(spark.read.parquet(f"{tmp_path}/acts").distinct().join(spark.read.parquet(f"{tmp_path}/chunks"), "chunk_id"), "tokens", "end_pos", 128)
    assert got == {(r.chunk_id, r.end_pos): r.context for r in plain.collect()}


def test_token_classes_are_known_before_windows_are_cut(spark, tmp_path):
    """A hundred classes: only each class's strongest activations reach the join."""
    n = 5000
    acts = spark.range(n).select(F.col("id").alias("chunk_id"), F.lit(1).alias("end_pos"), F.lit(0).alias("latent"), (F.col("id") / 8).alias("value"),
                                 F.lit(True).alias("end_ok"), F.concat(F.lit("c"), F.col("id") % 100).alias("token_class"))
    chunks = spark.range(n).select(F.col("id").alias("chunk_id"), F.array(F.lit("a"), F.concat(F.lit("C"), F.col("id") % 100), F.lit("b"), F.lit("x")).alias("tokens"))
    acts.write.parquet(f"{tmp_path}/acts")
    known = spark.read.parquet(f"{tmp_path}/acts")
    top = ctx.strongest_contexts(known, chunks, ["chunk_id"], 128, 3, class_from_token=True)
    assert {(r.token_class, r.ctx_rank, r.chunk_id) for r in top.collect()} == {(f"c{k}", j, n - 100 * j + k) for k in range(100) for j in (1, 2, 3)}
    looked_up = ctx.strongest_contexts(known.drop("token_class"), chunks, ["chunk_id"], 128, 3, class_from_token=True)
    assert sorted(map(tuple, looked_up.select("token_class", "ctx_rank", "chunk_id").collect())) == sorted(map(tuple, top.select("token_class", "ctx_rank", "chunk_id").collect()))
    plan = _plan(top)
    assert plan.index("WindowGroupLimit") < plan.index("collect_list")


def test_ties_of_a_feature_are_never_gathered(spark, tmp_path):
    """1e5 equal activations of one feature: each task ships at most ten rows of it, and the
    strongest contexts are right."""
    n = 100_000
    acts = spark.range(0, n, 1, 8).select(F.lit(1).alias("latent"), F.lit(2.5).alias("value"), F.col("id").alias("chunk_id"),
                                          F.lit(True).alias("end_ok"), F.lit(1).alias("end_pos"))
    chunks = spark.range(0, n, 1, 8).select(F.col("id").alias("chunk_id"), F.array(
        F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 6, "0")), F.lit("end"), F.lit("tail"), F.lit("x")).alias("tokens"))
    acts.write.parquet(f"{tmp_path}/acts")  # so that the optimizer doesn't know the constants
    df = ctx.strongest_contexts(spark.read.parquet(f"{tmp_path}/acts"), chunks, ["chunk_id"], 128, 10)
    rows = df.orderBy("ctx_rank").collect()
    assert [r.chunk_id for r in rows] == list(range(n - 1, n - 11, -1))
    plan = _plan(df)
    assert plan.count("WindowGroupLimit") >= 2 and " rank(" not in plan
