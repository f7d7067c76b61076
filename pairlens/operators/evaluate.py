"""Quality metrics.

Row-level values are array expressions inside the row; the reductions are
plain aggregates (partial per task, then final), so none of them gathers a
group in one place.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.arrays import array_mean_square, array_sq_error, let, softplus
from pairlens.session import materialize


def _log_softmax(v) -> F.Column:
    """Stable log-softmax; the max and the log-sum-exp are bound once per row."""
    def with_max(m):
        lse = m + F.log(F.aggregate(v, F.lit(0.0), lambda acc, y: acc + F.exp(y - m)))
        return let(lse, lambda c: F.transform(v, lambda y: y - c))
    return let(F.array_max(v), with_max)


def normalized_mse_both(df: DataFrame, batch_col: str, x: str = "x", x_hat: str = "x_hat") -> DataFrame:
    """A7 both ways in one pass: row mean (``nmse``) and mean of batch means
    (``nmse_batch_mean``), from per-batch sums and counts. Rows without energy have
    no normalised error; ``n_skipped`` says how many."""
    row = F.try_divide(array_sq_error(F.col(x_hat), F.col(x)), array_mean_square(F.col(x))).alias("nmse")
    per_batch = df.select(batch_col, row).groupBy(batch_col).agg(
        F.sum("nmse").alias("s"), F.count("nmse").alias("n"), F.count_if(F.col("nmse").isNull()).alias("k"))
    return per_batch.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("nmse"),
                         F.avg(F.try_divide("s", "n")).alias("nmse_batch_mean"), F.sum("k").alias("n_skipped"))


def kl_rows(df: DataFrame, logits: str, logits_hat: str) -> DataFrame:
    """KL(softmax(logits) || softmax(logits_hat)) summed over the vocabulary, per row."""
    def kl(pair):
        lp = let(pair["a"], _log_softmax)
        lq = let(pair["b"], _log_softmax)
        return F.aggregate(F.zip_with(lp, lq, lambda u, w: F.exp(u) * (u - w)), F.lit(0.0),
                           lambda acc, y: acc + y)
    return df.withColumn("kl", let(F.struct(F.col(logits).alias("a"), F.col(logits_hat).alias("b")), kl))


def kl_divergence(df: DataFrame, logits: str, logits_hat: str, seq_col: str) -> DataFrame:
    """Summed over positions and vocabulary, divided by the number of sequences."""
    return kl_rows(df, logits, logits_hat).agg(
        (F.sum("kl") / F.countDistinct(seq_col)).alias("kl"),
        F.countDistinct(seq_col).alias("n_sequences"))


def _scaled_sum(v, m, each) -> F.Column:
    """sum of exp(v_i - m) * each_i."""
    return F.aggregate(F.zip_with(v, each, lambda a, e: F.exp(a - m) * e), F.lit(0.0), lambda acc, y: acc + y)


def kl_states(blocks: DataFrame, keys: list[str], logits: str, logits_hat: str) -> DataFrame:
    """A8 on blocks of the vocabulary: per row (``keys``) and block the state ``m, s, t`` of the logits (largest
    value, sum of exp(a - m), the same weighted by a - b) and ``mh, sh`` of the reconstructed ones. States of
    blocks merge into the state of the row, so no row is ever one array."""
    def state(x):
        a, b = x["a"], x["b"]
        return let(F.struct(F.array_max(a).alias("m"), F.array_max(b).alias("mh")), lambda top: F.struct(
            top["m"].alias("m"), _scaled_sum(a, top["m"], F.transform(a, lambda _: F.lit(1.0))).alias("s"),
            _scaled_sum(a, top["m"], F.zip_with(a, b, lambda u, w: u - w)).alias("t"),
            top["mh"].alias("mh"), _scaled_sum(b, top["mh"], F.transform(b, lambda _: F.lit(1.0))).alias("sh")))
    own = let(F.struct(F.col(logits).alias("a"), F.col(logits_hat).alias("b")), state)
    return blocks.filter(F.size(logits) > 0).select(*keys, own.alias("_s")).select(*keys, "_s.*")


def kl_of_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows' divergences from the states of their blocks: sum p (a - b) - log sum exp(a) + log sum exp(b). A row has
    as many states as blocks, a fixed number that follows from the vocabulary."""
    def merged(all_):
        return let(F.struct(F.array_max(F.transform(all_, lambda x: x["m"])).alias("m"), F.array_max(F.transform(all_, lambda x: x["mh"])).alias("mh")), lambda top: F.struct(
            top["m"].alias("m"), top["mh"].alias("mh"),
            F.aggregate(all_, F.lit(0.0), lambda acc, x: acc + x["s"] * F.exp(x["m"] - top["m"])).alias("s"),
            F.aggregate(all_, F.lit(0.0), lambda acc, x: acc + x["t"] * F.exp(x["m"] - top["m"])).alias("t"),
            F.aggregate(all_, F.lit(0.0), lambda acc, x: acc + x["sh"] * F.exp(x["mh"] - top["mh"])).alias("sh")))
    rows = states.groupBy(*keys).agg(F.collect_list(F.struct("m", "s", "t", "mh", "sh")).alias("_all"))
    total = let(let(F.col("_all"), merged), lambda x: x["t"] / x["s"] - (x["m"] + F.log(x["s"])) + (x["mh"] + F.log(x["sh"])))
    return rows.select(*keys, total.alias("kl"))


def kl_divergence_blocks(blocks: DataFrame, row_col: str, seq_col: str, logits: str, logits_hat: str) -> DataFrame:
    """A8 for logits that come in blocks of the vocabulary: one shuffle of five numbers per block."""
    rows = kl_of_states(kl_states(blocks, [seq_col, row_col], logits, logits_hat), [seq_col, row_col])
    return rows.agg((F.sum("kl") / F.countDistinct(seq_col)).alias("kl"), F.countDistinct(seq_col).alias("n_sequences"))


def preference_accuracy(rewards: DataFrame) -> DataFrame:
    """Share of pairs with r_chosen > r_rejected (a tie counts as wrong)."""
    return rewards.agg(F.avg((F.col("r_chosen") > F.col("r_rejected")).cast("double")).alias("accuracy"),
                       F.count("*").alias("n_pairs"))


def pairwise_loss(rewards: DataFrame) -> DataFrame:
    """Mean of -log sigmoid(r_chosen - r_rejected) = mean softplus(r_rejected - r_chosen)."""
    z = F.col("r_rejected") - F.col("r_chosen")
    return rewards.agg(F.avg(softplus(z)).alias("loss"), F.count("*").alias("n_pairs"))


def adjacent_pairs(rewards: DataFrame, order: str, value: str = "reward") -> DataFrame:
    """A12's pairing of a long table: rows 0, 2, 4 ... in ``order`` (a unique key) are chosen, the row after each is its
    rejected one. Output ``pair, r_chosen, r_rejected``; a last row without a partner is left out.

    The order is a range sort (fixed by a checkpoint, as in G1). Rows pair inside their partition; only what a
    border parts, at most two rows per partition, meets in a shuffle.
    """
    ordered = materialize(rewards.select(order, F.col(value).cast("double").alias("r")).orderBy(order)
                          .select(F.spark_partition_id().alias("part"), "r"))
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):  # one number per partition
        starts[part], total = total, total + sizes[part]
    schema = pa.schema([("pair", pa.int64()), ("r_chosen", pa.float64()), ("r_rejected", pa.float64())])

    def pair(batches):
        at, held = None, None
        for batch in batches:
            values = batch.column("r").to_pylist()
            if values and at is None:
                at = starts[batch.column("part")[0].as_py()]
            rows = []
            for v in values:
                if at % 2 == 0:
                    held = v
                elif held is None:  # its partner is in the partition before
                    rows.append((at // 2, None, v))
                else:
                    rows.append((at // 2, held, v))
                    held = None
                at += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(((at - 1) // 2, held, None), schema)], schema=schema)

    found = ordered.mapInArrow(pair, "pair bigint, r_chosen double, r_rejected double")
    whole = found.filter("r_chosen is not null and r_rejected is not null")
    cut = found.filter("r_chosen is null or r_rejected is null").groupBy("pair").agg(
        F.max("r_chosen").alias("r_chosen"), F.max("r_rejected").alias("r_rejected"))
    return whole.unionByName(cut.filter("r_chosen is not null and r_rejected is not null"))
