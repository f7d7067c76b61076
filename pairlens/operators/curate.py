"""Score-driven curation.

Each variant set is one tagged DataFrame (column ``variant``): the ranked
dataset is computed once (G1) and every share only moves a cut, so all
variants come out of a single pass and can be written with
``partitionBy('variant')``. Most rows are the same in all variants of a set: ``grouped``
gives such a row once, with its variants in a list (``variants``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.config import DROP_SHARES, FLIP_SHARES
from pairlens.operators.ranking import global_rank

# Scores are compared at 1e-9 when ranking: equal texts give equal scores up
# to summation order, and must then rank by pair_id.
_RANK_DIGITS = 9


def attach_scores(dataset: DataFrame, scores: DataFrame) -> DataFrame:
    """J6 + U2: attach ``saescore`` by ``pair_id``, missing -> 0.0; keep
    ``pair_id, chosen, rejected, saescore``."""
    return (dataset.select("pair_id", "chosen", "rejected")
            .join(scores.select("pair_id", "saescore"), "pair_id", "left")
            .select("pair_id", "chosen", "rejected",
                    F.coalesce("saescore", F.lit(0.0)).alias("saescore")))


def flip_name(share: float) -> str:
    return f"flip_{share * 100:.2f}%"


def drop_name(share: float) -> str:
    return f"remove_{share * 100:.1f}%"


def _cut(n: F.Column, share: F.Column) -> F.Column:
    """int(n * share) as in the original (float product, truncated)."""
    return F.floor(n.cast("double") * share).cast("long")


def _ranked(scored: DataFrame, order: list[F.Column]) -> DataFrame:
    """G1 on (pair_id, score) only; the texts join back on pair_id, so the
    ranking step never sorts or checkpoints the texts."""
    keys = global_rank(scored.select("pair_id", "saescore"), order, "rank", "_n")
    return scored.join(keys.select("pair_id", "rank", "_n"), "pair_id")


def _variants(names_shares, inside) -> F.Column:
    """Names of the variants whose cut the row is ``inside`` of."""
    return F.array_compact(F.array(*[F.when(inside(_cut(F.col("_n"), F.lit(share))), F.lit(name)) for name, share in names_shares]))


def _tagged(rows: DataFrame, grouped: bool) -> DataFrame:
    if grouped:
        return rows.filter(F.size("variants") > 0)
    return rows.select(F.explode("variants").alias("variant"), *[c for c in rows.columns if c != "variants"])


def flip_variants(scored: DataFrame, shares=FLIP_SHARES, grouped: bool = False) -> DataFrame:
    """W5 + U3: rank by score desc (pair_id breaks ties); in each variant swap
    chosen/rejected and negate the score of the first floor(n * share) rows."""
    ranked = _ranked(scored, [F.round("saescore", _RANK_DIGITS).desc(), F.col("pair_id")])
    named = [(flip_name(s), s) for s in shares]
    ways = F.array(F.struct(F.lit(True).alias("flip"), _variants(named, lambda cut: F.col("rank") < cut).alias("variants")),
                   F.struct(F.lit(False).alias("flip"), _variants(named, lambda cut: F.col("rank") >= cut).alias("variants")))
    tagged = ranked.select("*", F.explode(F.filter(ways, lambda w: F.size(w["variants"]) > 0)).alias("v"))
    flip = F.col("v.flip")
    return _tagged(tagged.select(
        F.col("v.variants").alias("variants"), "pair_id",
        F.when(flip, F.col("rejected")).otherwise(F.col("chosen")).alias("chosen"),
        F.when(flip, F.col("chosen")).otherwise(F.col("rejected")).alias("rejected"),
        F.when(flip, -F.col("saescore")).otherwise(F.col("saescore")).alias("saescore"),
        "rank"), grouped)


def drop_variants(scored: DataFrame, shares=DROP_SHARES, grouped: bool = False) -> DataFrame:
    """Rank by score asc (pair_id breaks ties); each variant drops the
    first floor(n * share) rows."""
    ranked = _ranked(scored, [F.round("saescore", _RANK_DIGITS), F.col("pair_id")])
    kept = _variants([(drop_name(s), s) for s in shares], lambda cut: F.col("rank") >= cut)
    return _tagged(ranked.select(kept.alias("variants"), "pair_id", "chosen", "rejected", "saescore", "rank"), grouped)
