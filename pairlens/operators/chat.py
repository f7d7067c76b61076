"""Chat rendering and reward-model sequences.

A conversation is rendered from its turn rows, joined in turn order. Tokens are
words; sequences keep the last ``max_length`` tokens (left truncation). Every
rendered turn holds a blank, so those words lie in the last turns: where only
sequences are wanted, ``last_turns`` drops the others before the shuffle and no
conversation is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.config import BOS, END_OF_TURN, HEADER_END, HEADER_START
from pairlens.functions.arrays import let
from pairlens.functions.text import blank_words, strip


def render_messages(messages: F.Column) -> F.Column:
    """array<struct<role, content>> in order -> chat text, no generation
    prompt, begin-of-text removed."""
    pieces = F.transform(messages, lambda m: F.concat(
        F.lit(HEADER_START), m["role"], F.lit(HEADER_END + "\n\n"), strip(m["content"]), F.lit(END_OF_TURN)))
    return F.replace(F.array_join(pieces, ""), F.lit(BOS), F.lit(""))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns of each conversation; every task ships at most ``n`` rows of one."""
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("role").desc(), F.col("text").desc())
    return turns.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n).drop("_back")


def turns_for(max_length: int) -> int:
    """Turns that surely hold the last ``max_length`` words with and without the last turn: the first
    word kept may be cut, and each turn ends one word at least."""
    return max_length + 2


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """Chat preference pairs from a turn table: the whole conversation is
    chosen, the conversation without its last turn is rejected.
    Output ``pair_id, n_turns, chosen, rejected`` (message arrays)."""
    msgs = (turns.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
                 .alias("m")))
    as_msgs = lambda arr: F.transform(arr, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return msgs.select(
        F.col("conv_id").alias("pair_id"), F.size("m").alias("n_turns"),
        as_msgs(F.col("m")).alias("chosen"),
        as_msgs(F.slice("m", 1, F.size("m") - 1)).alias("rejected"))


def left_truncate(tokens: F.Column, max_length: int) -> F.Column:
    """Last ``max_length`` tokens (``slice`` rejects start 0, so guard n = 0)."""
    def cut(t):
        n = F.size(t)
        return F.when(n == 0, t).otherwise(F.slice(t, -F.least(n, F.lit(max_length)), max_length))
    return let(tokens, cut)


def tokenize_pairs(pairs: DataFrame, max_length: int) -> DataFrame:
    """T11 + T12: render both sides, word tokens, left truncation.
    Adds tokens_j/k and mask_j/k (all ones: padding belongs to the batch)."""
    out = pairs
    for side, col in (("j", "chosen"), ("k", "rejected")):
        toks = left_truncate(blank_words(render_messages(F.col(col))), max_length)
        out = (out.withColumn(f"tokens_{side}", toks)
               .withColumn(f"mask_{side}", F.transform(f"tokens_{side}", lambda _: F.lit(1))))
    return out


def pairs_to_sequences(tok: DataFrame) -> DataFrame:
    """One row per side, chosen (j) then rejected (k), keyed by pair_id."""
    return tok.select("pair_id", F.explode(F.array(
        F.struct(F.lit("j").alias("side"), F.col("tokens_j").alias("tokens"), F.col("mask_j").alias("mask")),
        F.struct(F.lit("k").alias("side"), F.col("tokens_k").alias("tokens"), F.col("mask_k").alias("mask")),
    )).alias("s")).select("pair_id", "s.side", "s.tokens", "s.mask")
