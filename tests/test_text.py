from pyspark.sql import functions as F

from pairlens.config import MARKER
from pairlens.functions import text as tx
from pairlens.operators import text as txo
from pairlens.operators.contexts import with_context

M = MARKER


def _docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_marks_run_with_inner_blank(spark):
    row = _docs(spark, ["Hi, you. \nBye"]).select(tx.mark_boundaries(tx.normalize("text")).alias("m")).first()
    assert row.m == f"Hi,{M} you. \n{M} Bye \n{M}"


def test_empty_text_is_one_marked_word(spark):
    row = _docs(spark, [""]).select(tx.mark_boundaries(tx.normalize("text")).alias("m")).first()
    assert row.m == f"\n{M}"


def test_blank_set_matches_python_split(spark):
    blanks = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
    text = "a" + blanks + "b"
    row = _docs(spark, [text]).select(tx.normalize("text").alias("n")).first()
    assert row.n == " ".join(text.split()) + " \n"


def _n_chunks(spark, n_words, width, min_tail=5):
    # n_words - 1 plain words + the final newline word
    text = " ".join(["w"] * (n_words - 1))
    return txo.chunk_words(_docs(spark, [text]), ["doc_id"], width, min_tail).count()


def test_short_text_and_tail(spark):
    assert _n_chunks(spark, 5, 944) == 0
    assert _n_chunks(spark, 6, 944) == 1
    assert _n_chunks(spark, 949, 944) == 1
    assert _n_chunks(spark, 950, 944) == 2


def test_gap_rule(spark):
    toks = ["w"] * 30
    for c in (3, 6, 7, 12, 13, 17, 25):
        toks[c + 1] = M
    df = spark.createDataFrame([(0, 0, toks)], "doc_id long, chunk_id int, tokens array<string>")
    ends = txo.segment_ends(df, 5).first().ends
    assert ends == [6, 12, 17, 25]


def test_sequence_mask(spark):
    df = spark.createDataFrame([(0, 0, f"a. {M} b")], "doc_id long, chunk_id int, chunk string")
    row = txo.to_sequences(df, 6).first()
    assert row.tokens == ["a.", M, "b", "<|end_of_text|>", "<|end_of_text|>", "<|end_of_text|>"]
    assert row.mask == [1, 0, 1, 0, 0, 0]
    assert row.n_tokens == 3


def test_context_window_bounds_and_mark(spark):
    toks = ["x0", "x1", "[PAD]", "a", "b", "c", "d", "<|end_of_text|>", "e"]
    df = spark.createDataFrame([(toks, 4), (toks, 7), (toks, 8)], "tokens array<string>, end_pos int")
    rows = with_context(df, "tokens", "end_pos", 128).collect()
    assert rows[0].context == "a <ACTIVATED>  c d"
    assert rows[1].context is None      # the position is itself an end token
    assert rows[2].context is None      # the last token is never inside the window


def test_long_window_is_reclipped(spark):
    toks = [f"t{i}" for i in range(300)]
    df = spark.createDataFrame([(toks, 150)], "tokens array<string>, end_pos int")
    ctx = with_context(df, "tokens", "end_pos", 128).first().context.split(" ")
    # 65 left + 65 right (end exclusive) = 130 > 128 -> 64 + 1 + 64
    assert len([t for t in ctx if t]) == 129
    assert ctx[0] == "t86" and ctx[-1] == "t214"


def test_class_from_token_groups_by_token(spark):
    from pairlens.operators import contexts as ctx
    toks = ["Alpha", "beta.", "<|reserved_special_token_1|>", "Gamma", "beta.", "<|reserved_special_token_1|>"]
    chunks = spark.createDataFrame([(0, toks)], "chunk_id int, tokens array<string>")
    acts = spark.createDataFrame([(0, 1, 7, 2.0, True), (0, 4, 7, 1.0, True), (0, 3, 7, 0.5, True)],
                                 "chunk_id int, end_pos int, latent int, value double, end_ok boolean")
    plain = ctx.strongest_contexts(acts, chunks, ["chunk_id"], 128, 10).collect()
    assert {r.token_class for r in plain} == {""} and len(plain) == 3
    by_tok = ctx.strongest_contexts(acts, chunks, ["chunk_id"], 128, 1, class_from_token=True).collect()
    assert sorted((r.token_class, r.value) for r in by_tok) == [("beta.", 2.0), ("gamma", 0.5)]
