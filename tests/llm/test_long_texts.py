"""Texts of megabytes: one line, hashes, special strings, one long word."""

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pairlens.llm import queries, tokens

LIB = Tokenizer.from_file(tokens.tokenizer_path())
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def long_docs():
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(5000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return [
        (1, prose(900_000)),                                                 # 5 MB, one line
        (2, "".join(f"{rng.getrandbits(128):032x}\n" for _ in range(60_000))),
        (3, "<|endoftext|>".join(prose(12) for _ in range(20_000))),
        (4, "x" * 3_000_000),
        (5, "a short text, with a mark."),
        (6, None),
    ]


@pytest.fixture(scope="module")
def folder(spark, long_docs, save):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in long_docs],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in long_docs], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(long_docs[0][1].split()[700_000:700_020])), (2, "short text")], "item_id long, text string")
    return save(documents=docs, labels=labels, benchmark=bench)


def by_id(spark, folder, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}


def test_token_ids_and_counts(spark, folder, long_docs):
    ids = {i: LIB.encode(t or "", add_special_tokens=False).ids for i, t in long_docs}
    codes, counts = by_id(spark, folder, "op1_token_codes"), by_id(spark, folder, "op8_token_counts")
    for i, own in ids.items():
        assert counts[i].n_tokens == len(own) and codes[i].n_tokens == len(own) + 1
        assert codes[i].ids_crc32 == zlib.crc32(np.array([*own, 0], "<u4").tobytes())
    packed = queries.op5_packing(spark, folder).collect()
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in ids} == {i: len(own) + 1 for i, own in ids.items()}


def test_words_and_windows(spark, folder, long_docs):
    n = {i: len(WORD.findall(t or "")) for i, t in long_docs}
    assert {i: r.n_words for i, r in by_id(spark, folder, "op2_substring_dedup").items()} == n
    assert {i: r.n_words for i, r in by_id(spark, folder, "op7_quality_rules").items()} == n
    hits = by_id(spark, folder, "op4_decontaminate")
    assert hits[1].n_words == n[1] and hits[1].n_hit >= 20 and hits[5].n_hit == 2 and hits[4].n_hit == 0


def test_secrets_and_fingerprints(spark, folder, long_docs):
    found = by_id(spark, folder, "op6_secrets")
    assert found[2].n_hex == 60_000 and found[1].n_hex == found[4].n_hex == 0
    prints = by_id(spark, folder, "op10_simhash")
    assert len({r.fingerprint for r in prints.values()}) == len(long_docs) and prints[6].fingerprint == "0" * 16


def test_models_and_search(spark, folder, long_docs):
    assert set(by_id(spark, folder, "op3_language")) == {i for i, _ in long_docs}
    assert set(by_id(spark, folder, "op13_toxicity")) == {i for i, _ in long_docs}
    top = [(r.item_id, r["rank"], r.doc_id) for r in queries.op12_lexical_search(spark, folder).collect()]
    assert (1, 1, 1) in top and (2, 1, 5) in top
