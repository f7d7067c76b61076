"""Token operators against the tokenizers library: packing (5), token counts (8)."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlens.llm import packing, prefix_counts, queries, tokens

PATH = tokens.tokenizer_path()
LIB = Tokenizer.from_file(PATH)


def ids(t):
    return LIB.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(1)
    letters = list("abcdeilmnorstuv'''  \n\t.,!<|>0129éß日 \x1cć\U0001F600\x85　  ")
    fixed = ["", "a", "don't we're 'tis 'very I'll 'l ''s", " lead  two   three\n\n x \t y", "日本語 ß x　y", "foo\n bar", "foo \nbar  ",
             "<|endoftext|> a<|endoftext|>b  <|endoftext|>  c!<|endoftext|", "12 34 5a6b !!?? --- ...", "   ", "a'", "-" * 70 + "x" * 200]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(300)]


def test_encoder_is_the_librarys(odd, texts):
    enc = tokens.Encoder(PATH)
    every = [t or "" for t in odd + texts]
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(every)] == [ids(t) for t in every]


def test_encoder_cache_starts_anew(texts):
    enc = tokens.Encoder(PATH)
    enc.cache.limit = enc.runs.limit = 50
    for t in texts:
        assert np.frombuffer(enc.encode([t or ""])[0], "<u4").tolist() == ids(t)


def test_prefix_counts(odd):
    own = prefix_counts.PrefixCounter(PATH)
    for t in odd:
        assert np.frombuffer(own.texts([t])[0], np.int8).cumsum().tolist() == [len(ids(t[:i])) for i in range(1, len(t) + 1)], t


def test_token_count_query(spark, docs, save):
    got = {r.doc_id: r for r in queries.op8_token_counts(spark, save(documents=docs)).collect()}
    for r in docs.collect():
        g, n = got[r.doc_id], len(ids(r.text))
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len((r.text or "").encode()), n, n > 1024)
    assert any(g.over_limit for g in got.values())


def test_budget_questions(spark, docs):
    t = prefix_counts.prefix_table(docs.filter("length(text) between 300 and 3000"), name="text_")
    for r in t.select("text", prefix_counts.tokens_at("text_", F.lit(257)).alias("n"),
                      prefix_counts.truncation("text_", 40).alias("k")).collect():
        assert r.n == len(ids(r.text[:257]))
        assert len(ids(r.text[:r.k])) <= 40
        assert all(len(ids(r.text[:i])) > 40 for i in range(r.k + 1, min(len(r.text), r.k + 40)))
    assert prefix_counts.prefix_table(docs.limit(0)).count() == 0


def check_packing(rows, source, length):
    """Every document whole, cut by the rule; sequences gapless from 0."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(source)
    for d, own in by_doc.items():
        v = [*ids(source[d]), 0]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(v)
        assert all(r.length == length for r in own[1:]) and own[0].length <= length
        for r in own:
            part = np.array(v[r.start:r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by_sequence)


def test_packing_query(spark, docs, save):
    rows = queries.op5_packing(spark, save(documents=docs)).collect()
    n = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_levels(spark):
    """Many blocks: leftovers meet in later levels; near the bound; nothing lost."""
    rng = random.Random(2)
    rows = [(i, " ".join("the" for _ in range(rng.randrange(1, 180)))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(df, length=128, search=packing.Search(block_items=60)).collect()
    n = check_packing(got, dict(rows), 128)
    least = -(-sum(r.length for r in got) // 128)
    assert n <= 1.06 * least


def test_packing_merges_the_rests_of_blocks(spark):
    """Equal lengths, two to a sequence: all bins are 69% full, and still no block keeps a half one of its own."""
    rows = [(i, " ".join(["the"] * 43)) for i in range(161)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, length=128, search=packing.Search(block_items=20)).collect()
    assert {r.length for r in got} == {44}
    assert check_packing(got, dict(rows), 128) == 81


def test_crossover_inherits_the_best_bins_there_are():
    lens = [34] * 40
    a = packing.from_assignment([i // 2 for i in range(40)], lens, 100)
    b = packing.from_assignment([min(i, 39 - i) for i in range(40)], lens, 100)
    child = packing.crossover(a, b, lens, 100, 0.995, random.Random(1))
    assert sum(sorted(x) in a.bins for x in child.bins) > 3
    assert sorted(i for x in child.bins for i in x) == list(range(40))


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None, 2), (1, "a", 3), (None, "a", 4), (1, "a", 5)], "doc_id long, text string, piece int")
    got = packing.pack(df).collect()
    assert sorted(r.length for r in got) == [1, 2, 2, 2] and len({r.sequence_id for r in got}) == 1
    assert packing.pack(df.limit(0)).count() == 0
    full = spark.createDataFrame([(7, " ".join(["the"] * 255))], "doc_id long, text string")
    assert [(r.length, r.offset) for r in packing.pack(full, length=64).collect()] == [(64, 0)] * 4


def least_bins(lens, capacity):
    return -(-sum(lens) // capacity)


@pytest.mark.parametrize("seed", range(4))
def test_search_reaches_the_lower_bound(seed):
    """Lengths of documents, where best fit needs a sequence more than the total."""
    rng = random.Random(seed)
    lens = [n for n in (int(rng.lognormvariate(6, 1.1)) % 2048 for _ in range(2300)) if n][:2000]
    first = packing.packed(sorted(range(len(lens)), key=lambda i: -lens[i]), lens, 2048)
    best = packing.evolve(lens, [], 2048, packing.Search(), random.Random(7))
    assert sorted(i for b in best.bins for i in b) == list(range(len(lens)))
    assert len(best.bins) == least_bins(lens, 2048) <= len(first.bins)


def test_search_on_full_triplets():
    """Items cut from full sequences, three each: best fit is 6 % over, the search within 2 %."""
    rng = random.Random(11)
    lens = []
    for _ in range(1000):
        a = rng.randrange(500, 900)
        b = rng.randrange(500, 2048 - a - 400)
        lens += [a, b, 2048 - a - b]
    rng.shuffle(lens)
    first = packing.packed(sorted(range(len(lens)), key=lambda i: -lens[i]), lens, 2048)
    best = packing.evolve(lens, [], 2048, packing.Search(), random.Random(3))
    assert len(first.bins) > 1040 and len(best.bins) <= 1020
    assert all(sum(lens[i] for i in b) == f <= 2048 for b, f in zip(best.bins, best.fill))


def test_subset_against_brute_force():
    from itertools import combinations
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))]
        cap = rng.randrange(0, 60)
        got = packing.subset(sizes, cap)
        assert got == sorted(set(got), reverse=True)
        assert sum(sizes[k] for k in got) == max(x for n in range(len(sizes) + 1) for x in map(sum, combinations(sizes, n)) if x <= cap)


def test_crossover_keeps_every_item():
    rng = random.Random(4)
    lens = [rng.randrange(1, 100) for _ in range(300)]
    s = packing.Search()
    best = packing.evolve(lens, [], 100, s, rng)
    again = packing.evolve(lens, [packing.to_assignment(best)], 100, s, rng)
    assert sorted(i for b in again.bins for i in b) == list(range(300))
    assert all(sum(lens[i] for i in b) == f <= 100 for b, f in zip(again.bins, again.fill))
    assert len(again.bins) <= len(best.bins)


def test_plain_ascii_words_need_no_table():
    enc = tokens.Encoder(PATH)
    enc.letters = {}  # only characters beyond ASCII are looked up there
    every = ["some plain words\nhere 12 34, now. (x)\n", " lead", "\na", "pneumonoultramicroscopicsilicovolcanoconiosis 123456789012345678901234567890"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(every)] == [ids(t) for t in every]
    assert [np.frombuffer(tokens._packed(list(range(n))), "<u4").tolist() for n in (0, 1, 8, 9, 40)] == [list(range(n)) for n in (0, 1, 8, 9, 40)]


def test_distinct_runs_are_looked_up_once_a_slice():
    enc, asked = tokens.Encoder(PATH), []

    class Asked(tokens.RunCache):
        def __getitem__(self, run):
            asked.append(run)
            return super().__getitem__(run)

    enc.runs = Asked(enc._run)
    every = ["the cat, the cat\nthe 12 12 the cat", "", " the cat é ÿ9!! the", "don't  cut", "the"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(every)] == [ids(t) for t in every]
    assert " cat" in asked and len(asked) == len(set(asked))


def test_runs_of_several_texts():
    rng = random.Random(3)
    every = ["", " ", "x"] + ["".join(rng.choice("abZÀß÷×09.,-|  \n") for _ in range(rng.randrange(12))) for _ in range(600)]
    every = [t for t in every if tokens.plain(t)] + [""]
    runs, first = tokens.runs_of([t.encode() for t in every])
    assert [[r.decode() for r in runs[a:b].to_pylist()] for a, b in zip(first, first[1:])] == [tokens.RUNS.findall(t) for t in every]
    assert len(first) == len(every) + 1 > 200 and len(tokens.runs_of([])[0]) == 0
