"""Ranked lexical search (12) against a plain scorer over whole texts."""

import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from pairlens.llm import lexical, queries
from pairlens.llm.sql import SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, own) for i, own in held if own]
    big_n, big_l = len(held), sum(own.total() for _, own in held)
    df = Counter(t for _, own in held for t in own)
    out = []
    for item, text in items:
        scores = []
        for i, own in held:
            m = 100 - 25 + (25 * own.total() * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * own[t]) // (1000 * own[t] + 12 * m))
                    for t in terms(text) if t in own)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def table(texts):
    rng = random.Random(3)
    more = [" ".join(rng.choice("The cat Dog é bird über fish 12 x_y a-b z".split()) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    every = [*texts, *more, *more[:25], *["The same words in all."] * 60]
    return [(None if i % 41 == 40 else (i * 53) % 997, t) for i, t in enumerate(every)]


@pytest.fixture(scope="module")
def items(table):
    rng = random.Random(8)
    own = [" ".join(rng.choice([t for _, t in table if t]).split()[:30]) for _ in range(25)]
    return [*enumerate(own), (3, own[3]), (None, "Cat dog cat"), (90, ""), (91, None), (92, "nowhere_known"), (93, "The SAME words, words!"), (94, "same " * 500)]


@pytest.mark.parametrize("shard_bytes, shard_docs", [(lexical.SHARD_BYTES, lexical.SHARD_DOCS), (3000, 1 << 16), (1 << 20, 7)])
def test_against_brute_force(spark, table, items, shard_bytes, shard_docs):
    """Shards of any size and queries in any blocks give the same hits."""
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    index = lexical.build(docs, shard_bytes=shard_bytes, shard_docs=shard_docs)
    want = brute(table, items)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical.search(index, asked)) == want
    assert rows(lexical.search(index, asked, block_chars=600)) == want
    assert len(want) > 300


def test_strata_are_runs_of_equal_normaliser(spark, table):
    index = lexical.build(spark.createDataFrame(table, "doc_id long, text string").coalesce(1))
    head = index.rows.filter("term is null").collect()
    assert len(head) == 1 and head[0].norms == sorted(set(head[0].norms)) and len(head[0].starts) == len(head[0].norms)
    assert len(head[0].ids) == index.n_docs == sum(bool(terms(t)) for _, t in table)
    starts, norms = head[0].starts, head[0].norms
    for r in index.rows.filter("term in ('cat', 'the', 'words')").collect():
        stratum = [max(k for k, s in enumerate(starts) if s <= d) for d in r.docs]
        assert list(zip(stratum, r.tfs)) == sorted(zip(stratum, r.tfs)) and r.df == len(r.docs)
    assert norms[0] >= 75


def test_long_text_and_slices(monkeypatch):
    text = ("Alpha beta-Gamma é " * 300 + "x" * 5000 + " ") * 3
    whole = Counter(t.encode() for t in terms(text))
    for size in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(lexical, "SLICE", size)
        assert lexical.term_counts(text) == whole


def test_term_totals(texts, monkeypatch):
    column = pa.array([*texts, None, "", "ab", "cd", "é", "-a-", "x"])
    want = [len(terms(t)) for t in column.to_pylist()]
    for size in (1, 5, 1000, 1 << 20):
        monkeypatch.setattr(lexical, "SLICE", size)
        some = column if size > 100 else column[-40:]
        assert lexical.term_totals.func(some).to_pylist() == want[-len(some):]
    assert lexical.term_totals.func(column[:0]).to_pylist() == []


def test_query_and_sql(spark, save, docs):
    benchmark = spark.createDataFrame([(1, "w1 w2 w3."), (2, "Two words ß"), (3, None)], "item_id long, text string")
    folder = save(documents=docs, benchmark=benchmark)
    got = rows(queries.op12_lexical_search(spark, folder))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    cur = con.execute(SQL["op12_lexical_search"])
    at = [x[0] for x in cur.description]
    assert got == sorted((tuple(dict(zip(at, r))[k] for k in ("item_id", "rank", "doc_id", "score")) for r in cur.fetchall()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(1, "w1 w2 w3."), (2, "Two words ß"), (3, None)])


def test_empty_tables_and_other_names(spark):
    docs = spark.createDataFrame([("b", "Cat cat", 1), ("a", "cat CAT", 2), ("c", "dog", 3)], "name string, body string, number int")
    items = spark.createDataFrame([("q", "cat", 5)], "q string, words string, score int")
    index = lexical.build(docs, "name", "body")
    assert [(r.q, r["rank"], r.doc_id) for r in lexical.search(index, items, "q", "words").orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    assert [r.doc_id for r in lexical.search(index, items, "q", "words", top=1).collect()] == ["a"]
    assert lexical.search(index, items.limit(0), "q", "words").count() == 0
    assert lexical.search(lexical.build(docs.limit(0), "name", "body"), items, "q", "words").count() == 0
