"""Toxicity by a factorization machine (13): plain sums, pairs, held-out documents, edge cases."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from pairlens.llm import queries, toxicity

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ren sat lim pok nu ver".split()]
RUDE = ["idiot", "scum", "crétin"]


def text_of(rng, n, *extra):
    own = [rng.choice(WORDS) for _ in range(n)] + list(extra)
    rng.shuffle(own)
    return " ".join(own).capitalize() + "."


def plain_terms(text):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    text = "A bad, BAD day for cé 12 d_e"
    ids = np.array(sorted(zlib.crc32(t.encode()) & ((1 << 28) - 1) for t in plain_terms(text)), np.uint32)
    assert toxicity.term_ids(text, 28).tolist() == ids.tolist() and len(ids) == 8
    known = ids[[0, 2, 3, 5, 6]]
    m = toxicity.Model(28, known, 0.3, rng.normal(size=5), rng.normal(size=(5, 4)), 2.0, -1.0)
    want = 0.3 + m.weights.sum() + sum(float(m.vectors[a] @ m.vectors[b]) for a, b in itertools.combinations(range(5), 2)) / math.sqrt(5)
    assert m.margin(ids) == pytest.approx(want)
    assert m.score(text) == pytest.approx(1 / (1 + math.exp(-(2 * want - 1))))


def test_first_step_is_the_gradient():
    """One document, one step: every parameter moves against the slope of the loss, measured by differences."""
    t = toxicity.Training(epochs=1, batch=4, min_docs=1, dim=3, shrink=0.0, shrink_vectors=0.0)
    rows = [(1, np.array([1, 2, 3], np.uint32))] * 4 + [(0, np.array([2, 4], np.uint32))]
    m = toxicity.train(rows, 0.5, t)
    rng = np.random.default_rng(t.seed)
    order = rng.permutation(5)
    fit = [rows[i] for k, i in enumerate(order) if k % 5]
    ids = np.unique(np.concatenate([x for _, x in fit]))
    at = np.concatenate([[0.0], np.zeros(len(ids)), rng.normal(0, t.start, (len(ids), 3)).ravel()])

    def loss(p):
        model = toxicity.Model(28, ids, p[0], p[1:len(ids) + 1], p[len(ids) + 1:].reshape(-1, 3))
        return sum(math.log1p(math.exp(-z if y else z)) for y, z in ((y, model.margin(x)) for y, x in fit))

    slope = np.array([(loss(at + e) - loss(at - e)) / 2e-6 for e in np.eye(len(at)) * 1e-6])
    want = at - t.rate * slope / np.sqrt(1 + slope ** 2)
    got = np.concatenate([[m.bias], m.weights, m.vectors.ravel()])
    assert got == pytest.approx(want, abs=1e-5)


def test_pairs_beyond_additive_weights():
    """Neither word is toxic alone; together they are. Additive weights alone can't part these."""
    rng = random.Random(1)
    rows = []
    for i in range(2400):
        a, b = i % 2, i // 2 % 2
        words = [rng.choice(WORDS) for _ in range(8)] + ["insulte"] * a + ["gruppe"] * b
        rows.append((a & b if rng.random() < 0.98 else 1 - (a & b), toxicity.term_ids(" ".join(words), 28)))
    m = toxicity.train(rows, 0.25, toxicity.Training(epochs=30))
    assert m.pair("insulte", "gruppe") > 3 * abs(m.pair("insulte", WORDS[0]))
    say = lambda *x: m.score(" ".join([*WORDS[:8], *x]))
    assert say("insulte", "gruppe") > 0.5 > 0.3 > max(say("insulte"), say("gruppe"), say())
    flat = toxicity.train(rows, 0.25, toxicity.Training(epochs=30, start=0.0))
    assert not flat.vectors.any()


@pytest.fixture(scope="module")
def table():
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        toxic = i % 7 == 0
        extra = [rng.choice(RUDE) for _ in range(rng.randrange(1, 4))] if toxic else []
        rows.append((i, text_of(rng, rng.randrange(5, 60), *extra), int(toxic)))
    return rows


def test_held_out_documents(spark, table, save):
    docs = [(i, t) for i, t, _ in table] + [(5000, None), (5001, ""), (5002, " \n.,!"), (None, "You idiot scum."), (5003, table[0][1] * 2000), table[3][:2]]
    labels = [(i, 1, y) for i, _, y in table if i % 5] + [(5001, 0, 0), (7777, 0, 1), (None, 0, 1), (3, 0, None), (8, 1, 0), (8, 0, 0)]
    folder = save(documents=spark.createDataFrame(docs, "doc_id long, text string"),
                  labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = queries.op13_toxicity(spark, folder).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    for r in rows:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [(got[i].predicted, y) for i, _, y in table if got[i].held_out]
    assert len(judged) > 300 and sum(a == b for a, b in judged) >= 0.99 * len(judged)
    assert [got[k].predicted for k in (5000, 5001, 5002, None, 5003)] == [0, 0, 0, 1, 1]
    again = {r.doc_id: r.score for r in queries.op13_toxicity(spark, folder).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_labels_of_held_out_rows_are_not_used(spark, table):
    docs = spark.createDataFrame([(i, t) for i, t, _ in table], "doc_id long, text string")
    turn = lambda y, i: 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y
    a = toxicity.sample(docs, spark.createDataFrame([(i, y) for i, _, y in table], "doc_id long, toxic int"))
    b = toxicity.sample(docs, spark.createDataFrame([(i, turn(y, i)) for i, _, y in table], "doc_id long, toxic int"))
    assert a[1] == b[1] and [(y, x.tolist()) for y, x in a[0]] == [(y, x.tolist()) for y, x in b[0]]


def test_bounded_sample_and_no_labels(spark, table):
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in table] * 2, "key long, body string, toxicity int")
    labels = spark.createDataFrame([(i, bool(y)) for i, _, y in table], "key long, bad boolean")
    t = toxicity.Training(per_class=50, terms_per_row=10)
    rows, share = toxicity.sample(docs, labels, "key", "body", "bad", t)
    assert sorted({y for y, _ in rows}) == [0, 1] and all(sum(y == k for y, _ in rows) <= 50 for k in (0, 1))
    assert max(len(x) for _, x in rows) <= 10 and share == pytest.approx(1 / 7, abs=0.02)
    out = toxicity.detect(docs, labels.filter("not bad"), "key", "body", "bad", t)
    assert out.columns == docs.columns and {r.toxicity for r in out.select("toxicity").distinct().collect()} == {0.0}
    assert toxicity.detect(docs.limit(0), labels, "key", "body", "bad", t).count() == 0
