"""Toxicity scores by a factorization machine over hashed terms (operator 13).

A text's terms (runs of letters, digits and characters beyond ASCII, A-Z lower-cased) are
hashed; a document is the set of its n terms with parameters. Its margin is ``bias + sum of w_i
+ sum over pairs of <v_i, v_j> / sqrt(n)``: besides an additive weight, every term has a vector
of ``dim`` numbers, and the product of two vectors is what the two terms mean together, such as
an insult and the mention of a group. All pairs cost one pass: half of ``|sum v|^2 - sum |v|^2``.

Training is stochastic gradient descent in numpy (AdaGrad steps, weights and vectors
shrunk towards zero so that terms without a say have none) on a bounded sample: of toxic and of other
labelled documents the ``per_class`` distinct texts that come first by a hash, each with the
``terms_per_row`` distinct terms that come first by theirs. Terms of fewer than ``min_docs`` drawn texts
have no parameters. A part of the sample is held back; a logistic curve through its
margins, weighted to the classes' shares of all labelled rows, gives the scores.

Scoring is row-local, over every term of the whole text. Broadcast: the terms with a
parameter, at most the sample's, ``dim + 1`` numbers each.

Defined cases: a null, empty or termless text has the score of the bias alone; a null
doc_id counts as held out; a document with several labels is toxic if one says so, null
labels say nothing; copies of a text are drawn once; without labels of both classes every
score is 0; repeated rows are scored each; an empty table gives no rows; a column of the
result's name is replaced; long texts go through in slices.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm import common as c
from pairlens.llm.language import held_out
from pairlens.llm.lexical import term_counts


@dataclass(frozen=True)
class Training:
    per_class: int = 4000
    terms_per_row: int = 8192
    hash_bits: int = 28
    min_docs: int = 5
    dim: int = 8
    epochs: int = 12
    batch: int = 32
    rate: float = 0.1
    #: the pull towards zero, against the error of one document
    shrink: float = 0.08
    shrink_vectors: float = 0.01
    start: float = 0.1
    seed: int = 13


def term_ids(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed terms of a whole text, ascending."""
    own = term_counts(text or "")
    return np.unique(np.fromiter(map(zlib.crc32, own), np.uint32, len(own)) & np.uint32((1 << bits) - 1))


class Model:
    """``ids`` (ascending) with a weight and a vector each; ``slope`` and ``shift`` turn margins into scores."""

    def __init__(self, bits: int, ids: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.bits, self.ids, self.bias, self.weights, self.vectors, self.slope, self.shift = bits, ids, bias, weights, vectors, slope, shift

    def margin(self, own: np.ndarray) -> float:
        if not len(self.ids):
            return self.bias
        at = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)
        at = at[self.ids[at] == own]
        v = self.vectors[at]
        return float(self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v ** 2).sum()) / np.sqrt(max(len(at), 1)))

    def pair(self, a: str, b: str) -> float:
        """What two terms add together, beyond their own weights."""
        both = [int(np.searchsorted(self.ids, term_ids(x, self.bits)[0])) for x in (a, b)]
        return float(self.vectors[both[0]] @ self.vectors[both[1]])

    def score(self, text: str | None) -> float:
        if not self.slope:
            return 0.0
        return float(_logistic(self.slope * self.margin(term_ids(text, self.bits)) + self.shift))


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; empty runs give zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def train(rows: list[tuple[int, np.ndarray]], share: float, t: Training = Training()) -> Model:
    """Fit on (label, term ids) rows; ``share`` is the toxic share of all labelled rows. The same rows in the
    same order give the same model."""
    if len({y for y, _ in rows}) < 2:
        return Model(t.hash_bits, np.zeros(0, np.uint32), 0.0, np.zeros(0), np.zeros((0, t.dim)), 0.0, -np.inf)
    rng = np.random.default_rng(t.seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held, fit = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    ids, docs = np.unique(np.concatenate([x for _, x in fit]), return_counts=True)
    ids = ids[docs >= t.min_docs]
    known = [np.searchsorted(ids, x[np.isin(x, ids, assume_unique=True)]) for _, x in fit]
    y = np.array([k for k, _ in fit], float)
    bias, weights, vectors = 0.0, np.zeros(len(ids)), rng.normal(0, t.start, (len(ids), t.dim))
    seen_bias, seen, seen_v = 1.0, np.ones(len(ids)), np.ones((len(ids), t.dim))
    for _ in range(t.epochs):
        order = rng.permutation(len(known))
        for s in range(0, len(order), t.batch):
            own = order[s:s + t.batch]
            sizes = np.array([len(known[i]) for i in own])
            flat = np.concatenate([known[i] for i in own])
            v, scale = vectors[flat], 1 / np.sqrt(np.maximum(sizes, 1))
            sum_v = _sums(v, sizes)
            pairs = 0.5 * ((sum_v ** 2).sum(axis=1) - _sums((v ** 2).sum(axis=1), sizes))
            error = _logistic(bias + _sums(weights[flat], sizes) + scale * pairs) - y[own]
            seen_bias += error.sum() ** 2
            bias -= t.rate * error.sum() / np.sqrt(seen_bias)
            if not len(flat):
                continue
            each = np.repeat(error, sizes)
            to_v = np.repeat(error * scale, sizes)[:, None] * (np.repeat(sum_v, sizes, axis=0) - v)
            by = np.argsort(flat, kind="stable")
            touched, first, times = np.unique(flat[by], return_index=True, return_counts=True)
            _step(weights, seen, touched, np.add.reduceat(each[by], first), t.rate, t.shrink * times)
            _step(vectors, seen_v, touched, np.add.reduceat(to_v[by], first, axis=0), t.rate, t.shrink_vectors * times[:, None])
    says = (weights != 0) | (vectors != 0).any(axis=1)
    # a term without a say still counts in n
    model = Model(t.hash_bits, ids, bias, weights.astype(np.float32), vectors.astype(np.float32)) if says.any() else \
        Model(t.hash_bits, ids[:0], bias, weights[:0], vectors[:0])
    calibrate(model, held, share)
    return model


def _step(values: np.ndarray, seen: np.ndarray, at: np.ndarray, gradient: np.ndarray, rate: float, shrink: np.ndarray) -> None:
    """One AdaGrad step of the touched entries, then shrunk towards zero and no further."""
    seen[at] += gradient ** 2
    step = rate / np.sqrt(seen[at])
    moved = values[at] - step * gradient
    values[at] = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)


def calibrate(model: Model, held: list[tuple[int, np.ndarray]], share: float, rounds: int = 50) -> None:
    """Slope and shift of a logistic curve through held-back margins, by Newton's method; the classes weigh
    what they do among all labelled rows."""
    y = np.array([k for k, _ in held], float)
    if not 0 < y.sum() < len(y):
        return
    z = np.array([model.margin(x) for _, x in held])
    scale = max(1.0, np.abs(z).max() / 10)
    x = np.stack([z / scale, np.ones(len(z))], axis=1)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    at = np.zeros(2)

    def loss(b: np.ndarray) -> float:
        m = x @ b
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + 1e-6 * (b ** 2).sum())

    for _ in range(rounds):
        p = _logistic(x @ at)
        slope = x.T @ (weight * (p - y)) + 2e-6 * at
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2), slope)
        rate = 1.0
        while rate > 1e-4 and loss(at - rate * step) > loss(at):
            rate /= 2
        at = at - rate * step
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(at[0] / scale), float(at[1])


def _first_terms(bits: int, most: int):
    """Distinct hashed terms of a text; of more than ``most``, those that come first by a second hash."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            own = term_ids(x.as_py(), bits)
            if len(own) > most:
                own = np.sort(own[np.argsort(own * np.uint32(0x9E3779B1), kind="stable")[:most]])
            out.append(own.astype(np.int64))
        return pa.array(out, pa.list_(pa.int64()))
    return run


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
           t: Training = Training()) -> tuple[list[tuple[int, np.ndarray]], float]:
    """(label, term ids) of the drawn texts, and the toxic share of all labelled rows that may be learned from.
    Labels meet hashes of texts; only the drawn texts are read for their terms."""
    said = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(
        F.max((F.col(label).cast("int") != 0).cast("int")).alias("y"))
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).filter(~held_out(F.col("i")))
    key = F.xxhash64(F.coalesce("t", F.lit("")), F.lit(t.seed))
    marked = c.stored(rows.select("i", key.alias("h")).join(said, "i").groupBy("y", "h").agg(F.min("i").alias("i"), F.count("*").alias("n")), "marked")
    totals = {r.y: r for r in marked.groupBy("y").agg(F.sum("n").alias("rows"), F.count("*").alias("texts")).collect()}
    if len(totals) < 2:
        return [], 0.0
    span = 1 << 52
    place = F.pmod("h", F.lit(span))
    # a range of hashes that holds per_class texts for sure or nearly so; its first ones are the draw
    most = {y: min(1.0, 1.3 * (t.per_class + 100) / r.texts) for y, r in totals.items()}
    drawn = marked.filter(place < F.when(F.col("y") == 1, F.lit(int(most[1] * span))).otherwise(F.lit(int(most[0] * span)))).select("i", "y", "h").collect()
    first = [r for y in (0, 1) for r in sorted((r for r in drawn if r.y == y), key=lambda r: (r.h % span, r.h))[:t.per_class]]
    chosen = docs.sparkSession.createDataFrame([(r.i, r.y, r.h) for r in first], T.StructType([marked.schema[n] for n in ("i", "y", "h")]))
    ids = _first_terms(t.hash_bits, t.terms_per_row)
    read = rows.withColumn("h", key).join(F.broadcast(chosen), ["i", "h"]).select("y", "h", ids("t").alias("x")).dropDuplicates(["y", "h"])
    fit = sorted(read.collect(), key=lambda r: (r.y, r.h))
    return [(r.y, np.array(r.x, np.uint32)) for r in fit], totals[1].rows / (totals[0].rows + totals[1].rows)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``name``: the score of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([sent.value.score(x.as_py()) for x in texts], pa.float64())

    return docs.withColumn(name, run(F.col(text)))


def detect(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", t: Training = Training(),
           name: str = "toxicity") -> DataFrame:
    """Train on the labelled rows of ``docs`` that aren't held out, and score every row."""
    rows, share = sample(docs, labels, doc_id, text, label, t)
    return score(docs, train(rows, share, t), text, name)
