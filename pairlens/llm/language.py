"""Language identification with averaged hashed subword embeddings (operator 3).

A text's letters are lower-cased, everything else is a blank; its byte 3-grams and
4-grams (blanks mark word ends) are hashed to ``buckets`` embeddings, averaged over
the whole text, and a linear softmax gives the language. Embeddings and weights are
trained by stochastic gradient descent in numpy on a bounded, documented sample: of
every language the ``per_class`` distinct labelled rows (id and text) that come first
by a hash, or all it has; with many languages so much fewer of each that all of them
together are at most ``max_rows``, one of each at least. A part of the sample is held back to fit
the temperature of the scores and the rejection threshold: the lowest score above
which at most ``max_error`` of the held-back passages are wrong.

What is broadcast is buckets x ``dim`` numbers at most, and ``dim`` for each language:
with fewer languages than ``dim`` embeddings times weights, one table of buckets x
languages, else the two factors. Prediction is row-local, over whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null
doc_id counts as held out; without any labelled row every text is ``und``; repeated
rows are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm import common as c

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Training:
    per_class: int = 800
    max_rows: int = 40_000
    passage_chars: int = 1500
    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 3
    batch: int = 32
    rate: float = 0.5
    embedding_rate: float = 3.0
    #: training passages are also cut into pieces of this many bytes, so short texts are learned too
    piece_bytes: int = 160
    max_error: float = 0.01
    seed: int = 11


#: bytes of ASCII that aren't letters become blanks; letters and bytes beyond ASCII stay
_LETTERS = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))


def grams(text: str, buckets: int) -> np.ndarray:
    """Hashed 3- and 4-grams of the bytes of a text."""
    raw = np.frombuffer(b"  " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b"  ", np.uint8).astype(np.uint32)
    three = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    four = three[:-1] | raw[3:] << np.uint32(24)
    both = np.concatenate([three * np.uint32(0x9E3779B1), (four ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)])
    return (both >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int32)


class Model:
    """Languages, embeddings and weights (or their product where it is the smaller one), bias, temperature
    and rejection threshold."""

    def __init__(self, langs: list[str], embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        small = len(langs) <= embeddings.shape[1]
        self.langs, self.bias, self.temperature, self.threshold = langs, bias, 1.0, 0.0
        self.table, self.weights = (embeddings @ weights, None) if small else (embeddings, weights)

    def logits(self, text: str) -> np.ndarray:
        h = grams(text, len(self.table))
        if len(h) > 4 * len(self.table):
            total = np.bincount(h, minlength=len(self.table)) @ self.table
        else:
            total = self.table[h].sum(axis=0, dtype=np.float64)
        if self.weights is not None:
            total = total @ self.weights
        return total / len(h) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, whether the score is too low to trust."""
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.threshold)


def train(rows: list[tuple[str, str]], t: Training = Training()) -> Model:
    """Fit on (language, passage) rows; the same rows in the same order give the same model."""
    langs = sorted({x for x, _ in rows})
    if not langs:
        return Model([], np.zeros((t.buckets, 0)), np.zeros((0, 0)), np.zeros(0))
    number = {x: k for k, x in enumerate(langs)}
    rng = np.random.default_rng(t.seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held, fit = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    samples: list[tuple[int, np.ndarray]] = []
    for lang, text in fit:
        if not LETTER.search(text):
            continue
        samples.append((number[lang], grams(text, t.buckets)))
        raw = text.encode("utf-8", "surrogatepass")
        for at in rng.integers(0, max(1, len(raw) - t.piece_bytes), 2):
            samples.append((number[lang], grams(raw[at:at + t.piece_bytes].decode("utf-8", "ignore"), t.buckets)))
    emb = rng.uniform(-1, 1, (t.buckets, t.dim)) / t.dim
    weights = np.zeros((t.dim, len(langs)))
    bias = np.zeros(len(langs))
    steps = max(1, t.epochs * -(-len(samples) // t.batch))
    step = 0
    for _ in range(t.epochs):
        order = rng.permutation(len(samples))
        for s in range(0, len(order), t.batch):
            rate = t.rate * (1 - step / steps)
            step += 1
            own = [samples[i] for i in order[s:s + t.batch]]
            sizes = np.array([len(g) for _, g in own])
            flat = np.concatenate([g for _, g in own])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            x = np.add.reduceat(emb[flat], at, axis=0) / sizes[:, None]
            z = x @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), [y for y, _ in own]] -= 1
            to_x = p @ weights.T
            weights -= rate * x.T @ p
            bias -= rate * p.sum(axis=0) / len(own)
            # the gradient of a mean, times a larger rate: an embedding is touched far less often than a weight
            touched, where = np.unique(flat, return_inverse=True)
            grad = np.repeat(to_x * (t.embedding_rate / sizes)[:, None], sizes, axis=0)
            order_ = np.argsort(where, kind="stable")
            first = np.searchsorted(where[order_], np.arange(len(touched)))
            emb[touched] -= rate * np.add.reduceat(grad[order_], first, axis=0)
    model = Model(langs, emb, weights, bias)
    calibrate(model, [(number[x], text) for x, text in held if LETTER.search(text)], t.max_error)
    model.table = model.table.astype(np.float32)
    return model


def calibrate(model: Model, held: list[tuple[int, str]], max_error: float) -> None:
    """Temperature by the likelihood of held-back passages; then the rejection threshold."""
    if not held:
        return
    z = np.array([model.logits(x) for _, x in held])
    y = np.array([k for k, _ in held])

    def scores(temperature: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda v: -np.log(np.maximum(scores(v)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = min((0.05 * 1.25 ** k for k in range(24)), key=loss)
    p = scores(model.temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(wrong <= max_error)
    model.threshold = float(best[order][fine[-1]]) if len(fine) else 1.0


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, t: Training) -> list[tuple[str, str]]:
    """The training passages: for each language the first ``per_class`` rows by rank of a hash of id and
    text, copies once, each a passage of ``passage_chars`` at a place drawn by that hash."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")) \
        .filter(~held_out(F.col("i")) & F.col("l").isNotNull() & F.col("t").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("i", "t", F.lit(t.seed)))
    # an estimate of the distinct rows gives a hash range that surely has enough; its first rows are the draw
    found = c.stored(rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")), "languages")
    per_class = max(1, min(t.per_class, t.max_rows // max(1, found.count())))
    shares = found.select("l", F.least(F.lit(1.0), (1.3 * per_class + 20) / F.col("n")).alias("share"))
    place = F.xxhash64("i", "t")
    at = F.pmod(place, F.greatest(F.lit(1), F.length("t") - t.passage_chars)) + 1
    span = 1 << 52
    drawn = (rows.withColumn("u", F.pmod(F.col("h"), F.lit(span))).join(F.broadcast(shares), "l").filter(F.col("u") < F.col("share") * span)
             .groupBy("l", "u", "h").agg(F.min(F.substring("t", at.cast("int"), F.lit(t.passage_chars))).alias("p")))
    drawn = (drawn.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("u", "h")))
             .filter(F.col("n") <= per_class).drop("n"))
    first: dict[str, list[tuple[int, int, str]]] = {}
    for r in drawn.collect():
        first.setdefault(r.l, []).append((r.u, r.h, r.p))
    return sorted((lang, p) for lang, own in first.items() for _, _, p in sorted(own))


OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predict(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with the struct column ``name`` (in place of a column of that name): lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(OUT)
    def run(texts: pa.Array) -> pa.Array:
        out = [sent.value.predict(x.as_py()) for x in texts]
        a, b, r = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(r, pa.bool_())], OUT.names)

    return docs.withColumn(name, run(F.col(text)))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", t: Training = Training(),
             name: str = "language") -> DataFrame:
    """Train on the labelled rows of ``docs`` that aren't held out, and predict every row."""
    return predict(docs, train(sample(docs, doc_id, text, lang, t), t), text, name)
