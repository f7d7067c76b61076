"""Ranked lexical search over a length-stratified index (operator 12).

Terms are runs of letters, digits and characters beyond ASCII; A-Z are lower-cased. With
N documents that hold a term, L terms in all and n in one document, a document's
normaliser is ``m = 75 + (25 n N) div L``; a term of weight w that occurs tf times adds
``w * ((10^9 tf) div (1000 tf + 12 m))``: with m and tf given, the score is.

Index (``build``). Documents are dealt to shards of bounded text as they are read; no text is
shuffled. Inside a shard they are grouped by equal m (a stratum is a run of numbers),
and the postings of every term are ordered by stratum and by tf within it. A shard is
one row of documents and one row per term, so it is written and lost like any other rows.

Search (``search``). Queries are answered in blocks of bounded text; a block's terms and weights are
broadcast, and its postings meet by shard. There each (stratum, tf) has its impact computed
once, the largest impact of a term in a stratum bounds what the stratum can give, and
each query visits the strata by falling bound until no bound reaches its last hit.
A shard sends at most ``top`` hits per query on, whatever a term's frequency.

Defined cases: a null, empty or termless text has no terms and is not counted; a query
without a known term has no hits; each row of the queries is a query of its own, also if
an id repeats; equal scores go by ascending document id, nulls last, and copies each
take a rank; empty tables give no rows; long texts go through in slices cut between
terms; columns beside id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairlens.llm import common as c

#: bytes of terms stay (A-Z in lower case), all others become blanks
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_IN_TERM = np.frombuffer(_TERM_BYTES, np.uint8) != 32
SLICE = 1 << 20
SHARD_BYTES = 10 << 20
SHARD_DOCS = 1 << 16
BLOCK_CHARS = 4_000_000


def term_counts(text: str) -> Counter:
    """How often each term (UTF-8) occurs in a whole text."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    out: Counter = Counter()
    at = 0
    while at < len(raw):
        cut = raw.find(b" ", at + SLICE)
        cut = len(raw) if cut < 0 else cut
        out.update(raw[at:cut].split())
        at = cut
    return out


@F.arrow_udf(T.LongType())
def term_totals(texts: pa.Array) -> pa.Array:
    """Number of terms of each text, counted over the bytes of the whole column: a term starts
    at a byte of a term behind another byte or at the start of its text."""
    raw = texts.cast(pa.large_binary())
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    total = np.zeros(len(raw), np.int64)
    for a in range(int(ends[0]), int(ends[-1]), SLICE):
        b = min(a + SLICE, int(ends[-1]))
        inside = _IN_TERM[data[a:b]]
        behind = np.empty_like(inside)
        behind[1:] = inside[:-1]
        behind[0] = _IN_TERM[data[a - 1]] if a else False
        behind[ends[(ends >= a) & (ends < b)] - a] = False
        starts = np.concatenate([[0], np.cumsum(inside & ~behind)])
        at = starts[np.clip(ends, a, b) - a]
        total += at[1:] - at[:-1]
    return pa.array(total)


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass(frozen=True)
class Index:
    """``rows``: per shard a row of documents (``term`` is null) and one row per term."""
    rows: DataFrame
    n_docs: int
    n_terms: int


class _Shard:
    def __init__(self):
        self.ids, self.norms, self.sizes, self.bytes = [], [], [], 0
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []

    def add(self, doc_id, counts: Counter, m: int, n_bytes: int) -> None:
        number = self.vocabulary.setdefault
        self.ids.append(doc_id)
        self.norms.append(m)
        self.sizes.append(len(counts))
        self.bytes += n_bytes
        self.terms.append(np.array([number(t, len(self.vocabulary)) for t in counts], np.int32))
        self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))

    def rows(self, shard: int, schema: pa.Schema):
        ids = pa.array(self.ids, schema.field("ids").type.value_type)
        norms = np.array(self.norms, np.int64)
        order = np.lexsort((_id_ranks(ids), norms))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        m, first = np.unique(norms[order], return_index=True)
        yield _batch(schema, shard=pa.array([shard], pa.int64()), ids=_lists([ids.take(pa.array(order))]),
                     norms=_lists([pa.array(m)]), starts=_lists([pa.array(first.astype(np.int32))]))
        docs = np.repeat(place, self.sizes)
        terms, tfs = np.concatenate(self.terms), np.concatenate(self.tfs)
        by = np.lexsort((docs, tfs, np.searchsorted(first, docs, "right"), terms))
        self.terms, self.tfs, df = [], [], np.bincount(terms, minlength=len(self.vocabulary))
        ends = np.concatenate([[0], np.cumsum(df)]).astype(np.int32)
        docs, tfs = docs[by], tfs[by]
        names = [t.decode("utf-8", "surrogatepass") for t in self.vocabulary]
        for s in range(0, len(names), 8192):
            e = min(len(names), s + 8192)
            cut = slice(ends[s], ends[e])
            at = pa.array(ends[s:e + 1] - ends[s])
            yield _batch(schema, shard=pa.array(np.full(e - s, shard)), term=pa.array(names[s:e]), df=pa.array(df[s:e].astype(np.int64)),
                         docs=pa.ListArray.from_arrays(at, pa.array(docs[cut])), tfs=pa.ListArray.from_arrays(at, pa.array(tfs[cut])))


def _id_ranks(ids: pa.Array) -> np.ndarray:
    """Place of each id among all, nulls last."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()


def _lists(arrays: list[pa.Array]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(arrays[0])], pa.int32()), arrays[0])


def _batch(schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of every term of every document, in the shared folder."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    total = rows.select(term_totals("text").alias("n")).filter("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()),
        T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType())),
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("norms", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.IntegerType()))])
    arrow, n_docs, n_terms = to_arrow_schema(schema), total.docs, total.terms

    def run(batches):
        own, number = _Shard(), 0
        for batch in batches:
            for first, texts in c.text_batches(batch.column(2)):
                for k, t in enumerate(texts):
                    counts = term_counts(t)
                    if not counts:
                        continue
                    own.add(batch.column(1)[first + k].as_py(), counts, 75 + 25 * counts.total() * n_docs // n_terms, len(t))
                    if own.bytes >= shard_bytes or len(own.ids) >= shard_docs:
                        yield from own.rows(batch.column(0)[0].as_py() << 32 | number, arrow)
                        own, number = _Shard(), number + 1
        if own.ids:
            yield from own.rows(batch.column(0)[0].as_py() << 32 | number, arrow)

    parts = rows.select(F.spark_partition_id().cast("bigint").alias("part"), "id", "text")
    return Index(c.stored(parts.mapInArrow(run, schema), "lexical-index"), n_docs, n_terms)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class _Postings:
    """The asked terms of one shard: groups of postings by term and stratum, with impacts."""

    def __init__(self, ids: pa.Array, norms: np.ndarray, starts: np.ndarray, terms: np.ndarray, sizes: np.ndarray, docs: np.ndarray, tfs: np.ndarray):
        self.ids, self.ranks, self.starts, self.docs = ids, _id_ranks(ids), starts, docs
        self.n_strata = len(norms)
        stratum = np.searchsorted(starts, docs, "right") - 1
        term = np.repeat(np.arange(len(terms)), sizes)
        # postings are ordered by (term, stratum, tf): one impact for each run of equal ones
        new_group = np.ones(len(docs), bool)
        new_group[1:] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])
        new_tf = new_group.copy()
        new_tf[1:] |= tfs[1:] != tfs[:-1]
        run = np.flatnonzero(new_tf)
        self.impacts = np.repeat(impact(tfs[run], norms[stratum[run]]), np.diff(np.append(run, len(docs))))
        self.group = np.flatnonzero(new_group)
        self.group_size = np.diff(np.append(self.group, len(docs)))
        self.group_stratum = stratum[self.group]
        self.group_best = self.impacts[self.group + self.group_size - 1]
        first = np.searchsorted(self.group, np.cumsum(sizes) - sizes)
        self.of_term = {int(t): (a, b) for t, a, b in zip(terms, first, np.append(first[1:], len(self.group)))}

    def best(self, query: list[tuple[int, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents) of a query's best documents; strata are visited by falling bound."""
        known = [(self.of_term[t], w) for t, w in query if w > 0 and t in self.of_term]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.array([b - a for (a, b), _ in known])
        groups = _ranges(np.array([a for (a, _), _ in known]), sizes)
        weights = np.repeat(np.array([w for _, w in known], np.int64), sizes)
        strata = self.group_stratum[groups]
        bounds = np.zeros(self.n_strata, np.int64)
        np.add.at(bounds, strata, weights * self.group_best[groups])
        by = np.argsort(strata, kind="stable")
        groups, weights = groups[by], weights[by]
        cuts = np.searchsorted(strata[by], np.arange(self.n_strata + 1))
        scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = 0
        for s in np.argsort(-bounds, kind="stable"):
            if bounds[s] < max(last, 1):
                break
            own = slice(cuts[s], cuts[s + 1])
            n = self.group_size[groups[own]]
            at = _ranges(self.group[groups[own]], n)
            first = self.starts[s]
            found = self.docs[at] - first
            sums = np.zeros(found.max() + 1, np.int64)
            np.add.at(sums, found, np.repeat(weights[own], n) * self.impacts[at])
            fine = np.flatnonzero(sums >= max(last, 1))
            scores, docs = np.concatenate([scores, sums[fine]]), np.concatenate([docs, fine + first])
            if len(docs) > top:
                keep = np.lexsort((self.ranks[docs], -scores))[:top]
                scores, docs = scores[keep], docs[keep]
            if len(docs) == top:
                last = int(scores.min())
        return scores, docs


def _answers(batches, queries: list[list[tuple[int, int]]], top: int, schema: pa.Schema):
    """Hits of every query in every shard; rows come by shard, its documents first."""
    shard, head, parts = None, None, []

    def hits():
        if head is None or not parts:
            return
        ids, norms, starts = head
        p = _Postings(ids, norms, starts, *(np.concatenate(x) for x in zip(*parts)))
        for number, query in enumerate(queries):
            scores, docs = p.best(query, top)
            if len(docs):
                yield _batch(schema, query=pa.array(np.full(len(docs), number, np.int32)), doc_id=ids.take(pa.array(docs)), score=pa.array(scores))

    for batch in batches:
        col = {name: batch.column(name) for name in batch.schema.names}
        shards, numbers = col["shard"].to_numpy(), col["number"].to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if shards[a] != shard:
                yield from hits()
                shard, head, parts = shards[a], None, []
            if numbers[a] is None:
                head = (col["ids"][a].values, col["norms"][a].values.to_numpy(), col["starts"][a].values.to_numpy())
                a += 1
            if a < b:
                docs, tfs = col["docs"].slice(a, b - a), col["tfs"].slice(a, b - a)
                parts.append((np.array(numbers[a:b], np.int64), docs.value_lengths().to_numpy(), docs.flatten().to_numpy(), tfs.flatten().to_numpy()))
    yield from hits()


def search(index: Index, queries: DataFrame, item_id: str = "item_id", text: str = "text", top: int = 20,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each query's ``top`` best documents with a score above 0."""
    spark = queries.sparkSession
    items = c.stored(queries.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("id"), F.col(text).alias("text")), "queries")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    n_blocks = max(1, -(-chars // block_chars))
    out = None
    for block in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == block).orderBy("row").collect()
        hits = _block_hits(spark, index, [(r.id, r.text) for r in own], items.schema["id"].dataType, item_id, top)
        out = hits if out is None else out.unionByName(hits)
    return out


def _block_hits(spark: SparkSession, index: Index, items: list, item_type: T.DataType, item_id: str, top: int) -> DataFrame:
    """Hits of a block of queries; its terms, weights and ids are small enough for every task."""
    counts = [term_counts(text or "") for _, text in items]
    number = {t: k for k, t in enumerate(sorted({t for own in counts for t in own}))}
    asked = F.broadcast(spark.createDataFrame([(t.decode("utf-8", "surrogatepass"), k) for t, k in number.items()], "term string, number long"))
    found = index.rows.join(asked, "term").groupBy("number").agg(F.sum("df").alias("df")).collect()
    weight = {r.number: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1))) for r in found}
    sent = spark.sparkContext.broadcast([[(number[t], tf * weight[number[t]]) for t, tf in own.items() if number[t] in weight] for own in counts])
    id_type = index.rows.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)
    head = index.rows.filter("term is null").select("shard", F.lit(None).cast("long").alias("number"), "docs", "tfs", "ids", "norms", "starts")
    rows = index.rows.join(asked, "term").select("shard", "number", "docs", "tfs", "ids", "norms", "starts")
    by_shard = head.unionByName(rows).repartition("shard").sortWithinPartitions("shard", F.col("number").asc_nulls_first())
    hits = by_shard.mapInArrow(lambda batches: _answers(batches, sent.value, top, arrow), schema)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)],
                                  T.StructType([T.StructField("query", T.IntegerType()), T.StructField(item_id, item_type)]))
    return (hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .join(F.broadcast(names), "query").select(item_id, "rank", "doc_id", "score"))
