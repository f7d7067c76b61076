"""Benchmark decontamination with one Aho-Corasick automaton (operator 4).

Benchmark items are normalised to words (A-Z lower-cased; words are runs of
digits, letters a-z and everything beyond ASCII); a pattern is a window of 13
consecutive item words, or the whole item if it has fewer. Every document is
normalised the same way; where the 64-bit hash of any of its windows is that of a pattern, the
automaton scans it once; hits are counted in words and can be mapped back to code point
offsets of the original text.

The automaton is built on each worker from the benchmark's patterns and takes about
``AUTOMATON_PER_BYTE`` times the items' text. So those are broadcast only in shards of
at most ``shard_bytes`` of item text, which keeps an automaton within
``AUTOMATON_BYTES``; sizes are measured before anything is collected, and a long item
is cut into pieces that share its windows (one window at least stays whole). The hashes
take 8 bytes for a word of the benchmark. So a benchmark of several shards reads all documents
once for each ``HASH_BLOCK`` of its windows (some 25 MB of text), and only the documents with a hash
of a pattern are scanned, once by the automaton of each shard; every pass is written, and the
passes' hits are merged per document.

Defined cases: null texts and null items have no words; an item without words
is no pattern; repeated items count once by item_id; the words of an item without an id
are hit like any other, only its id is missing among the items found;
a document without words is clean. The scan is row-local, over whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm import common as c
from pairlens.llm.substrings import Words

WINDOW = 13
#: of memory in each Python worker
AUTOMATON_BYTES = 320 << 20
#: automaton bytes for a byte of item text: 13 windows over each word, about 45 bytes a node
AUTOMATON_PER_BYTE = 600
#: hashes of patterns that are broadcast at a time (32 MB)
HASH_BLOCK = 4_000_000
#: texts are hashed in slices of so many characters (one text at least)
SLICE_CHARS = 250_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = bytes(range(65, 91))
#: byte table: A-Z lower-cased, ASCII other than digits and letters to a blank, bytes beyond ASCII unchanged
_NORMAL = bytes(b + 32 if b in _UPPER else b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split(b" ") if text else []


def normal_text(text: str | None) -> tuple[int, str]:
    """Number of words, and the words between single blanks with a blank at both ends."""
    words = [w for w in normal_words(text) if w]
    return len(words), b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass") if words else ""


def item_patterns(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict[str, set[str]]:
    """pattern text -> ids of the items that have it (none for an item without an id)."""
    found: dict[str, set[str]] = {}
    for item_id, text in items:
        words = [w.decode("utf-8", "surrogatepass") for w in normal_words(text) if w]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            ids = found.setdefault(" " + " ".join(words[i:i + window]) + " ", set())
            if item_id is not None:
                ids.add(item_id)
    return found


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> ahocorasick.Automaton | None:
    patterns = item_patterns(items, window)
    if not patterns:
        return None
    a = ahocorasick.Automaton()
    for p, ids in patterns.items():
        a.add_word(p, (len(p), p.count(" ") - 1, tuple(sorted(ids))))
    a.make_automaton()
    return a


def scan(a: ahocorasick.Automaton | None, normal: str) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges [first, end) inside any occurrence, merged and in order, and the items found."""
    if a is None or not normal:
        return [], set()
    found = list(a.iter(normal))
    if not found:
        return [], set()
    # a blank at position p precedes word number (blanks before p)
    blanks = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
    lasts = np.searchsorted(blanks, [e for e, _ in found])  # the blank after the last word
    items: set[str] = set()
    ranges = []
    for last, (_, (_, n, ids)) in zip(lasts.tolist(), found):
        ranges.append((last - n, last))
        items.update(ids)
    ranges.sort()
    merged: list[tuple[int, int]] = []
    for s, e in ranges:
        if merged and s <= merged[-1][1]:
            if e > merged[-1][1]:
                merged[-1] = (merged[-1][0], e)
        else:
            merged.append((s, e))
    return merged, items


def lower_ascii(text: str) -> str:
    """A-Z lower-cased and nothing else, so offsets stay."""
    return text.translate({b: b + 32 for b in _UPPER})


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets [start, end) of word ranges in the lower-cased text, hence in the original."""
    at = [m.span() for m in WORD.finditer(text)] if ranges else []
    return [(at[s][0], at[e - 1][1]) for s, e in ranges]


_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def _automaton(key: str, items: list[tuple[str, str | None]], window: int):
    """One automaton per worker at a time: the patterns come with the broadcast."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build(items, window)
    return _BUILT[key]


def _item_pieces(window: int, piece_bytes: int):
    """Items' words in pieces of at most ``piece_bytes`` (one window at least) that together have all windows."""
    def run(batches):
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for w in normal_words(text) if w]
                ends = np.cumsum([0, *(len(w) + 1 for w in words)])
                at = 0
                while words:
                    end = min(len(words), max(at + window, int(np.searchsorted(ends, ends[at] + piece_bytes, "right")) - 1))
                    yield pa.RecordBatch.from_arrays([pa.array([item_id], pa.string()), pa.array([b" ".join(words[at:end]).decode("utf-8")])], ["i", "t"])
                    if end == len(words):
                        break
                    at = end - window + 1
    return run


def item_shards(benchmark: DataFrame, item_id: str, text: str, shard_bytes: int,
                window: int = WINDOW) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in shards of at most ``shard_bytes`` of text (one window at least);
    the number of shards follows from the measured sizes."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")) \
        .filter("t is not null")
    size = F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + F.lit(16)
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= shard_bytes:
        yield [(r.i, r.t) for r in items.collect()]
        return
    pieces = c.stored(items.mapInArrow(_item_pieces(window, max(1, shard_bytes // 4)), "i string, t string").distinct(), "items")
    n = -(-2 * int(total) // shard_bytes)
    while True:
        shard = F.pmod(F.xxhash64("i", "t"), F.lit(n))
        sizes = pieces.groupBy(shard.alias("k")).agg(F.sum(size).alias("size"), F.count("*").alias("m"))
        if sizes.filter((F.col("size") > shard_bytes) & (F.col("m") > 1)).isEmpty():
            break
        n *= 2
    for r in sizes.orderBy("k").collect():
        yield [(x.i, x.t) for x in pieces.filter(shard == r.k).collect()]


FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("ranges", T.ArrayType(T.IntegerType())),
                       T.StructField("items", T.ArrayType(T.StringType())),
                       T.StructField("spans", T.ArrayType(T.IntegerType()))])
_KINDS = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.int32()))])


# ------------------------------------------------------------------ hashes of windows

def _normal_batch(texts: list[str]) -> Words:
    return Words([t.encode("utf-8", "surrogatepass").translate(_NORMAL) for t in texts])


def pattern_hashes(texts: list[str], window: int) -> dict[int, np.ndarray]:
    """Number of words -> sorted distinct hashes of the patterns of item texts."""
    w = _normal_batch(texts)
    counts = np.diff(w.first)
    out = {}
    for n in np.unique(np.minimum(counts[counts > 0], window)).tolist():
        own = np.flatnonzero(counts >= window if n == window else counts == n)
        sizes = counts[own] - n + 1
        at = np.repeat(w.first[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out[n] = np.unique(w.window_hashes(at, n))
    return out


def with_patterns(texts: list[str], hashes: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, whether one of its windows has the hash of a pattern)."""
    w = _normal_batch(texts)
    counts = np.diff(w.first)
    may = np.zeros(len(counts), bool)
    text = np.repeat(np.arange(len(counts)), counts)
    left = w.first[1:][text] - np.arange(len(text))
    for n, known in hashes.items():
        at = np.flatnonzero(left >= n)
        if len(at) and len(known):
            h = w.window_hashes(at, n)
            may[text[at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]]] = True
    return counts, may


def _hash_rows(window: int):
    def run(batches):
        for batch in batches:
            for _, texts in c.text_batches(batch.column(0), 1_000_000):
                for n, h in pattern_hashes(texts, window).items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64))], ["n", "h"])
    return run


def hash_blocks(items: DataFrame, window: int, most: int = HASH_BLOCK) -> Iterator[dict[int, np.ndarray]]:
    """The pattern hashes of all items, at most about ``most`` at a time."""
    found = c.stored(items.select("t").mapInArrow(_hash_rows(window), "n int, h bigint").distinct(), "pattern-hashes")
    blocks = max(1, -(-found.count() // most))
    for k in range(blocks):
        rows = found.filter(F.pmod("h", F.lit(blocks)) == k).toArrow()
        n, h = rows["n"].to_numpy(), rows["h"].to_numpy().view(np.uint64)
        yield {int(x): np.sort(h[n == x]) for x in np.unique(n)}


# ------------------------------------------------------------------ scans

def _scanner(key: str, sent, window: int, spans: bool):
    """The column function that scans texts for the patterns of one broadcast shard. ``sent``: items
    and the hashes of their patterns."""
    @F.arrow_udf(FIELDS)
    def run(texts: pa.Array) -> pa.Array:
        items, hashes = sent.value
        rows = []
        for _, own in c.text_batches(texts, SLICE_CHARS):
            for t, n, may in zip(own, *(x.tolist() for x in with_patterns(own, hashes))):
                ranges, found = scan(_automaton(key, items, window), normal_text(t)[1]) if may else ([], ())
                at = original_spans(lower_ascii(t), ranges) if spans and ranges else []
                rows.append({"n_words": n, "ranges": [v for r in ranges for v in r], "items": sorted(found),
                             "spans": [v for r in at for v in r]})
        return pa.array(rows, _KINDS)

    return run


def _finder(sent):
    """The column function that counts words and finds the hashes of one block."""
    @F.arrow_udf("n_words bigint, may boolean")
    def find(texts: pa.Array) -> pa.Array:
        parts = [with_patterns(own, sent.value) for _, own in c.text_batches(texts, SLICE_CHARS)]
        n, may = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, bool))
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(may)], ["n_words", "may"])

    return find


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, shard_bytes: int = AUTOMATON_BYTES // AUTOMATON_PER_BYTE, name: str = "hits",
         spans: bool = False) -> DataFrame:
    """``docs`` with one struct column ``name``: n_words, ranges (merged word ranges that are hit,
    flat), items (sorted item ids) and, with ``spans``, the code point spans of the ranges. A
    column of that name is replaced."""
    spark = docs.sparkSession

    def hits(items: list[tuple[str, str]]):
        key = hashlib.sha256(repr((window, sorted(items, key=repr))).encode()).hexdigest()
        sent = spark.sparkContext.broadcast((items, pattern_hashes([t for _, t in items], window)))
        return _scanner(key, sent, window, spans)(F.col(text))

    shards = item_shards(benchmark, item_id, item_text, shard_bytes, window)
    head = list(islice(shards, 2))
    if len(head) < 2:
        return docs.withColumn(name, hits(head[0] if head else []))
    uid, part = c.own_name(docs, "uid"), c.own_name(docs, "part")
    rows = c.stored(docs.withColumn(uid, F.monotonically_increasing_id()), "documents")
    counted, flagged = None, None
    for hashes in hash_blocks(benchmark.select(F.col(item_text).alias("t")).filter("t is not null"), window):
        one = c.stored(rows.select(uid, _finder(spark.sparkContext.broadcast(hashes))(F.col(text)).alias("f")).select(uid, "f.*"), "found")
        counted = counted or one.select(uid, "n_words")
        own = one.filter("may").select(uid)
        flagged = own if flagged is None else flagged.union(own)
    some = c.stored(rows.select(uid, text).join(flagged.distinct(), uid, "left_semi"), "candidates")
    found = [c.stored(some.select(uid, hits(items).alias("h")).select(uid, "h.*"), "hits").filter(F.size("ranges") > 0) for items in chain(head, shards)]
    merged = reduce(DataFrame.union, found).groupBy(uid).agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("ranges", "items", "spans")))
    merged = merged.select(uid, _union(F.col("ranges")).alias("ranges"), F.array_sort(F.array_distinct("items")).alias("items"),
                           _union(F.col("spans")).alias("spans"))
    none = lambda x: F.coalesce(x, F.array().cast(FIELDS[x].dataType)).alias(x)
    whole = counted.join(merged, uid, "left").select(uid, F.struct("n_words", *(none(x) for x in ("ranges", "items", "spans"))).alias(part))
    return rows.join(whole, uid).withColumn(name, F.col(part)).drop(uid, part)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _union(flat: pa.Array) -> pa.Array:
    """Merge flat [start, end, ...] lists that come from several shards."""
    out = []
    for x in flat:
        v = x.as_py() or []
        merged: list[int] = []
        for s, e in sorted(zip(v[::2], v[1::2])):
            if merged and s <= merged[-1]:
                merged[-1] = max(merged[-1], e)
            else:
                merged += [s, e]
        out.append(merged)
    return pa.array(out, pa.list_(pa.int32()))


def n_hit(hits: str):
    """Words inside any occurrence, from the merged ranges of ``mark``."""
    r = F.col(hits)["ranges"]
    return F.aggregate(F.transform(r, lambda v, i: F.when(i % 2 == 1, v).otherwise(-v)), F.lit(0).cast("bigint"),
                       lambda a, v: a + v)


def contaminated(hits: str):
    n = n_hit(hits)
    return (n > 0) & (n * 20 >= F.col(hits)["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    name = c.own_name(docs, "hits")
    return mark(docs, benchmark, text, name=name, **options).filter(~contaminated(name)).drop(name)
