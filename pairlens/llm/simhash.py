"""SimHash near-duplicates through pivot distance tables (operator 10).

Fingerprint: A-Z lower-cased, words by ASCII blanks, 3-word shingles with
repeats, XXH64 (seed 42) of each; a bit is 1 if it is set in over half of the
hashes. Fingerprints at ``MAX_BITS`` = 2 or fewer differing bits are linked;
documents take the smallest doc_id reachable as their component.

Pairs are found on distinct fingerprints only (copies collapse in a partial
aggregate first, so a hot group of copies is one row):

1. Bucket: a link touches at most 2 of 4 fixed 16-bit blocks, so two linked
   fingerprints agree on at least one of the 6 pairs of blocks. The block pairs
   are the equi-join keys that keep the pivot tables from being compared
   all against all.
2. Pivot table: each fingerprint's Hamming distances to ``N_PIVOTS`` reference
   fingerprints. By the triangle inequality a pair whose largest coordinate
   difference exceeds 2 cannot be linked and is discarded.
3. Verify: survivors by their exact Hamming distance.

Only links of a spanning forest of each bucket leave a task (never more than
its members). A bucket of more than ``BUCKET_LIMIT`` fingerprints is not
gathered; its members take an exact linear way instead: each emits itself and
its 64 one-bit neighbours, and fingerprints that share such a point are linked
to the smallest one there. Two fingerprints share a point exactly if they differ
in 2 bits or fewer, so nothing is lost or added.

Defined cases: a null, empty or wordless text has the fingerprint zero, linked
like any other; repeated rows share a component; a null doc_id gets its
fingerprint and, as its component, the smallest non-null id of its group; an empty table
gives no rows; further columns, whatever they are called, are kept by ``keep_first``. The shingles
of a long text are hashed in slices, all of them.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm import common as c
from pairlens.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
N_PIVOTS = 16
BUCKET_LIMIT = 2048
#: shingles of a text that are hashed at a time
SLICE = 65536
BLOCKS = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) < shingle:
        grams = iter([join(words)])
    else:
        grams = map(join, zip(*(islice(words, i, None) for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        raw = b"".join([digest(g, SEED) for g in islice(grams, SLICE)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: XXH64 of the pivot's number."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], np.uint64)


def linked_pairs(fps: np.ndarray, near: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within ``MAX_BITS``: coordinate filter, then the exact distance."""
    found_i, found_j = [], []
    for s in range(0, len(fps), block):
        e = min(s + block, len(fps))
        alive = np.ones((e - s, len(fps) - s), bool)
        for k in range(near.shape[1]):
            alive &= np.abs(near[s:e, k, None] - near[None, s:, k]) <= MAX_BITS
        i, j = np.nonzero(alive)
        later = j > i
        i, j = i[later] + s, j[later] + s
        true = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS
        found_i.append(i[true])
        found_j.append(j[true])
    return np.concatenate(found_i), np.concatenate(found_j)


def spanning_links(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the verified pairs."""
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
            out.append((a, b))
    return out


def _bucket_links(batches):
    refs = pivots()
    for batch in batches:
        us, vs = [], []
        for members in batch.column(0):
            fps = np.array(members.values, np.int64).view(np.uint64)
            near = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
            signed = fps.view(np.int64)
            for a, b in spanning_links(fps, *linked_pairs(fps, near)):
                us.append(int(signed[a]))
                vs.append(int(signed[b]))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``fps(fp)``, distinct -> ``u, v``: links whose components are those of all pairs within ``MAX_BITS``."""
    width = 64 // BLOCKS
    keys = [(a, b) for a in range(BLOCKS) for b in range(a + 1, BLOCKS)]
    mask = lambda a, b: sum(((1 << width) - 1) << (width * x) for x in (a, b))
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    tagged = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(mask(a, b))).cast("bigint")).alias("key"))
        for t, (a, b) in enumerate(keys)])).alias("k")).select("fp", "k.*")
    sizes = tagged.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = c.stored(tagged.join(sizes, ["t", "key"]), "buckets")
    small = (shared.filter(F.col("n") <= bucket_limit).groupBy("t", "key")
             .agg(F.collect_list("fp").alias("members")).select("members")
             .mapInArrow(_bucket_links, "u bigint, v bigint"))
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)),
                        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    points = shared.filter(F.col("n") > bucket_limit).select("fp").distinct().select(
        "fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("v"))
    large = points.join(least, "point").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return small.union(large)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: ``doc_id, fp, root, component_id``."""
    keys = docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp"))
    return classes_of(c.stored(keys, "fingerprints"), bucket_limit)


def hex_of(fp: str):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each near-duplicate group (its smallest doc_id), columns unchanged; of
    rows that repeat that doc_id and fingerprint one stays. Documents without a doc_id stay
    only if their whole group has none, one for each fingerprint group."""
    fp, row = c.own_name(docs, "fp"), c.own_name(docs, "row")
    tagged = c.stored(docs.withColumn(fp, fingerprints(F.col(text))).withColumn(row, F.monotonically_increasing_id()), "tagged")
    keys = tagged.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    comp = classes_of(keys)
    first = (comp.filter("doc_id <=> component_id").groupBy("root").agg(F.min("row").alias("row")))
    kept = first.select(F.col("row").alias(row))
    return tagged.join(kept, row, "left_semi").drop(fp, row)


def classes_of(keys: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``keys(doc_id, fp, ...)`` with ``root`` (a fingerprint of the group) and ``component_id``."""
    nodes = c.stored(keys.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    member = components(c.stored(links(nodes.select("fp"), bucket_limit), "links"))
    grouped = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return keys.join(grouped.join(least, "root").select("fp", "root", "component_id"), "fp")
