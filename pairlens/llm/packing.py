"""Best-fit packing by a grouping genetic algorithm on islands (operator 5).

Documents are encoded (ids and an end id), cut only if they are longer than a
sequence (the first piece takes the remainder, so at most one piece of a document
is shorter than a sequence), and the pieces are packed into as few sequences as
possible. A piece that fills a sequence is one by itself; the rest are items.

Items are dealt by a hash of their row number into blocks of about
``BLOCK_ITEMS``; every block is a packing problem of its own, solved on
``ISLANDS`` islands (one task each). An island evolves a small population:
crossover injects whole well-filled bins of one parent into the other, removes
the bins that hold duplicates, and places the displaced items by best fit,
largest first; then the child's open bins are regrouped with a few full ones, each refilled
as far as any subset of their items can, so that what is left over gathers in one bin and
empties it. After each epoch an island's best solution migrates to the next
island of its ring. The best solution of a block wins; its badly filled bins are
dissolved, and their items form the (far fewer) blocks of the next level, until one
block is left. Where nearly all bins are badly filled (lengths that don't add up to a
sequence), only the emptiest bins of each block go on, into half as many blocks at most,
so a block's part-filled rest always meets those of the others. Nothing is gathered beyond a block, whatever the input's size.

Defined cases: a null or empty text is one end id; repeated rows and repeated or
null doc_ids are packed row by row; an empty table gives no rows. Only doc_id and text are
read, whatever further columns are called; a long text is encoded whole, then cut.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm import common as c
from pairlens.llm import tokens

SEQUENCE = 2048
#: tasks of one epoch at most
TASKS = 10_000


@dataclass(frozen=True)
class Search:
    block_items: int = 4096
    islands: int = 2
    epochs: int = 2
    population: int = 4
    children: int = 6
    #: children in a row without fewer bins, after which an island's epoch ends
    patience: int = 2
    #: regroupings of a child, each of so many open and other bins
    regroupings: int = 3000
    open_bins: int = 3
    other_bins: int = 6
    #: bins at least this full, compared with the parent's fullest, are worth inheriting; compared with a
    #: sequence, final at the end of a level
    well_filled: float = 0.995
    seed: int = 17


# ------------------------------------------------------------------ pieces

def _piece_rows(path: str, length: int):
    def run(batches):
        enc = tokens.encoder(path)
        end = (tokens.END_ID).to_bytes(4, "little")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in c.text_batches(batch.column(1), 2_000_000):
                rows: list[tuple] = []
                for k, raw in enumerate(enc.encode(texts), first):
                    raw += end
                    n = len(raw) // 4
                    at, cut = 0, n % length or length
                    piece = 0
                    while at < n:
                        rows.append((ids[k], piece, at, cut, zlib.crc32(raw[4 * at:4 * (at + cut)])))
                        at, cut, piece = at + cut, length, piece + 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), *(pa.array(x, pa.int64()) for x in cols[2:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = SEQUENCE,
           path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_piece_rows(path or tokens.tokenizer_path(), length),
                           f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ------------------------------------------------------------------ one island

class Packing:
    """A solution: bins of item numbers and how full they are."""

    __slots__ = ("bins", "fill", "score")

    def __init__(self, bins: list[list[int]], fill: list[int], capacity: int):
        self.bins, self.fill = bins, fill
        # fewer bins first, then the more uneven (fuller bins beside emptier ones)
        self.score = (-len(bins), sum(f * f for f in fill) / (capacity * capacity))


def best_fit(items: list[int], lens: list[int], bins: list[list[int]], fill: list[int], capacity: int) -> None:
    """Put ``items`` in the given order each into the fullest bin that takes it, or a new one."""
    room: dict[int, list[int]] = {}
    open_ = 0  # bit r is set if some bin has r left
    for b, f in enumerate(fill):
        if f < capacity:
            room.setdefault(capacity - f, []).append(b)
            open_ |= 1 << (capacity - f)
    for i in items:
        n = lens[i]
        above = open_ >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            own = room[r]
            b = own.pop()
            if not own:
                open_ ^= 1 << r
            bins[b].append(i)
            fill[b] += n
            left = r - n
        else:
            b = len(bins)
            bins.append([i])
            fill.append(n)
            left = capacity - n
        if left:
            own = room.setdefault(left, [])
            own.append(b)
            open_ |= 1 << left


def packed(order: list[int], lens: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = []
    fill: list[int] = []
    best_fit(order, lens, bins, fill, capacity)
    return Packing(bins, fill, capacity)


def crossover(a: Packing, b: Packing, lens: list[int], capacity: int, well: float, rng: random.Random) -> Packing:
    """Whole well-filled bins of ``a`` go into ``b`` (well-filled: against the parent's fullest bin); bins of ``b`` that share an item with them
    are removed, and their other items find a place by best fit, largest first."""
    worth = well * max(a.fill, default=0)
    full = [k for k, f in enumerate(a.fill) if f >= worth and rng.random() < 0.5]
    taken = bytearray(len(lens))
    bins, fill = [], []
    for k in full:
        bins.append(a.bins[k][:])
        fill.append(a.fill[k])
        for i in a.bins[k]:
            taken[i] = 1
    displaced: list[int] = []
    weak = well * max(b.fill, default=0)
    for k, own in enumerate(b.bins):
        if any(taken[i] for i in own) or b.fill[k] < weak and rng.random() < 0.5:
            displaced += [i for i in own if not taken[i]]
        else:
            bins.append(own[:])
            fill.append(b.fill[k])
    displaced.sort(key=lambda i: -lens[i])
    best_fit(displaced, lens, bins, fill, capacity)
    return Packing(bins, fill, capacity)


def subset(sizes: list[int], capacity: int) -> list[int]:
    """Places (descending) of a subset with the largest sum up to ``capacity``; bit n of ``reach`` is set if some
    subset of the sizes so far has the sum n."""
    reach, mask, steps = 1, (1 << capacity + 1) - 1, []
    for n in sizes:
        steps.append(reach)
        reach |= (reach << n) & mask
        if reach >> capacity:
            break
    left, taken = reach.bit_length() - 1, []
    for k in range(len(steps) - 1, -1, -1):
        if not steps[k] >> left & 1:
            taken.append(k)
            left -= sizes[k]
    return taken


def regroup(p: Packing, lens: list[int], capacity: int, least: int, s: Search, rng: random.Random) -> Packing:
    """Refill a few bins at a time, fullest first, each with the best subset of the items of all of them; the
    rest goes to the emptiest. A regrouping is kept if no item is left over and the fills get no more even."""
    bins, fill = [b[:] for b in p.bins], p.fill[:]
    n, open_ = len(bins), [k for k, f in enumerate(fill) if f < capacity]
    place = {k: x for x, k in enumerate(open_)}
    for t in range(s.regroupings):
        if n <= least or len(open_) <= s.open_bins:
            break
        if t % 64 == 0:
            low = min(open_, key=fill.__getitem__)
        own = rng.sample(open_, s.open_bins) + [rng.randrange(len(bins)) for _ in range(s.other_bins)]
        if t % 2:  # what is left goes to the emptiest bin of all, or of these
            own.append(low)
        own = sorted({k for k in own if bins[k]}, key=lambda k: (-fill[k], k))
        items = sorted((i for k in own for i in bins[k]), key=lens.__getitem__, reverse=True)
        even = sum(fill[k] ** 2 for k in own)
        new, sums = [], []
        for _ in own[:-1]:
            taken = [items.pop(k) for k in subset([lens[i] for i in items], capacity)]
            new.append(taken)
            sums.append(sum(lens[i] for i in taken))
        left = sum(lens[i] for i in items)
        if left > capacity or sum(f * f for f in sums) + left * left < even:
            continue
        for k, b, f in zip(own, [*new, items], [*sums, left]):
            bins[k], fill[k] = b, f
            if f < capacity and b:
                if k not in place:
                    place[k] = len(open_)
                    open_.append(k)
            elif k in place:
                last = open_.pop()
                if last != k:
                    open_[place[k]] = last
                    place[last] = place[k]
                del place[k]
            n -= not b
    kept = [k for k, b in enumerate(bins) if b]
    return Packing([bins[k] for k in kept], [fill[k] for k in kept], capacity)


def from_assignment(assigned: list[int], lens: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(assigned, default=-1) + 1)]
    fill = [0] * len(bins)
    for i, b in enumerate(assigned):
        bins[b].append(i)
        fill[b] += lens[i]
    return Packing(bins, fill, capacity)


def to_assignment(p: Packing) -> list[int]:
    out = [0] * sum(map(len, p.bins))
    for b, own in enumerate(p.bins):
        for i in own:
            out[i] = b
    return out


def evolve(lens: list[int], seeds: list[list[int]], capacity: int, s: Search, rng: random.Random) -> Packing:
    """One epoch of one island. ``seeds``: solutions it starts from (its own and a migrant's)."""
    least = -(-sum(lens) // capacity)
    people = [from_assignment(x, lens, capacity) for x in seeds]
    if not people:
        people.append(packed(sorted(range(len(lens)), key=lambda i: -lens[i]), lens, capacity))
    if -max(p.score for p in people)[0] > least:
        people.append(regroup(max(people, key=lambda p: p.score), lens, capacity, least, s, rng))
    while len(people) < s.population and -max(p.score for p in people)[0] > least:
        key = [-n * (0.85 + 0.3 * rng.random()) for n in lens]
        people.append(packed(sorted(range(len(lens)), key=key.__getitem__), lens, capacity))
    best, stale = None, 0
    for _ in range(s.children):
        people.sort(key=lambda p: p.score, reverse=True)
        stale = stale + 1 if best and people[0].score[0] <= best else 0
        best = people[0].score[0]
        if -best <= least or len(people) < 2 or stale >= s.patience:
            break
        a, b = rng.sample(range(len(people)), 2)
        child = crossover(people[min(a, b)], people[max(a, b)], lens, capacity, s.well_filled, rng)
        child = regroup(child, lens, capacity, least, s, rng)
        if child.score > people[-1].score:
            people[-1] = child
    return max(people, key=lambda p: p.score)


# ------------------------------------------------------------------ islands and levels

def _epoch_rows(level: int, epoch: int, capacity: int, s: Search):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                rng = random.Random(f"{s.seed} {level} {epoch} {r['block']} {r['island']}")
                best = evolve(r["lens"], [x for x in (r["own"], r["migrant"]) if x], capacity, s, rng)
                out.append({"block": r["block"], "island": r["island"], "uids": r["uids"], "lens": r["lens"],
                            "own": to_assignment(best), "bins": len(best.bins), "score": best.score[1]})
            yield pa.RecordBatch.from_pylist(out, _STATE)
    return run


_STATE = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())),
                    ("own", pa.list_(pa.int32())), ("bins", pa.int32()), ("score", pa.float64())])
_STATE_DDL = "block bigint, island int, uids array<bigint>, lens array<int>, own array<int>, bins int, score double"


def _placed_rows(level: int, capacity: int):
    """Offsets inside the bins of a block's best solution."""
    def run(batches):
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for r in batch.to_pylist():
                fill: dict[int, int] = {}
                for uid, n, b in zip(r["uids"], r["lens"], r["own"]):
                    cols[0].append(uid)
                    cols[1].append(n)
                    cols[2].append(level << 56 | r["block"] << 20 | b)
                    cols[3].append(fill.get(b, 0))
                    fill[b] = fill.get(b, 0) + n
                cols[4].extend(fill[b] for b in r["own"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(x, pa.int64()) for x in cols[2:])],
                ["uid", "length", "sequence_id", "offset", "fill"])
    return run


def _solve_level(items: DataFrame, n_blocks: int, level: int, capacity: int, s: Search) -> DataFrame:
    """``items(uid, length)`` -> ``uid, length, sequence_id, offset, fill`` after all epochs."""
    block = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n_blocks))
    blocks = (items.groupBy(block.alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x"))
              .select("block", F.col("x.uid").alias("uids"), F.col("x.length").alias("lens")))
    nothing = F.lit(None).cast("array<int>")
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(s.islands - 1))).alias("island"), "uids", "lens",
                          nothing.alias("own"), nothing.alias("migrant"))
    for epoch in range(s.epochs):
        if epoch:
            # the best of an island migrates to the next one of the block's ring
            ring = state.select("block", F.pmod(F.col("island") + 1, F.lit(s.islands)).alias("island"), F.col("own").alias("migrant"))
            state = state.select("block", "island", "uids", "lens", "own").join(ring, ["block", "island"])
        # rows are few and heavy: as many tasks as islands, whatever their bytes
        state = state.select("block", "island", "uids", "lens", "own", "migrant").repartition(min(n_blocks * s.islands, TASKS), "block", "island")
        state = c.stored(state.mapInArrow(_epoch_rows(level, epoch, capacity, s), _STATE_DDL), "islands")
    best = state.groupBy("block").agg(F.min_by("island", F.struct("bins", -F.col("score"), "island")).alias("island"))
    won = state.join(best, ["block", "island"], "left_semi").select("block", "uids", "lens", "own")
    return won.mapInArrow(_placed_rows(level, capacity), "uid bigint, length int, sequence_id bigint, offset bigint, fill bigint")


def _emptiest(solved: DataFrame) -> DataFrame:
    """``sequence_id`` of the emptiest sixteenth of each block's bins, one at least."""
    bins = solved.groupBy("sequence_id").agg(F.first("fill").alias("fill")).withColumn("block", F.shiftright("sequence_id", 20))
    of_block = Window.partitionBy("block")
    return (bins.withColumn("k", F.row_number().over(of_block.orderBy("fill", "sequence_id"))).withColumn("n", F.count("*").over(of_block))
            .filter("k <= greatest(1, n div 16)").select("sequence_id"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = SEQUENCE, path: str | None = None,
         search: Search = Search()) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = c.stored(pieces(docs, doc_id, text, length, path).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    items = cut.filter(F.col("length") < length).select("uid", F.col("length").cast("int").alias("length"))
    n = items.count()
    final: list[DataFrame] = []
    level, most = 0, n
    while n:
        n_blocks = min(most, -(-n // search.block_items))
        solved = c.stored(_solve_level(items, n_blocks, level, length, search), "packed")
        full = F.col("fill") >= search.well_filled * length
        left = solved.filter(~full)
        m = left.count() if n_blocks > 1 else 0
        if n_blocks == 1:
            final.append(solved)
            break
        if m > 0.9 * n:
            # another level can't help them all, but the blocks' rests
            picked = c.stored(_emptiest(solved), "emptiest")
            left = c.stored(solved.join(picked, "sequence_id", "left_semi"), "rests")
            m, most = left.count(), n_blocks // 2
            final.append(solved.join(picked, "sequence_id", "left_anti").select(solved.columns))
        else:
            final.append(solved.filter(full))
        items, n, level = left.select("uid", "length"), m, level + 1
    own = cut.filter(F.col("length") == length).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("bigint")).drop("uid")
    if not final:
        return own
    placed = final[0]
    for part in final[1:]:
        placed = placed.union(part)
    return cut.filter(F.col("length") < length).join(placed.select("uid", "sequence_id", "offset"), "uid").drop("uid").unionByName(own)
