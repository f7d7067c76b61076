"""Repair of the turn structure of conversations (operator 11).

A conversation is well formed if its role initials read ``(s?(ua)+)?`` and it has no
blank, repeated or truncated turn. The cheapest edits are found by a dynamic programme
over four states (nothing yet, after system, after user, after assistant): Keep 0,
Rerole to user or assistant 1, Delete 2, Insert an empty turn 5, and 5 more for a
truncated turn that stays; blank and repeated turns can only be deleted. Among the
cheapest edits the audit string (their initials in order) is the ASCII-least.

Square-root checkpoints: the backward pass over n turns keeps its vector of state costs
at every sqrt(n)-th turn only; the forward walk computes each block's vectors again
from the checkpoint behind it and takes the first tight edit in the order D, I, K, R.

Scale. Turns become light rows without texts (equal ones at one place are one row with
a count), range-sorted by conversation and turn, so a conversation of any length is
spread over as many partitions as it needs. A piece of a conversation that a partition
border cuts is a 4 x 4 min-plus matrix; the driver sees one or two of them per
partition, nothing else, and gives each piece the state costs behind it and the state
it starts in. First occurrences of a turn are joined back by place, not by content, so
a turn said by everyone is no hot key. Texts meet the edits last, for turns that stay.
Only ``digests`` goes through a conversation in one task: a SHA-256 has an order. It
streams, and holds one Arrow batch.

Defined cases: a null role or text reads as one blank; turns go by number, nulls first,
and equal numbers by the SHA-256 of role and text; equal turns at one place are repeats
of the first; a null conversation id is a conversation of its own; an empty table gives
no rows; further columns are ignored; long texts are only ever hashed, searched and
copied whole. The number of gaps is null if it exceeds a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairlens.session import materialize, stored

DELETE, INSERT, STAYS_TRUNCATED = 2, 5, 5
NEVER = 1 << 62
#: states: nothing yet, after system, after user, after assistant
N_STATES = 4
#: what an inserted turn leads to, and its role
AFTER_INSERT = (2, 2, 3, 2)
ROLE_INTO = {2: "user", 3: "assistant"}
#: where an initial may lead from each state
BY_INITIAL = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = frozenset(("su", "ua", "au"))
MUST_GO = 8
INITIALS = ("s", "u", "a")


def _moves(kind: int) -> list[list[tuple[str, int, int]]]:
    """Per state: (letter, cost, next state) of the edits of one turn, by letter. A kind is the
    number of its initial, plus 4 if it is truncated; ``MUST_GO`` can only be deleted."""
    out = []
    for state in range(N_STATES):
        moves = [("D", DELETE, state)]
        if kind != MUST_GO:
            extra = STAYS_TRUNCATED if kind & 4 else 0
            stays = BY_INITIAL[INITIALS[kind & 3]].get(state) if kind & 3 < len(INITIALS) else None
            if stays is not None:
                moves.append(("K", extra, stays))
            moves.append(("R", 1 + extra, AFTER_INSERT[state]))
        out.append(moves)
    return out


MOVES = [_moves(kind) for kind in range(MUST_GO + 1)]


def with_inserts(cost: list[int]) -> tuple[int, ...]:
    """Inserts in front: at most two in a row ever pay, from a state without cost to its next ones."""
    w2, w3 = min(cost[2], cost[3] + INSERT), min(cost[3], cost[2] + INSERT)
    return min(cost[0], w2 + INSERT), min(cost[1], w2 + INSERT), w2, w3


END = with_inserts([0, NEVER, NEVER, 0])


def before(after: tuple[int, ...], kind: int, copies: int) -> tuple[int, ...]:
    """State costs in front of a turn and its ``copies`` deleted repeats, from those behind them."""
    gone = DELETE * copies
    return with_inserts([min(min(cost + gone + after[to], NEVER) for _, cost, to in moves) for moves in MOVES[kind]])


def checkpoints(kinds: bytearray, copies: list[int], end: tuple[int, ...]) -> tuple[int, list[tuple[int, ...]]]:
    """Block length and the state costs at the start of every block and at the end."""
    n = len(kinds)
    gap = isqrt(n) + 1
    marks, cost = [end], end
    for i in range(n - 1, -1, -1):
        cost = before(cost, kinds[i], copies[i])
        if i % gap == 0:
            marks.append(cost)
    return gap, marks[::-1]


def walk(kinds: bytearray, copies: list[int], end: tuple[int, ...], state: int, final: bool = True) -> Iterator[tuple[int, str, int]]:
    """(turn, letter, state after it) of the ASCII-least tight edits; an insert has the turn it precedes.
    Behind the last turn of a piece that is not ``final`` nothing is inserted: the next piece does that."""
    gap, marks = checkpoints(kinds, copies, end)
    n = len(kinds)
    for b, start in enumerate(range(0, n, gap)):
        stop = min(n, start + gap)
        block = [marks[b + 1]]
        for i in range(stop - 1, start, -1):
            block.append(before(block[-1], kinds[i], copies[i]))
        block.append(marks[b])
        for i in range(start, stop):
            here, after, gone = block.pop(), block[-1], DELETE * copies[i]
            while True:
                left = here[state]
                moves = MOVES[kinds[i]][state]
                tight = [m for m in moves if m[1] + gone + after[m[2]] == left]
                if not (tight and tight[0][0] == "D") and INSERT + here[AFTER_INSERT[state]] == left:
                    state = AFTER_INSERT[state]
                    yield i, "I", state
                    continue
                letter, _, state = tight[0]
                yield i, letter, state
                break
    while final and end[state] and INSERT + end[AFTER_INSERT[state]] == end[state]:
        state = AFTER_INSERT[state]
        yield n, "I", state


def matrix(kinds: bytearray, copies: list[int]) -> list[int]:
    """Least cost from each state in front of a piece (rows) to each state behind it."""
    columns = []
    for to in range(N_STATES):
        cost = tuple(0 if s == to else NEVER for s in range(N_STATES))
        for i in range(len(kinds) - 1, -1, -1):
            cost = before(cost, kinds[i], copies[i])
        columns.append(cost)
    return [columns[to][s] for s in range(N_STATES) for to in range(N_STATES)]


class Piece:
    """Consecutive turns of one conversation inside one partition."""

    def __init__(self, conv):
        self.conv, self.kinds, self.copies = conv, bytearray(), []
        self.initials: list[str] = []
        self.turns: list[int | None] = []
        self.ties: list[bytes] = []
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, tie, n, initial, blank, truncated, first) -> None:
        kind = MUST_GO if blank or not first else (INITIALS.index(initial) if initial in INITIALS else 3) + 4 * truncated
        self.kinds.append(kind)
        self.copies.append(n - 1)
        self.initials.append(initial)
        self.turns.append(turn)
        self.ties.append(tie)
        if blank:
            self.blank += n
        else:
            self.duplicate += n - first
            self.truncated += first and truncated


def pieces(batches) -> Iterator[tuple[int, Piece, bool, bool]]:
    """(partition, piece, is it the first, is it the last) of the rows of one partition."""
    own, part, first = None, 0, True
    for batch in batches:
        rows = [batch.column(name).to_pylist() for name in batch.schema.names]
        for part, conv, turn, tie, n, initial, blank, truncated, is_first in zip(*rows):
            if own is None or conv != own.conv:
                if own is not None:
                    yield part, own, first, False
                    first = False
                own = Piece(conv)
            own.add(turn, tie, n, initial, blank, truncated, is_first)
    if own is not None:
        yield part, own, first, True


def light_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per distinct turn of a conversation and place, with its number of copies and its faults,
    range-sorted by conversation and place. The partitions are fixed by a checkpoint."""
    said = _rows(rows, conv, turn, role, text)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    light = said.select("conv", "turn", "tie", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"),
                        (~last.isin(".", "!", "?") & (last != "")).alias("truncated"))
    light = stored(light.groupBy("conv", "turn", "tie").agg(
        F.count("*").alias("n"), F.min("initial").alias("initial"), F.bool_or("blank").alias("blank"),
        F.bool_or("truncated").alias("truncated")), "turns")
    # a struct keeps a null turn, which comes first
    firsts = light.groupBy("conv", "tie").agg(F.min(F.struct("turn")).alias("at")).select(
        F.col("conv").alias("c"), F.col("at.turn").alias("t"), F.col("tie").alias("x"), F.lit(True).alias("first"))
    at = light["conv"].eqNullSafe(firsts["c"]) & light["turn"].eqNullSafe(firsts["t"]) & (light["tie"] == firsts["x"])
    marked = light.join(firsts, at, "left").select("conv", "turn", "tie", "n", "initial", "blank", "truncated",
                                                   F.coalesce("first", F.lit(False)).alias("first"))
    ordered = marked.repartitionByRange("conv", "turn", "tie").sortWithinPartitions("conv", "turn", "tie")
    return materialize(ordered.select(F.spark_partition_id().alias("part"), "*"))


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = rows.select(F.col(conv).alias("conv"), F.col(turn).try_cast("bigint").alias("turn"),
                       F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    return said.withColumn("tie", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


EDGE = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("only", T.BooleanType()),
    T.StructField("cost", T.ArrayType(T.LongType())), T.StructField("initial", T.StringType()), T.StructField("turn", T.LongType())])


EDGE_TO = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("to", T.ArrayType(T.LongType()))])
#: around a piece that no border cuts: costs behind it, state in front, initial and turn in front, whether it ends its conversation
WHOLE = (END, 0, None, None, True)


def _edges(batches, schema):
    """The first and the last piece of a partition."""
    for part, p, first, last in pieces(batches):
        if first or last:
            yield pa.RecordBatch.from_pylist([{"part": part, "last": last, "only": first and last, "conv": p.conv, "initial": p.initials[-1],
                                               "turn": p.turns[-1], "cost": matrix(p.kinds, p.copies)}], schema)


def _chains(edges: list) -> list[list]:
    """Runs of pieces of one conversation over consecutive non-empty partitions, of two pieces at least."""
    out, run = [], []
    for e in sorted(edges, key=lambda e: (e.part, e.last)):
        if run and run[-1].part != e.part and run[-1].last and run[-1].conv == e.conv:
            run.append(e)
        else:
            run = [e]
            out.append(run)
    return [r for r in out if len(r) > 1]


def _key(e) -> tuple[int, bool]:
    """A piece that is alone in its partition counts as its first."""
    return e.part, e.last and not e.only


def carried(light: DataFrame) -> dict:
    """For each cut piece: the state costs behind it, the state it starts in, and the initial and
    turn in front of it. At most two pieces per partition, whatever the number of rows."""
    spark = light.sparkSession
    edges = _mapped(light, _edges, T.StructType([*EDGE, light.schema["conv"]])).collect()
    chains = _chains(edges)
    if not chains:
        return {}
    ends: dict = {}
    for run in chains:
        end = END
        for e in reversed(run):
            ends[_key(e)] = end
            end = tuple(min(min(e.cost[s * N_STATES + to] + end[to], NEVER) for to in range(N_STATES)) for s in range(N_STATES))
    sent = spark.sparkContext.broadcast(ends)

    def through(batches, schema):
        for part, p, first, last in pieces(batches):
            end = sent.value.get((part, last and not first))
            if (first or last) and end is not None:
                costs = checkpoints(p.kinds, p.copies, end)[1][0]
                to = []
                for s in range(N_STATES):
                    state = s
                    if costs[s] < NEVER:
                        for _, _, state in walk(p.kinds, p.copies, end, s, final=False):
                            pass
                    to.append(state)
                yield pa.RecordBatch.from_pylist([{"part": part, "last": last and not first, "to": to}], schema)

    to = {(r.part, r["last"]): r.to for r in _mapped(light, through, EDGE_TO).collect()}
    out = {}
    for run in chains:
        state, initial, turn = 0, None, None
        for e in run:
            out[_key(e)] = (ends[_key(e)], state, initial, turn, e is run[-1])
            state, initial, turn = to[_key(e)][state], e.initial, e.turn
    return out


def _mapped(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """``fn(batches, arrow_schema)`` over each partition."""
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: fn(batches, arrow), schema)


def edits(light: DataFrame) -> DataFrame:
    """Per piece of a conversation a row with its counts and audit (``item`` is null), and per turn that is
    kept, given another role or inserted a row with its place ``item``."""
    around = light.sparkSession.sparkContext.broadcast(carried(light))
    schema = T.StructType([
        light.schema["conv"], T.StructField("part", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in (
            "blank", "duplicate", "truncated", "illegal", "places", "low", "high", "cost")), T.StructField("audit", T.StringType()),
        T.StructField("item", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("new_role", T.StringType()),
        T.StructField("turn", T.LongType()), T.StructField("tie", T.BinaryType())])

    def solve(batches, schema):
        out, item = [], 0
        for part, p, first, last in pieces(batches):
            end, state, initial, turn, final = around.value.get((part, last and not first), WHOLE) if first or last else WHOLE
            illegal = sum(p.copies) + sum(a + b not in LEGAL for a, b in zip(p.initials, p.initials[1:]))
            illegal += initial is not None and initial + p.initials[0] not in LEGAL
            audit, cost = [], 0
            for i, letter, state_after in walk(p.kinds, p.copies, end, state, final):
                audit.append(letter)
                if letter == "I":
                    cost += INSERT
                else:
                    cost += next(m[1] for m in MOVES[p.kinds[i]][state] if m[0] == letter) + DELETE * p.copies[i]
                    audit.append("D" * p.copies[i])
                if letter != "D":
                    kept = letter != "I"
                    out.append({"conv": p.conv, "item": part << 40 | item, "edit": letter, "new_role": None if letter == "K" else ROLE_INTO[state_after],
                                "turn": p.turns[i] if kept else None, "tie": p.ties[i] if kept else None})
                    item += 1
                state = state_after
            known = [t for t in p.turns if t is not None]
            places = sum(t != before_ for before_, t in zip([turn, *p.turns], p.turns) if t is not None)
            out.append({"conv": p.conv, "part": part, "blank": p.blank, "duplicate": p.duplicate, "truncated": p.truncated, "illegal": illegal,
                        "places": places, "low": min(known, default=None), "high": max(known, default=None), "cost": cost, "audit": "".join(audit)})
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return stored(_mapped(light, solve, schema), "edits")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, turns). Report: per conversation its faults, the cost of its edits and their audit.
    Turns: the repaired conversations' turns, ``item`` in order inside each, with the edit that made them."""
    done = edits(light_rows(rows, conv, turn, role, text))
    gaps = F.max("high").cast("decimal(38,0)") - F.min("low").cast("decimal(38,0)") + 1 - F.sum("places")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
    report = done.filter("item is null").groupBy(F.col("conv").alias(conv)).agg(
        F.coalesce(gaps, F.lit(0)).try_cast("bigint").alias("gaps"),
        *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal", "cost")), audit.alias("audit"))
    stays = done.filter("item is not null")
    # equal turns at one place are one text; only it goes on
    said = _rows(rows, conv, turn, role, text).groupBy("conv", "turn", "tie").agg(F.any_value("role").alias("role"), F.any_value("text").alias("text"))
    on = stays["conv"].eqNullSafe(said["conv"]) & stays["turn"].eqNullSafe(said["turn"]) & (stays["tie"] == said["tie"])
    turns = stays.join(said, on, "left").select(
        stays["conv"].alias(conv), stays["item"], stays["edit"], F.coalesce("new_role", said["role"]).alias(role),
        F.coalesce(said["text"], F.lit("")).alias(text))
    return report, turns


def digests(turns: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, streamed in order."""
    schema = T.StructType([turns.schema[conv], T.StructField("sha256", T.StringType())])
    lines = turns.select(F.col(conv).alias(conv), "item", F.concat_ws(":", role, text).alias("line"))

    def run(batches, schema):
        own, sha, out = None, None, []
        for batch in batches:
            for k, line in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary())):
                if sha is None or k != own:
                    if sha is not None:
                        out.append({conv: own, "sha256": sha.hexdigest()})
                    own, sha = k, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.as_buffer())
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if sha is not None:
            out.append({conv: own, "sha256": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema)

    return _mapped(lines.repartition(F.col(conv)).sortWithinPartitions(conv, "item"), run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn``, to rows whose null texts and roles are one blank."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    said = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                       F.pmod(F.crc32(name.cast("binary")), F.lit(20)).alias("harm"))
    harm = lambda k: F.col("harm") == k
    hurt = said.filter(~harm(0)).select(
        "conv_id", "turn", F.when(harm(4), "user").otherwise(F.col("role")).alias("role"),
        F.when(harm(1), "").when(harm(2), F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(harm(3), 2).otherwise(1))).alias("copy"))
    return hurt.drop("copy")


def contract_rows(rows: DataFrame) -> DataFrame:
    """The contract's digest: damage, repair, and every original conversation's report."""
    report, turns = repair(damaged(rows))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = rows.select("conv_id").distinct().select("conv_id", *(F.lit(0).cast("bigint").alias(k) for k in counts), F.lit("").alias("audit"),
                                                     F.lit(None).cast("string").alias("sha256"))
    both = report.select("conv_id", *counts, "audit", F.lit(None).cast("string").alias("sha256")).unionByName(empty).unionByName(
        digests(turns).select("conv_id", *(F.lit(None).cast("bigint").alias(k) for k in counts), F.lit(None).cast("string").alias("audit"), "sha256"))
    return both.groupBy("conv_id").agg(
        *(F.sum(k).alias(k) for k in counts), F.max("audit").alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
