"""Conversation repair (11) against a plain dynamic programme over whole strings."""

import hashlib
import random
import re
import zlib

import pytest

from pairlens.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NOTHING = hashlib.sha256(b"").hexdigest()


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def place(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute_repair(rows):
    """Cheapest (cost, audit) over all edits, by trying every one at every turn and state."""
    rows = sorted(rows, key=place)
    seen, kinds = set(), []
    for _, _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", [])}

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                for to in "ua":
                    if to in follow[state]:
                        new = (cost + 5, audit + "I", turns + [({"u": "user", "a": "assistant"}[to], "")])
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    def less(a, b):
        return b is None or a[:2] < b[:2]

    for (_, _, role, text), kind in zip(rows, kinds):
        nxt = {}
        for state, (cost, audit, turns) in insert(best).items():
            options = [(state, 2, "D", [])]
            if kind not in ("blank", "duplicate"):
                extra = 5 if kind else 0
                if role[:1] and role[:1] in follow[state]:
                    options.append((role[:1], extra, "K", [(role, text)]))
                for new in ("user", "assistant"):
                    if new[0] in follow[state]:
                        options.append((new[0], 1 + extra, "R", [(new, text)]))
            for to, c, letter, own in options:
                new = (cost + c, audit + letter, turns + own)
                if less(new, nxt.get(to)):
                    nxt[to] = new
        best = nxt
    cost, audit, turns = min((v for k, v in insert(best).items() if k in ("", "a")), key=lambda v: v[:2])
    known = [r[1] for r in rows if r[1] is not None]
    starts = [r[2][:1] for r in rows]
    return {"gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, "cost": cost, "audit": audit,
            **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])),
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()}


def brute(rows):
    out = {conv: [] for conv, *_ in rows}
    for r in brute_damage(rows):
        out[r[0]].append(r)
    return {conv: brute_repair(own) for conv, own in out.items()}


def rows_of(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", None, " \t", "a.b", "Ünd ß.", "é\x1f.  ", "x" * 4000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            t = rng.choice([turn, turn, turn, turn + 20, None, 3])
            rows.append((conv, t, role, rng.choice(texts) if rng.random() < 0.5 else f"turn {turn} of {conv}{rng.choice('.!?,')}"))
    rows += [(100, None, None, None), (101, -5, "user", "One."), (101, 2**62, "assistant", "Two.")]
    return rows + rows[::9]


def check(got, want):
    got = {r.conv_id: r.asDict() for r in got}
    assert set(got) == set(want)
    for conv, w in want.items():
        assert {k: got[conv][k] for k in w} == w, conv


def test_against_brute_force(spark, save):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(queries.op11_conversation_repair(spark, save(conversations=df)).collect(), brute(rows))


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_conversation_over_many_partitions(spark, save, many_partitions):
    """One conversation holds most rows, with equal turns in it; borders cut it everywhere."""
    rng = random.Random(4)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "cut", "", f"Turn {i}."])) for i in range(700)]
    rows += [(8, 1, "user", "All the same.")] * 300 + rows_of(2)
    df = spark.createDataFrame(rows, SCHEMA)
    light = conversations.light_rows(df, "conv_id", "turn", "role", "text")
    assert len(conversations.carried(light)) > 10
    check(queries.op11_conversation_repair(spark, save(conversations=df)).collect(), brute(rows))


def test_turns_and_other_names(spark):
    rows = [("a", 0, "system", "Be kind.", 1), ("a", 1, "assistant", "Hi.", 2), ("a", 2, "assistant", "Hello.", 3), ("b", 5, "user", "Bye.", 4)]
    df = spark.createDataFrame(rows, "thread string, n int, who string, said string, tie int")
    report, turns = conversations.repair(df, "thread", "n", "who", "said")
    assert {(r.thread, r.audit, r.cost) for r in report.collect()} == {("a", "KRK", 1), ("b", "D", 2)}
    assert [(r.who, r.said, r.edit) for r in turns.orderBy("thread", "item").collect()] == [
        ("system", "Be kind.", "K"), ("user", "Hi.", "R"), ("assistant", "Hello.", "K")]


def test_empty_and_dropped(spark, save):
    empty = spark.createDataFrame([], SCHEMA)
    assert queries.op11_conversation_repair(spark, save(conversations=empty)).count() == 0
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    got = queries.op11_conversation_repair(spark, save(conversations=df)).first()
    assert (got.gaps, got.blank, got.cost, got.audit, got.repaired_sha256) == (0, 0, 0, "", NOTHING)


def test_walk_does_not_depend_on_checkpoints():
    rng = random.Random(9)
    for n in (1, 2, 3, 10, 97, 400):
        kinds, copies = bytearray(rng.choice([0, 1, 2, 3, 5, 6, 8]) for _ in range(n)), [rng.choice([0, 0, 0, 2]) for _ in range(n)]
        costs = [conversations.END]
        for k, m in zip(reversed(kinds), reversed(copies)):
            costs.append(conversations.before(costs[-1], k, m))
        gap, marks = conversations.checkpoints(kinds, copies, conversations.END)
        assert marks == [*costs[::-1][:n:gap], conversations.END] and len(marks) <= n // gap + 2
        state, paid = 0, 0
        for i, letter, to in conversations.walk(kinds, copies, conversations.END, 0):
            paid += 5 if letter == "I" else next(m[1] for m in conversations.MOVES[kinds[i]][state] if m[0] == letter) + 2 * copies[i]
            state = to
        assert paid == costs[-1][0] and state in (0, 3)
