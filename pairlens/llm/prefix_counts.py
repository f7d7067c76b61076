"""Exact token counts at every prefix, by dynamic programming (operator 8).

For a byte-level BPE vocabulary, the encoding of a prefix of one pre-token ends
in exactly one vocabulary token t such that the encoding of what precedes t ends
in a token that t may follow (the two stay apart when encoded alone). So the
number of tokens of each prefix, and its last token, follow from those of shorter
prefixes: one step per byte, never a new encoding. Pre-tokens come from the
library's own pre-tokenizer; a prefix differs from the whole text only in its
last pre-token, with two cases of their own: a run of white space that ends a
prefix is one pre-token, and a contraction is whole or an apostrophe and letters.

The counts of a text are stored as one signed byte per code point (how much the
count changes) and a total every ``STEP`` code points. Truncation and budget
questions are answered from that table. Special strings inside a text become
their special token, as the library does by default.

Defined cases: null and empty texts have no code points and 0 tokens; repeated
rows are counted each; the work is row-local, whole texts, one at a time, in time that grows
with the text, however many special strings it holds; further columns are kept, one of
the result's name is replaced.
"""

from __future__ import annotations

import array
import functools
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm import common as c
from pairlens.llm import tokens

STEP = 1024
#: what a worker keeps at most: prefixes with their last token, token pairs, runs with their changes
STATES, PAIRS, RUNS_KEPT = 250_000, 300_000, 350_000
#: White_Space: what the pre-tokenizer's pattern takes as white space
SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))))
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))


class PrefixCounter:
    """Counts at every prefix for one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = tokens.load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = tokens.byte_letters()
        raw = lambda s: bytes(letters[x] for x in s)
        self.vocab = {raw(s) for s in spec["model"]["vocab"] if all(x in letters for x in s)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.spines()
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[bytes, tuple[int, bytes]] = {b"": (0, b"")}
        self.runs = tokens.RunCache(self.run_deltas, limit=RUNS_KEPT)
        self.cache = tokens.PieceCache(lambda texts: [self.deltas(t) for t in texts], limit=100_000)

    def spines(self) -> None:
        """For each token the tokens at its right (left) end while it is being merged, each with
        the rank of the merge that uses it up; and how far back a token can begin by its last bytes."""
        made = {a + b: (a, b, i) for (a, b), i in self.rank.items()}
        never = 1 << 60
        self.right: dict[bytes, list[tuple[bytes, int]]] = {}
        self.left: dict[bytes, list[tuple[bytes, int]]] = {}
        for t in sorted(self.vocab, key=len):
            a, b, i = made.get(t, (b"", b"", 0))
            self.right[t] = [(t, never)] + [(x, min(r, i)) for x, r in self.right.get(b, ())]
            self.left[t] = [(t, never)] + [(x, min(r, i)) for x, r in self.left.get(a, ())]
        reach: dict[bytes, set[int]] = {}
        for t in self.vocab:
            reach.setdefault(t[-3:], set()).add(len(t))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in reach.items()}

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether the merges of a + b end in a and b: no merge across the boundary comes before
        both of its sides are used up (of equal ranks, the left one comes first)."""
        ok = self.apart.get((a, b))
        if ok is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            rank = self.rank
            ok = True
            for x, until_x in self.right[a]:
                for y, until_y in self.left[b]:
                    r = rank.get((x, y))
                    if r is not None and r < until_x and r <= until_y:
                        ok = False
            self.apart[a, b] = ok
        return ok

    def run_counts(self, raw: bytes) -> list[int]:
        """Token counts of the prefixes of one pre-token, by bytes, from length 1 on."""
        states = self.states
        if len(states) > STATES:
            self.states = states = {b"": (0, b"")}
        n = len(raw)
        if n > tokens.CACHED_CHARS:
            states, known = {}, 0
        else:
            known = n
            while raw[:known] not in states:
                known -= 1
        counts, lasts = [0] * (n + 1), [b""] * (n + 1)
        for i in range(1, known + 1):
            counts[i], lasts[i] = states[raw[:i]]
        vocab, sizes, apart, follow = self.vocab, self.sizes, self.apart, self.may_follow
        for i in range(known + 1, n + 1):
            for size in sizes.get(raw[i - 3:i], ()) if i > 2 else range(i, 0, -1):
                if size > i:
                    continue
                t = raw[i - size:i]
                if t not in vocab:
                    continue
                if size < i:
                    a = lasts[i - size]
                    ok = apart.get((a, t))
                    if ok is None:
                        ok = follow(a, t)
                    if not ok:
                        continue
                counts[i], lasts[i] = counts[i - size] + 1, t
                break
            else:
                counts[i], lasts[i] = self._short(raw, i, counts, lasts)
            if n <= tokens.CACHED_CHARS:
                states[raw[:i]] = counts[i], lasts[i]
        return counts[1:]

    def _short(self, raw: bytes, i: int, counts: list[int], lasts: list[bytes]) -> tuple[int, bytes]:
        """The last token is one of the shortest, which the three-byte endings don't list."""
        for size in (2, 1):
            t = raw[i - size:i]
            if size <= i and t in self.vocab and (size == i or self.may_follow(lasts[i - size], t)):
                return counts[i - size] + 1, t
        raise ValueError(f"no token ends {raw[:i]!r}")

    def run_deltas(self, run: str) -> bytes:
        """Changes of the count along one pre-token, by code points."""
        counts = self.run_counts(run.encode())
        if not run.isascii():
            counts = [counts[x - 1] for x in itertools.accumulate(len(ch.encode()) for ch in run)]
        # array("b") refuses a change that a signed byte can't hold
        return array.array("b", map(int.__sub__, counts, [0, *counts])).tobytes()

    def plain_counts(self, text: str) -> list[int]:
        """Counts at every code point prefix of a text without special strings."""
        out: list[int] = []
        base = 0
        run_at = run_base = 0  # the white space run that reaches up to here
        for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            word = text[s:e]
            if word in CONTRACTIONS:
                counts = [base + x for x in (1, *(1 + y for y in self.run_counts(word[1:].encode())))]
                counts[-1] = base + self.run_counts(word.encode())[-1]
                total = counts[-1]
            else:
                raw = word.encode()
                by_byte = self.run_counts(raw)
                if len(raw) == len(word):
                    counts = [base + x for x in by_byte]
                else:
                    ends = np.cumsum([len(ch.encode()) for ch in word]).tolist()
                    counts = [base + by_byte[x - 1] for x in ends]
                total = base + by_byte[-1]
            blank = 0
            while blank < len(word) and word[blank] in SPACE:
                blank += 1
            if blank:
                if not (s and text[s - 1] in SPACE):
                    run_at, run_base = s, base
                if run_at < s or blank < len(word):
                    run = text[run_at:s + blank].encode()
                    ends = np.cumsum([len(ch.encode()) for ch in text[run_at:s + blank]]).tolist()
                    own = self.run_counts(run)
                    counts[:blank] = [run_base + own[x - 1] for x in ends[s - run_at:]]
            out += counts
            base = total
        return out

    def counts(self, text: str) -> list[int]:
        """Counts at every code point prefix of any text."""
        def special(start: int) -> tuple[int, str]:
            """The next special string, the longest at its place."""
            return min(((i, t) for t in self.special if (i := text.find(t, start)) >= 0), default=(-1, ""), key=lambda x: (x[0], -len(x[1])))

        at, token = special(0)
        if at < 0:
            return self.plain_counts(text)
        out: list[int] = []
        start = 0
        while at >= 0:
            base = out[-1] if out else 0
            # inside the special string a prefix still reads as ordinary text
            inside = self.plain_counts(text[start:at + len(token) - 1])
            out += [base + x for x in inside]
            out.append(base + (inside[at - start - 1] if at > start else 0) + 1)
            start = at + len(token)
            at, token = special(start)
        base = out[-1]
        return out + [base + x for x in self.plain_counts(text[start:])]

    def deltas(self, text: str) -> bytes:
        counts = self.counts(text) if text else []
        return array.array("b", map(int.__sub__, counts, [0, *counts])).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        run = self.runs.__getitem__
        out = [b"".join(map(run, tokens.RUNS.findall(t))) if tokens.plain(t, self.special) else None for t in texts]
        rest = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(rest, self.cache.values([texts[i] for i in rest])):
            out[i] = b"".join(v)
        return out


@functools.lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


STORE = T.StructType([T.StructField("n_chars", T.LongType()), T.StructField("n_bytes", T.LongType()),
                      T.StructField("deltas", T.BinaryType()), T.StructField("totals", T.ArrayType(T.IntegerType()))])


def _store_of(path: str):
    @F.arrow_udf(STORE)
    def run(texts: pa.Array) -> pa.Array:
        own = counter(path)
        chars, sizes, rows, totals = [], [], [], []
        for _, part in c.text_batches(texts, 1_000_000):
            for t, raw in zip(part, own.texts(part)):
                v = np.frombuffer(raw, np.int8)
                chars.append(len(t))
                sizes.append(len(t.encode()))
                rows.append(raw)
                totals.append(np.add.reduceat(v, np.arange(0, len(v), STEP), dtype=np.int64).cumsum() if len(v) else [])
        return pa.StructArray.from_arrays(
            [pa.array(chars, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary()),
             pa.array(totals, pa.list_(pa.int32()))], ["n_chars", "n_bytes", "deltas", "totals"])
    return run


def prefix_table(docs: DataFrame, text: str = "text", name: str = "prefixes", path: str | None = None) -> DataFrame:
    """``docs`` with its texts' prefix counts in the struct column ``name`` (n_chars, n_bytes, deltas,
    totals), in place of a column of that name."""
    return docs.withColumn(name, _store_of(path or tokens.tokenizer_path())(F.col(text)))


@F.arrow_udf(T.LongType())
def count_at(deltas: pa.Array, totals: pa.Array, at: pa.Array) -> pa.Array:
    """Tokens of the prefix of ``at`` code points (at most the whole text): one total and part of one step."""
    out = []
    for d, t, n in zip(deltas, totals, at):
        v = np.frombuffer(d.as_buffer(), np.int8) if d.is_valid and len(d.as_buffer()) else np.zeros(0, np.int8)
        k = min(n.as_py(), len(v))
        whole = k // STEP
        out.append((t.values[whole - 1].as_py() if whole else 0) + int(v[whole * STEP:k].sum(dtype=np.int64)))
    return pa.array(out, pa.int64())


@F.arrow_udf(T.LongType())
def longest_within(deltas: pa.Array, budget: pa.Array) -> pa.Array:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    out = []
    for d, b in zip(deltas, budget):
        v = np.frombuffer(d.as_buffer(), np.int8) if d.is_valid and len(d.as_buffer()) else np.zeros(0, np.int8)
        fits = np.flatnonzero(np.cumsum(v, dtype=np.int64) <= b.as_py())
        out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return pa.array(out, pa.int64())


def tokens_at(store: str, at: Column) -> Column:
    return count_at(F.col(store)["deltas"], F.col(store)["totals"], at.cast("bigint"))


def truncation(store: str, budget: int) -> Column:
    return longest_within(F.col(store)["deltas"], F.lit(budget).cast("bigint"))
