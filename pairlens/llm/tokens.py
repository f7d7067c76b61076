"""Encoding with a public byte-level BPE tokenizer, as fast as its distinct words allow.

The pre-tokenizer of such a tokenizer always cuts before a single blank that
stands between two characters that are not white space, and nothing on one side
of that cut depends on the other. Texts are therefore cut there into pieces,
each distinct piece is encoded once by the tokenizers library, and a worker keeps
the ids of the pieces it has met (beyond ``CACHE_PIECES`` only the short ones, which recur).
In texts of plain characters the pre-tokens
themselves are plain runs; there each distinct run goes through the library's BPE
model once, and a slice of texts asks for each of its distinct runs once. The ids are
those of the library for the whole text.
"""

from __future__ import annotations

import array
import json
import os
import re
import struct
import sys
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs one task per core

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CACHE_PIECES = 200_000
#: longer pieces are encoded each time
CACHED_CHARS = 64
SHORT_CHARS = 8


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def load(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


#: a blank beside other white space, or at an end of the text: not a cut
UNSAFE = re.compile(r"\s | \s|\A | \Z")


def pieces(text: str) -> list[str]:
    """The pieces of a text; each but the first stands for a blank and itself."""
    out: list[str] = []
    for part in text.split(" "):
        if out and (not part or part[0].isspace() or not out[-1] or out[-1][-1].isspace()):
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return out


class PieceCache:
    """What ``fn`` gives for each piece; ``fn`` takes the texts of new pieces."""

    def __init__(self, fn: Callable[[list[str]], Iterable], limit: int = CACHE_PIECES):
        self.fn, self.limit = fn, limit
        self.inner: dict[str, object] = {}

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces, in order."""
        if len(self.inner) > self.limit:
            self.inner = {p: v for p, v in self.inner.items() if len(p) <= SHORT_CHARS}
            if len(self.inner) > self.limit // 2:
                self.inner = {}
        get = self.inner.get
        firsts, rests, found, missing = [], [], [], set()
        for t in texts:
            first, *rest = pieces(t) if UNSAFE.search(t) else t.split(" ")
            got = list(map(get, rest))
            if None in got:
                missing.update([p for p, v in zip(rest, got) if v is None])
            else:
                rest = None
            firsts.append(first)
            rests.append(rest)
            found.append(got)
        new = list(missing)
        fresh: dict[str, object] = {}
        for i in range(0, len(new), 2000):
            part = new[i:i + 2000]
            fresh.update(zip(part, self.fn([f" {p}" for p in part])))
        heads = list(self.fn(firsts))
        out = []
        for head, got, rest in zip(heads, found, rests):
            if rest is not None:
                got = [fresh[p] if v is None else v for p, v in zip(rest, got)]
            out.append([head, *got])
        # a piece that ends in white space is one only at the end of its text
        self.inner.update((p, v) for p, v in fresh.items() if len(p) <= CACHED_CHARS and not p[-1].isspace())
        return out


def _packed(ids: list[int]) -> bytes:
    if len(ids) < len(_FEW):
        return _FEW[len(ids)](*ids)
    a = array.array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


#: packs of a word's few ids, for which an array of their own would take longer
_FEW = [struct.Struct(f"<{n}I").pack for n in range(9)]


#: Texts of letters up to U+00FF, ASCII digits and punctuation without the apostrophe, with single
#: blanks or line breaks between: their pre-tokens are their runs, without the pattern's special cases.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(rf"(?:[ \n]?[{_LETTER}0-9{_MARK}]++)*+")
RUNS = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\n")


def plain(text: str, special: Iterable[str] = ()) -> bool:
    """Whether the pre-tokens of ``text`` are its ``RUNS`` (no special string may be in it)."""
    return PLAIN.fullmatch(text) is not None and not any(x in text for x in special)


#: what each byte of a plain text is: 0 a blank, 1 of a letter, 2 a digit, 3 a line break, 4 a mark
_CLASS = np.full(256, 4, np.uint8)
_CLASS[128:] = 1
for _first, _last, _class in (("A", "Z", 1), ("a", "z", 1), ("0", "9", 2), ("\n", "\n", 3), (" ", " ", 0)):
    _CLASS[ord(_first):ord(_last) + 1] = _class


def runs_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The ``RUNS`` of several plain texts as one column, and each text's first run (one entry more
    than texts): a run begins where the kind of character changes, but not behind a blank."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    text_at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    kind = _CLASS[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
    begins[text_at] = True
    at = np.flatnonzero(begins)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])
    return runs, np.searchsorted(at, text_at)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand
    for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


#: the letters of blank and line break
BLANK_LETTER, BREAK_LETTER = "\u0120", "\u010a"


class RunCache(dict):
    """run -> what ``fn`` gives for it; long runs are not kept, and beyond ``limit`` only short ones are."""

    def __init__(self, fn: Callable[[str], bytes], limit: int = 600_000):
        self.fn, self.limit = fn, limit

    def __missing__(self, run: str) -> bytes:
        v = self.fn(run)
        if len(run) <= CACHED_CHARS:
            if len(self) >= self.limit:
                keep = {k: x for k, x in self.items() if len(k) <= SHORT_CHARS}
                self.clear()
                if len(keep) <= self.limit // 2:
                    self.update(keep)
            self[run] = v
        return v


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        #: only a byte-level tokenizer with the usual pattern can be cut at blanks
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) \
            and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.letters = {b: ord(ch) for ch, b in byte_letters().items()}
        self.tokenize = self.tokenizer.model.tokenize
        self.runs = RunCache(self._run)
        self.cache = PieceCache(self._encode)

    def _run(self, run: str) -> bytes:
        # of a plain run's ASCII characters only the blank or line break at its begin stands for another letter
        if run.isascii():
            word = (BLANK_LETTER if run[0] == " " else BREAK_LETTER) + run[1:] if run[0] in " \n" else run
        else:
            word = run.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.tokenize(word)])

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: each distinct run is looked up once, then dealt to its places."""
        runs, first = runs_of([t.encode() for t in texts])
        coded = runs.dictionary_encode()
        found = list(map(self.runs.__getitem__, coded.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False)))
        ends = np.concatenate([[0], np.cumsum([len(v) for v in found], dtype=np.int64)])
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(found))])
        ids = own.take(coded.indices)
        _, at, raw = ids.buffers()
        cuts = np.frombuffer(at, np.int64, len(ids) + 1, ids.offset * 8)[first].tolist()
        raw = memoryview(raw) if raw is not None else memoryview(b"")
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._encode(texts)
        out: list = [None] * len(texts)
        simple = [i for i, t in enumerate(texts) if plain(t, self.special)]
        if simple:
            for i, v in zip(simple, self._encode_plain([texts[i] for i in simple])):
                out[i] = v
        rest = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(rest, self.cache.values([texts[i] for i in rest])):
            out[i] = b"".join(v)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
