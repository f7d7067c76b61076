"""Column expressions for text normalisation, boundary marking and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.config import MARKER

# ---- fixed values (must equal the original pipeline's for equal results) ----
# Every character Python's str.split() treats as blank (29 in the BMP), as a
# Java regex class: plain \s covers only 6 of them.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANK_RUN = BLANK + "+"
# Blank runs other than a lone space. Printable ASCII, nearly every character, is told off by one range
# before the long class is tried.
UNEVEN_BLANKS = rf"[^!-~](?:(?<= )(?![!-~]){BLANK}++|(?<![ -~])(?<={BLANK}){BLANK}*+)"
# A run of boundary characters, possibly with blanks between them.
BOUNDARY_RUN = r"([.,?!;\n]+(?:\s+[.,?!;\n]+)*)"
NEWLINE_PLACEHOLDER = "<NEWLINE>"
# ---- end of fixed values ----


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize(text: Column | str) -> Column:
    """Add a final newline, make each newline its own word, collapse blank
    runs to one space, trim; a literal placeholder also becomes a newline."""
    t = F.coalesce(_c(text), F.lit(""))
    t = F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))
    t = F.replace(t, F.lit("\n"), F.lit(f" {NEWLINE_PLACEHOLDER} "))
    t = F.btrim(F.regexp_replace(t, UNEVEN_BLANKS, " "))
    return F.replace(t, F.lit(NEWLINE_PLACEHOLDER), F.lit("\n"))


def mark_boundaries(norm: Column | str) -> Column:
    """Append the marker after each run of boundary characters."""
    return F.regexp_replace(_c(norm), BOUNDARY_RUN, "$1" + MARKER)


def strip(text: Column | str) -> Column:
    """str.strip(): no blanks of that class at either end."""
    return F.regexp_replace(_c(text), rf"\A{BLANK_RUN}|{BLANK_RUN}\z", "")


def split_words(text: Column | str) -> Column:
    """Words separated by single spaces (empty words kept, as str.split(' '))."""
    return F.split(_c(text), " ", -1)


def blank_words(text: Column | str) -> Column:
    """Words of str.split() with no argument: blank runs, no empty words."""
    t = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), BLANK_RUN, " "), F.lit(" "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ", -1))


def word_tokens(chunk: Column | str) -> Column:
    """Word tokens of a chunk; each marker is cut loose as its own token."""
    spaced = F.replace(_c(chunk), F.lit(MARKER), F.lit(f" {MARKER} "))
    return F.array_remove(F.split(spaced, " ", -1), "")


def hash_bucket(word: Column, width: int) -> Column:
    """Stable bucket of a word: first 32 bits of its md5, modulo width."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(width))
