"""Line-first quality rules (operator 7).

Every line is judged on its own (punctuation, navigation, boilerplate); failing
lines are removed, and a document that loses too much of its text that way is
rejected. ``verdicts`` counts, ``clean`` returns the texts without their failing lines,
``keep_good`` only rejects documents, ``clean_good`` does both. The document-level base counts (repeated words, symbols, duplicate
lines) come from the same pass over the text; words are numbered in slices of it and their
windows compared as numbers, so a long text is never held as a list of windows.

Defined cases: a null text has no words; a document of fewer than
``min_words`` words, or whose repeated 3-word windows hold over half of its
words, fails the base rule and is never kept; lines without a word are neither
judged nor counted; repeated rows are judged each on its own. The work is
row-local: no shuffle, one text in memory at a time, whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm import common as c

SYMBOLS = "#*$%&|<>"
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: bytes of a text whose words are numbered at a time
SLICE = 1 << 20
#: marks that end a sentence or a clause
MARKS = re.compile("[.!?:;…。！？؟।]")
NAV_WORDS = frozenset(
    "home menu login logout sign register search about contact help faq sitemap next previous prev back top "
    "share tweet subscribe newsletter archive categories tags rss privacy terms cookies skip".split())
BOILERPLATE = re.compile(
    r"all rights reserved|accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|"
    r"enable javascript|javascript is (?:disabled|required)|subscribe to our newsletter|click here|"
    r"powered by|lorem ipsum|copyright (?:©|\(c\))|released under the .{0,40}licen[cs]e", re.IGNORECASE)

#: case-folded parts, one of which any boilerplate holds (without the letter i, which has odd case forms)
BOILERPLATE_PARTS = ("reserved", "accept", "coo", "vacy pol", "terms of", "javascr", "newsletter", "ck here", "powered by", "lorem ",
                     "copyr", "released under the ")


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: a line of at least so many words must have a mark that ends a sentence or a clause
    punctuated_from: int = 5
    #: a line of at most so many words can be navigation
    nav_words: int = 12
    nav_separators: int = 2
    max_symbol_share: float = 0.1
    #: documents losing more than this share of their word characters go
    max_lost_share: float = 0.5


def word_numbers(raw: bytes) -> np.ndarray:
    """A number for every word, the same for equal words; the text is cut in slices between words."""
    numbers: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + SLICE)
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()
        for w in set(words):
            numbers.setdefault(w, len(numbers))
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def repeated_words(words: np.ndarray) -> int:
    """Words (numbers) inside 3-word windows that occur twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    size = int(words.max()) + 1
    pairs = words[:-2] * size + words[1:-1]
    if size >= 1 << 21:  # three numbers don't fit one then
        pairs = np.unique(pairs, return_inverse=True)[1]
    grams = pairs * size + words[2:]
    ranked = np.sort(grams)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    marked = np.zeros(len(words), bool)
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    marked[1:] |= marked[:-1]  # a window covers its first word and the two behind it
    marked[1:] |= marked[:-1]
    return int(marked.sum())


def lines_of(text: str):
    """(line, its words) of a text."""
    odd = any(b in text for b in c.BLANKS if b not in " \n")
    for line in text.split("\n"):
        yield line, [w for w in (line.translate(_TO_SPACE) if odd else line).split(" ") if w]


def may_be_boilerplate(text: str) -> bool:
    """False if no line of the text can be."""
    folded = text.casefold()
    return any(part in folded for part in BOILERPLATE_PARTS)


def line_fails(line: str, words: list[str], seen_before: bool, rules: LineRules, boilerplate: bool = True) -> str | None:
    """The rule that removes the line, or None; ``boilerplate`` is False where no line of the text can be."""
    if seen_before:
        return "duplicate"
    chars = sum(map(len, words))
    if sum(map(line.count, SYMBOLS)) > rules.max_symbol_share * chars:
        return "symbols"
    if boilerplate and BOILERPLATE.search(line):
        return "boilerplate"
    if len(words) <= rules.nav_words:
        separators = sum(w in ("|", ">", "»", "›", "·", "•", "/", "-") for w in words)
        if separators >= rules.nav_separators:
            return "navigation"
        if all(w.strip(".,:;|>»").lower() in NAV_WORDS for w in words):
            return "navigation"
    if len(words) >= rules.punctuated_from and not MARKS.search(line):
        return "punctuation"
    return None


def judge_text(text: str | None, rules: LineRules) -> tuple:
    text = text or ""
    words = word_numbers(text.encode("utf-8", "surrogatepass"))
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, c.BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    n_repeat = repeated_words(words)
    del words
    seen: set[str] = set()
    n_dup = n_lines = n_removed = lost = 0
    boilerplate = may_be_boilerplate(text)
    for line, own in lines_of(text):
        if not own:
            continue
        n_lines += 1
        again = line in seen
        n_dup += again
        seen.add(line)
        if line_fails(line, own, again, rules, boilerplate):
            n_removed += 1
            lost += sum(map(len, own))
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not base_failed and lost <= rules.max_lost_share * word_chars
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, n_lines, n_removed, lost, kept


_TO_SPACE = {ord(b): " " for b in c.BLANKS}

FIELDS = [("n_words", *c.LONG), ("word_chars", *c.LONG), ("n_symbols", *c.LONG), ("n_dup_lines", *c.LONG),
          ("n_repeat_words", *c.LONG), ("base_failed", *c.BOOL), ("n_lines", *c.LONG), ("n_removed_lines", *c.LONG),
          ("lost_chars", *c.LONG), ("kept", *c.BOOL)]


def clean_text(text: str | None, rules: LineRules = LineRules()) -> str | None:
    """The text without its failing lines (lines without a word stay)."""
    if text is None:
        return None
    seen: set[str] = set()
    out = []
    boilerplate = may_be_boilerplate(text)
    for line, own in lines_of(text):
        if not own or not line_fails(line, own, line in seen, rules, boilerplate):
            out.append(line)
        if own:
            seen.add(line)
    return "\n".join(out)


def verdicts(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), name: str = "quality") -> DataFrame:
    """``docs`` with one struct column ``name`` (in place of a column of that name): counts, removed
    lines and the verdict."""
    judge = c.row_results(FIELDS, lambda t: judge_text(t, rules))
    return docs.withColumn(name, judge(F.col(text)))


def clean(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with the failing lines taken out of ``text``; a null stays null, and no row goes."""
    cut = c.row_results([("text", *c.STRING)], lambda t: (clean_text(t, rules),))
    return docs.withColumn(text, cut(F.col(text))["text"])


def keep_good(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    name = c.own_name(docs, "quality")
    return verdicts(docs, text, rules, name).filter(F.col(name)["kept"]).drop(name)


def clean_good(docs: DataFrame, text: str = "text", size: str | None = None, rules: LineRules = LineRules()) -> DataFrame:
    """The rows that the rules keep, without their failing lines, in one pass; a column ``size`` follows
    the text's new length. Texts without a failing line stay as they are."""
    name = c.own_name(docs, "quality")

    def both(t: str | None) -> tuple:
        judged = judge_text(t, rules)
        n_removed, kept = judged[7], judged[-1]
        return kept, clean_text(t, rules) if kept and n_removed else None

    # once per row: a deterministic one would run for the filter and again for the text
    judge = c.row_results([("kept", *c.BOOL), ("cleaned", *c.STRING)], both).asNondeterministic()
    out = docs.withColumn(name, judge(F.col(text))).filter(F.col(name)["kept"])
    cut = F.col(name)["cleaned"]
    if size:
        out = out.withColumn(size, F.when(cut.isNotNull(), F.length(cut).cast(docs.schema[size].dataType)).otherwise(F.col(size)))
    return out.withColumn(text, F.coalesce(cut, F.col(text))).drop(name)
