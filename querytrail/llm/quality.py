"""Operator 7: line-first cleaning of documents."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .tables import map_texts, read

# The base rules.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"   # words are what lies between them
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
WINDOW = 3

# Rules per line. A line that ends a sentence and is long enough is never navigation.
SENTENCE_END = re.compile("[.!?…:;][\"'»“”)\\]]*$")
NAV_WORDS = 3            # a shorter line that ends no sentence is a menu entry
NAV_MARKS = "|»›•>"
NAV_SEPARATOR = re.compile(r"(?:^|\s)[|»›•>](?:\s|$)")
NAV_SEPARATORS = 3       # so many separators make a menu or table row
SYMBOL_SHARE = 0.1       # symbols among the characters of a line's words
SHOUT = "!!"
SHOUT_SHARE = 0.3        # words ending in repeated exclamation marks
BOILERPLATE = re.compile(
    r"(?i)^(?:all rights reserved\b|copyright\b|©|\(c\) ?\d{4}"
    r"|(?:licensed|released) under\b|this work is licensed under\b"
    r"|terms (?:of use|and conditions)\b|privacy policy\b|cookie (?:policy|settings)\b"
    r"|(?:we|this site) uses? cookies\b|sign (?:in|up)\b|log ?in\b|subscribe\b"
    r"|share (?:this|on)\b|(?:please )?enable javascript\b|read more\b|skip to content\b)")
LOST_SHARE = 0.5         # of the word characters; a document that loses more goes


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool


def words_of(text: str) -> list[str]:
    for blank in BLANKS[1:]:
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def symbols_in(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            covered[i:i + WINDOW] = b"\1" * WINDOW
            covered[j:j + WINDOW] = b"\1" * WINDOW
    return sum(covered)


def base_measures(text: str, words: list[str]) -> Base:
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    n_repeat = repeated_words(words)
    return Base(len(words), sum(map(len, words)), symbols_in(text),
                len(lines) - len(set(lines)), n_repeat,
                len(words) < LEAST_WORDS or 100 * n_repeat > 50 * len(words))


def line_fault(line: str) -> str | None:
    """The first rule a line fails: symbols, shouting, navigation or boilerplate."""
    words = words_of(line)
    if not words:
        return None
    chars = sum(map(len, words))
    if (any(map(line.__contains__, NAV_MARKS))
            and len(NAV_SEPARATOR.findall(line)) >= NAV_SEPARATORS):
        return "navigation"
    if symbols_in(line) > SYMBOL_SHARE * chars:
        return "symbols"
    if SHOUT in line and sum(SHOUT in w for w in words) > SHOUT_SHARE * len(words):
        return "shouting"
    if len(words) < NAV_WORDS and not SENTENCE_END.search(line.rstrip()):
        return "navigation"
    if BOILERPLATE.match(line.strip()):
        return "boilerplate"
    return None


def clean_lines(text: str) -> tuple[str, int, int]:
    """The text without failing lines, their number, and the word characters lost."""
    kept, failed, lost = [], 0, 0
    for line in text.split("\n"):
        if line_fault(line) is None:
            kept.append(line)
        else:
            failed += 1
            lost += sum(map(len, words_of(line)))
    return "\n".join(kept), failed, lost


def judged_text(text: str) -> dict:
    base = base_measures(text, words_of(text))
    cleaned, failed, lost = clean_lines(text)
    return base._asdict() | {
        "kept": not base.base_failed and lost <= LOST_SHARE * base.word_chars,
        "n_failed_lines": failed, "lost_chars": lost, "cleaned": cleaned}


MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, "
            "lost_chars long")


def judged_texts(texts: list[str]) -> dict[str, list]:
    rows = [judged_text(t) for t in texts]
    return {name: [r[name] for r in rows] for name in rows[0]} if rows else {}


def line_first_quality(docs: DataFrame, text: str = "text", key: str = "doc_id",
                       with_text: bool = True) -> DataFrame:
    """``key``, the measures, ``kept`` and, on request, the ``cleaned`` text of every document.

    Each line is judged by itself: menu rows and unfinished short lines (navigation), lines of
    symbols or shouting (punctuation), and notices that open with a known phrase (boilerplate).
    Failing lines are removed; a document that loses more than half of its word characters, or
    that fails the base rules, is not kept. One pass without a shuffle, texts whole.

    A NULL text counts as empty: no words, so it fails the base rules. Lines without words are
    neither judged nor lost. Repeated rows get the same answer each, an empty table gives no
    rows, extra columns are left out.
    """
    added = MEASURES + (", cleaned string" if with_text else "")
    return map_texts(docs, judged_texts, added, (key,), text)


def op7_line_first_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every whole document text."""
    return line_first_quality(read(spark, folder, "documents"), with_text=False)
