"""Helpers that work on the list of columns of a DataFrame."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import stored


# Signs that become words, quotes that go, and Latin letters whose Unicode name
# does not say which plain letters stand for them.
SIGNS = {"%": "_percent_", "#": "_number_", "'": "", '"': "", "\u2019": "", "\u2018": ""}
SPELLED = {"SHARP S": "ss", "ETH": "d", "THORN": "th", "ENG": "ng", "DOTLESS I": "i"}
LATIN = re.compile(r"LATIN (SMALL|CAPITAL) (?:LETTER|LIGATURE) (.+?)(?: WITH .*)?")


def plain_letters(text: str) -> str:
    """Letters as ASCII: accents go, ligatures and crossed letters become plain ones.

    A Latin letter is spelled as its Unicode name says, such as ``O WITH STROKE`` or ``AE``;
    letters of other scripts by the last word of theirs, so that names stay apart.
    """
    out = []
    marks = [c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)]
    for c, after in zip(marks, [*marks[1:], ""], strict=False):
        name = unicodedata.name(c, "")
        latin = LATIN.fullmatch(name)
        if c.isascii():
            out.append(c)
        elif latin:
            letters = SPELLED.get(latin[2], latin[2].split()[-1].lower())
            if latin[1] == "CAPITAL":
                letters = letters.capitalize() if after.islower() else letters.upper()
            out.append(letters)
        elif c.isalpha() and name:
            out.append(name.split()[-1].lower() if " LETTER " in name else f"u{ord(c):x}")
        else:
            out.append("_")
    return "".join(out)


def snake_case(name: str) -> str:
    """Lower-case ASCII words joined by ``_``.

    Words end at signs and blanks, before a capital that follows a small letter or digit, and
    before the last of several capitals that a small letter follows.
    """
    for sign, word in SIGNS.items():
        name = name.replace(sign, word)
    plain = plain_letters(name.strip())
    spaced = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", plain))
    snake = re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower()
    if not snake:
        return "x"
    return f"x{snake}" if snake[0].isdigit() else snake


def clean_names(df: DataFrame) -> DataFrame:
    """Unique snake_case names; a repeated name gets the next free number."""
    taken: set[str] = set()
    names = []
    for column in df.columns:
        first = name = snake_case(column)
        number = 1
        while name in taken:
            number += 1
            name = f"{first}_{number}"
        taken.add(name)
        names.append(name)
    return df.toDF(*names)


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Those of ``names`` that the frame has, in the order given."""
    return [name for name in names if name in df.columns]


def pick_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """First candidate that the frame has."""
    return next(iter(present(df, candidates)), None)


def without_index_columns(df: DataFrame) -> DataFrame:
    """Drop unnamed columns, which readers call ``...1`` or ``_c0``."""
    return df.select(*[f"`{c}`" for c in df.columns
                       if not c.startswith("...") and not re.fullmatch(r"_c\d+", c)])


def without_empty_columns(df: DataFrame) -> DataFrame:
    """``df`` as a written table without the columns that hold no value at all.

    The result's columns depend on the data. Values are counted on the rows as they are
    written, so the frame is computed once, for this and for whatever reads the result.
    """
    seen = Observation()
    counts = [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    table = stored(df.observe(seen, *counts))
    found = seen.get
    return table.select(*[f"`{c}`" for i, c in enumerate(df.columns) if found.get(f"c{i}")])
