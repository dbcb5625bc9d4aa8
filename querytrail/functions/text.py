"""String expressions for queries, job ads and skill tags.

Everything here is a built-in Spark expression. ``(?U)`` makes the regular
expression classes Unicode-aware, so a no-break space is white space and a
letter outside ASCII is a word character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define the measures.
WORD = r"(?U)\S+"
WHITE_SPACE = r"(?U)\s+"
SPACES = ("\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
          "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
BOOLEAN_OPERATOR = r"(?U)\b(and|or|not)\b|\+|-|\|"
WILDCARD = r"\*|\?"
MAIL_LINK = "mailto:[^ ]+"
WEB_LINK = "http[^ ]+"
MISREAD_DASH, DASH = "\u0096", "-"
MISREAD_APOSTROPHE, APOSTROPHE = "\u0092", "'"
TITLE = r"^[^.\n]{10,120}"
QUERY_PUNCTUATION = r"""[+()"']"""
QUERY_WILDCARD = "*"
SKILL_SEPARATORS = "-_ "
LEADING_DIGITS = r"^[0-9]+"
LEADING_POSTAL_CODE = r"(?U)^\d+\s+"
FIRST_NUMBER = r"[0-9]+"
MISSING_MARK = "NA"

# Texts up to so many characters are compared outright. Longer ones are tried with these
# bounds where a text is so many times as long; a shared start has fewer than 2 ** 22 signs.
SHORT_TEXT = 96
BOUNDS = (16, 128, 1024)
WORTH = 6
LONGEST_START = 22


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def squish(text: Column) -> Column:
    """Trim, and shrink every inner run of white space to one blank."""
    return F.regexp_replace(trim_space(text), WHITE_SPACE, " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def has_boolean(text: Column) -> Column:
    """Whether the text uses a boolean operator; any ``+``, ``-`` or ``|`` counts."""
    return text.rlike(BOOLEAN_OPERATOR)


def has_wildcard(text: Column) -> Column:
    return text.rlike(WILDCARD)


def words(text: Column) -> Column:
    """Distinct non-empty words of one text, in an array."""
    return F.array_remove(F.array_distinct(F.split(text, WHITE_SPACE)), "")


def _without_common_start(pair: Column) -> Column:
    """Two texts ``a`` and ``b`` without the start they share, found by halving its length."""
    a, b = pair["a"], pair["b"]
    shorter = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(LONGEST_START))])

    def lengthen(size: Column, step: Column) -> Column:
        same = F.substring(a, F.lit(1), size + step) == F.substring(b, F.lit(1), size + step)
        return F.when((size + step <= shorter) & same, size + step).otherwise(size)

    size = F.aggregate(steps, F.lit(0), lengthen)
    return F.transform(F.array(size), lambda n: F.struct(
        F.substring(a, n + 1, F.char_length(a)).alias("a"),
        F.substring(b, n + 1, F.char_length(b)).alias("b")))[0]


def _bounded_distance(pair: Column) -> Column:
    """Distance of two texts, tried with bounds that are small against their length."""
    a, b = pair["a"], pair["b"]
    longest = F.greatest(F.char_length(a), F.char_length(b))
    tried = [F.when(longest > WORTH * bound, F.nullif(F.levenshtein(a, b, bound), F.lit(-1)))
             for bound in BOUNDS]
    return F.coalesce(*tried, F.levenshtein(a, b))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in characters; NULL if either text is.

    The whole table of a distance grows with the square of the length. Long texts therefore
    lose the start and the end that they share, and what is left is tried with bounds, each
    eight times the last, before the whole table is filled in. The result is the same.
    """
    longest = F.greatest(F.char_length(a), F.char_length(b))

    def turned(pair: Column) -> Column:
        return F.struct(F.reverse(pair["a"]).alias("a"), F.reverse(pair["b"]).alias("b"))

    # Each step is a lambda, so that its texts are made once.
    left = F.array(F.struct(a.alias("a"), b.alias("b")))
    for step in (_without_common_start, turned, _without_common_start, _bounded_distance):
        left = F.transform(left, step)
    return F.when(longest <= SHORT_TEXT, F.levenshtein(a, b)).otherwise(left[0])


def match_or_null(text: Column, pattern: str) -> Column:
    """First match of ``pattern``, NULL where there is none."""
    return F.regexp_substr(text, F.lit(pattern))


def clean_ad_text(text: Column) -> Column:
    """Squish first, then strip links, so blanks around a removed link remain."""
    squished = squish(text.cast("string"))
    unlinked = F.regexp_replace(F.regexp_replace(squished, MAIL_LINK, ""), WEB_LINK, "")
    dashed = F.replace(unlinked, F.lit(MISREAD_DASH), F.lit(DASH))
    return F.replace(dashed, F.lit(MISREAD_APOSTROPHE), F.lit(APOSTROPHE))


def without_separators(text: Column) -> Column:
    return F.translate(text, SKILL_SEPARATORS, "")


def concept(skill: Column) -> Column:
    """Lower-cased tag without hyphens, underscores and blanks."""
    return without_separators(F.lower(skill))


def search_terms(query: Column) -> Column:
    """Array of the distinct lower-case words of a query, without punctuation and ``*``."""
    plain = F.replace(F.regexp_replace(query, QUERY_PUNCTUATION, " "), F.lit(QUERY_WILDCARD),
                      F.lit(""))
    return words(F.lower(plain))
