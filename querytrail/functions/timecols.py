"""Number and time expressions that yield NULL, never an error, on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bound that tells milliseconds from seconds, and the month names.
LARGEST_SECONDS = 1e11
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august",
          "september", "october", "november", "december")
DATETIME_TEXT = "yyyy-MM-dd HH:mm:ss"
COMMON_LAYOUT = "yyyy-MM-dd HH:mm:ss"
LATEST_YEAR = 68  # of two digits; a greater one lies in the last century

# Numbers have two digits, or one that stands alone. Between them anything but digits may
# stand, or nothing. A year has four digits, or two that stand alone or begin a run of
# year, month and day, or of all six numbers.
_TWO = r"([0-9]{2}|(?<![0-9])[0-9](?![0-9]))"
_YEAR = (r"([0-9]{4}|(?<![0-9])[0-9]{2}(?=[^0-9])"
         r"|(?<![0-9])[0-9]{2}(?=[0-9]{4}(?![0-9])|[0-9]{10}(?![0-9])))")
_NAME = "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS)
_MONTH = rf"([0-9]{{2}}|(?<![0-9])[0-9](?![0-9])|(?<![a-z])(?:{_NAME})(?![a-z]))"
_GAP = "[^0-9]*?"
ORDERED = (rf"(?i)^[^0-9]*{_YEAR}{_GAP}{_MONTH}{_GAP}{_TWO}{_GAP}{_TWO}{_GAP}{_TWO}{_GAP}{_TWO}"
           r"(?![0-9])(?:[.,]([0-9]+))?(?:[^0-9]*?(?<![a-z])([ap])\.?m(?![a-z]))?"
           r"(?:[^0-9+-]*([+-][0-9]{2}(?::?[0-9]{2})?)(?![0-9]))?[^0-9]*$")


def as_number(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def as_integer(value: Column) -> Column:
    """Truncates toward zero, as ``1.9`` becomes 1."""
    return as_number(value).try_cast("int")


def as_long(value: Column) -> Column:
    return as_number(value).try_cast("long")


def fix_timestamp_units(value: Column) -> Column:
    """Epoch seconds: milliseconds are divided, values up to 0 become NULL."""
    number = as_number(value)
    seconds = F.when(number > LARGEST_SECONDS, number / 1000).otherwise(number)
    return F.when(seconds > 0, seconds)


def parse_datetime(value: Column) -> Column:
    """A date-time from any text that gives year, month, day, hour, minute and second in order.

    What stands before, between and after the numbers does not matter. Months may be English
    names, years have two digits (69 to 99 in the 1900s) or four, runs of numbers without gaps
    must be padded with zeros, seconds may have a fraction, and AM or PM and an offset from UTC
    may follow. Anything else, a missing number or an impossible date is NULL.
    """
    text = F.trim(value.cast("string"))
    # The usual layout needs no pattern; the rest is only tried where that fails.
    return F.coalesce(F.try_to_timestamp(text, F.lit(COMMON_LAYOUT)), _by_order(text))


def _by_order(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, ORDERED, "$1|$2|$3|$4|$5|$6|$7|$8|$9"), r"\|", -1)
    # In a lambda the parts are taken apart once, not for every use.
    return F.when(text.rlike(ORDERED), F.transform(F.array(parts), _assembled)[0])


def _assembled(parts: Column) -> Column:
    """The date-time of the nine parts that ``ORDERED`` finds."""
    def number(i: int) -> Column:
        return parts[i].try_cast("int")

    year = F.when(F.length(parts[0]) == 4, number(0)).when(
        number(0) <= LATEST_YEAR, number(0) + 2000).otherwise(number(0) + 1900)
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])
    named = F.array_position(names, F.lower(F.substring(parts[1], 1, 3))).cast("int")
    month = F.coalesce(number(1), named)
    half = F.lower(parts[7])
    hour = F.when(half == "", number(3)).when(
        number(3).between(1, 12), number(3) % 12 + F.when(half == "p", 12).otherwise(0))
    fraction = F.concat(F.lit("0."), F.substring(parts[6], 1, 6), F.lit("0")).try_cast("decimal(8,6)")
    offset = F.regexp_replace(parts[8], ":", "")
    minutes = F.when(offset == "", 0).otherwise(
        F.when(offset.startswith("-"), -1).otherwise(1)
        * (F.substring(offset, 2, 2).try_cast("int") * 60
           + F.coalesce(F.substring(offset, 4, 2).try_cast("int"), F.lit(0))))
    local = F.try_make_timestamp(year, month, number(2), hour, number(4),
                                 number(5).cast("decimal(8,6)") + fraction)
    return F.timestamp_add("MINUTE", -minutes, local)


def datetime_text(value: Column) -> Column:
    return F.date_format(value, DATETIME_TEXT)
