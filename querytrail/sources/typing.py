"""Column types from cell values: the narrowest type that all values of a column fit.

The types form a lattice. A value has one bit for every type it fits; the bits of a column are
those that all its values share. Joining two sets of values is a bitwise AND, so Spark combines
the bits inside the tasks, for all columns in one aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.timecols import as_number
from ..session import compiled_methods, scratch_path

# From the narrowest; a column whose values share no type is text.
TYPES = ("logical", "integer", "double", "date", "datetime")
TEXT = "text"
# How logical values are written.
TRUE, FALSE = ("T", "TRUE", "true"), ("F", "FALSE", "false")
# A leading zero marks a code, such as a postal code, that must stay text. Repeats give nothing
# back (``++``), so that a text that fits no pattern fails at once.
NUMBER = (r"^[+-]?(?:(?:0|[1-9][0-9]*+)(?:\.[0-9]*+)?+|\.[0-9]++)"
          r"(?:[eE][+-]?[0-9]++)?+$")
DATETIME = (r"^[0-9]{4}[-/][0-9]{1,2}+[-/][0-9]{1,2}+"
            r"(?:[T ][0-9]{1,2}+:[0-9]{1,2}+:[0-9]{1,2}+"
            r"(?:\.[0-9]++)?+(?:Z|[+-][0-9]{2}:[0-9]{2})?+)?+$")
# A date-time that has a time is this long at least.
LEAST_WITH_TIME = len("2021-1-1 1:1:1")


def with_dashes(value: Column) -> Column:
    return F.replace(value, F.lit("/"), F.lit("-"))


def as_date(value: Column) -> Column:
    return with_dashes(value).try_cast("date")


def as_datetime(value: Column) -> Column:
    return with_dashes(value).try_cast("timestamp")


def bits(value: Column) -> Column:
    """One bit for every type that a text fits; NULL where there is no text."""
    def mark(*kinds: str) -> Column:
        return F.lit(sum(1 << TYPES.index(kind) for kind in kinds))

    def bit(kind: str, fits: Column) -> Column:
        return F.when(fits, mark(kind)).otherwise(0)

    # At most two patterns are tried on a cell, and one on most: a number without point and
    # exponent is whole, a date-time without time is a date, and nothing is both. All of them
    # begin with a digit, a sign or a point. A cast that fails is dear, so patterns come first.
    whole = ~value.contains(".") & ~value.contains("e") & ~value.contains("E")
    number = F.when(value.rlike(NUMBER), F.when(
        whole & value.try_cast("long").isNotNull(), mark("integer", "double")).otherwise(
            bit("double", F.abs(value.try_cast("double")) <= 1.7976931348623157e308))).otherwise(0)
    time = bit("datetime", as_datetime(value).isNotNull()) + bit(
        "date", (F.length(value) < LEAST_WITH_TIME) & as_date(value).isNotNull())
    dated = F.substring(value, 5, 1).isin("-", "/") & value.rlike(DATETIME)
    return F.when(value.isNotNull(), bit("logical", value.isin(*TRUE, *FALSE)) + F.when(
        (value >= "+") & (value < ":"), F.when(dated, time).otherwise(number)).otherwise(0))


def type_of(shared: int | None) -> str:
    """The narrowest type of the bits; a column without a value is logical."""
    if shared is None:
        return TYPES[0]
    return next((t for i, t in enumerate(TYPES) if shared >> i & 1), TEXT)


def cast(value: Column, kind: str) -> Column:
    if kind == "logical":
        return F.when(value.isin(*TRUE), True).when(value.isin(*FALSE), False)
    if kind == "integer":
        return value.try_cast("long")
    if kind == "double":
        return as_number(value)
    if kind == "date":
        return as_date(value)
    if kind == "datetime":
        return as_datetime(value)
    return value


def written_with_types(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` as a written table, and the types of its text ``columns``.

    The bits are observed on the rows as they are written: one job, one reading of the source.
    """
    seen = Observation()
    marks = {f"__bits_{i}": bits(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    shared = [F.bit_and(m).alias(f"c{i}") for i, m in enumerate(marks)]
    path = scratch_path(df.sparkSession, "cells")
    observed = df.withColumns(marks).observe(seen, *shared).drop(*marks) if shared else df
    with compiled_methods(df.sparkSession):
        observed.write.parquet(path)
    found = seen.get if shared else {}
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table, {c: type_of(found.get(f"c{i}")) for i, c in enumerate(columns)}


def typed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each of the text ``columns`` in the narrowest type that its values fit."""
    table, types = written_with_types(df, columns)
    return with_types(table, types)


def with_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.select(*[cast(F.col(f"`{c}`"), types[c]).alias(c) if c in types else F.col(f"`{c}`")
                       for c in df.columns])
