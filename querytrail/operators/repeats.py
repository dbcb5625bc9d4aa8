"""Row filters that look at repeated values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .joins import null_safe_join

MARK = "_mark"


def keep_repeating_rows(df: DataFrame, row_id: str = "row_id",
                        anchor: str | None = None) -> DataFrame:
    """Keep the rows in which some column repeats a value of an earlier row.

    A row goes only if each of its values (NULL being a value) occurs there for
    the first time, in the order of ``row_id``, which itself is not looked at.

    Such a row is the first of its value in *every* column, hence also in the
    ``anchor`` column. So the candidates are the first rows per anchor value, and
    only the values these hold need to be checked in the other columns. Any anchor
    gives the same rows; one with few values leaves next to nothing to check.
    """
    columns = [c for c in df.columns if c != row_id]
    anchor = anchor or columns[0]
    others = [c for c in columns if c != anchor]

    all_new = stored(
        df.groupBy(anchor).agg(F.min(row_id).alias(row_id)).select(row_id))
    if others:
        candidates = stored(
            _cells(df.join(all_new, row_id, "left_semi"), others, row_id))
        held = candidates.select("column", "value")
        first_seen = (null_safe_join(_cells(df, others, row_id), held, ["column", "value"],
                                     "left_semi")
                      .groupBy("column", "value").agg(F.min(row_id).alias("first_id")))
        all_new = stored(
            null_safe_join(candidates, first_seen, ["column", "value"], "inner")
            .groupBy(row_id)
            .agg(F.bool_and(F.col(row_id) == F.col("first_id")).alias("all_new"))
            .where("all_new").select(row_id))
    return df.join(all_new, row_id, "left_anti")


def _cells(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """One row per cell: the row id, the column's number and the value as text."""
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("value"))
                      for i, c in enumerate(columns)])
    return df.select(row_id, F.explode(cells).alias("cell")).select(row_id, "cell.*")


def without_exact_copies(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The first of each set of rows equal in all columns but ``row_id``.

    Equal rows have equal marks. So rows are counted by mark, without their contents, and only
    those that share a mark are grouped by all columns.
    """
    columns = [c for c in df.columns if c != row_id]
    marked = df.withColumn(MARK, row_mark(df, columns))
    shared = stored(marked.groupBy(MARK).agg(F.count(F.lit(1)).alias("rows"))
                    .where(F.col("rows") > 1).select(MARK))
    if shared.isEmpty():
        return df
    grouped = marked.join(shared, MARK, "left_semi").groupBy(*columns).agg(
        F.min(row_id).alias(row_id))
    return marked.join(shared, MARK, "left_anti").select(*df.columns).union(
        grouped.select(*df.columns))


def row_mark(df: DataFrame, columns: Sequence[str]) -> Column:
    """A whole number that rows equal in ``columns`` share; others rarely do."""
    kinds = dict(df.dtypes)
    # -0.0 and 0.0 are equal, but not bit by bit.
    return F.xxhash64(*[F.col(c) + F.lit(0.0) if kinds[c] in ("float", "double") else F.col(c)
                        for c in columns])
