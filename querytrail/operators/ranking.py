"""Top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows: each task keeps its own best, so nothing is sorted whole."""
    return df.orderBy(*order).limit(n)


def top_with_ties(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose value is at least the ``n``-th largest one.

    The frame is read twice, for the ``n``-th value and for the rows, so it is
    written once.
    """
    written = stored(df)
    threshold = (written.select(column).orderBy(F.desc_nulls_last(column)).limit(n)
                 .agg(F.min(column)).scalar())
    return written.where(F.col(column) >= threshold)
