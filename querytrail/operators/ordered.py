"""Row position and previous row inside ordered groups, safe for hot groups.

A window sorts each group in one task. That is right for ordinary groups; a
group with more than ``max_group_rows`` rows is instead range-partitioned on its
order columns into parts of about that size, each part is numbered by its own
window, and the value carried over from one part to the next comes from a table
with one row per part.

Order columns sort ascending with NULL last, and together should be unique
inside a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .joins import hot_keys, null_safe_join

# Tuning parameter: both ways give the same rows.
MAX_GROUP_ROWS = 5_000_000

_PART = "_part"
_CARRY = "_carry"
_PLACE = "_place"


def _sort_key(order: Sequence[str]) -> list[Column]:
    return [key for name in order for key in (F.col(name).isNull(), F.col(name))]


def _split_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_group_rows: int,
               sizes: DataFrame | None,
               rows_at_most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """``df`` as (ordinary rows, rows of hot groups cut into parts or None)."""
    if rows_at_most is not None and rows_at_most <= max_group_rows:
        return df, None
    if sizes is None:
        hot = hot_keys(df, keys, max_group_rows)
    else:
        hot = sizes.where(F.col("rows") > max_group_rows)
    hot_rows = hot.agg(F.sum("rows")).first()[0] if hot is not None else None
    if not hot_rows:
        return df, None
    # At most (rows of df / max_group_rows) groups can be hot: small by definition.
    listed = F.broadcast(hot.select(*keys))
    ordinary = null_safe_join(df, listed, keys, "left_anti")
    parts = math.ceil(hot_rows / max_group_rows) + 1
    # Part numbers depend on sampled range bounds, so they are written before
    # two branches use them.
    cut = stored(
        null_safe_join(df, listed, keys, "left_semi")
        .repartitionByRange(parts, *keys, *_sort_key(order))
        .withColumn(_PART, F.spark_partition_id()))
    return ordinary, cut


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  previous: dict[str, str], max_group_rows: int = MAX_GROUP_ROWS,
                  sizes: DataFrame | None = None,
                  rows_at_most: int | None = None) -> DataFrame:
    """Add ``{new column: source column}`` taken from the previous row of the group.

    Whether a group is hot is found by ``hot_keys``. ``sizes`` (the keys and
    ``rows``) gives the counts ready made; a known bound on the rows of ``df``, if below
    the limit, makes it unnecessary.
    """
    ordinary, cut = _split_hot(df, keys, order, max_group_rows, sizes, rows_at_most)
    window = Window.partitionBy(*keys).orderBy(*_sort_key(order))
    result = ordinary.withColumns({new: F.lag(source).over(window)
                                   for new, source in previous.items()})
    if cut is None:
        return result

    last_row = F.struct(*[F.col(source).alias(new) for new, source in previous.items()])
    ends = cut.groupBy(*keys, _PART).agg(
        F.max_by(last_row, F.struct(*_sort_key(order))).alias(_CARRY))
    # One row per part, so this window is as small as the number of parts.
    carried = ends.withColumn(
        _CARRY, F.lag(_CARRY).over(Window.partitionBy(*keys).orderBy(_PART)))
    inner = Window.partitionBy(*keys, _PART).orderBy(*_sort_key(order))
    joined = (null_safe_join(cut, F.broadcast(carried), [*keys, _PART])
              .withColumn(_PLACE, F.row_number().over(inner)))
    hot = joined.withColumns({
        new: F.when(F.col(_PLACE) == 1, F.col(_CARRY)[new]).otherwise(F.lag(source).over(inner))
        for new, source in previous.items()})
    return result.unionByName(hot.drop(_PART, _CARRY, _PLACE))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
                  max_group_rows: int = MAX_GROUP_ROWS,
                  sizes: DataFrame | None = None,
                  rows_at_most: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in its ordered group."""
    placed = with_sum_before(df, keys, order, F.lit(1), name, max_group_rows, sizes, rows_at_most)
    return placed.withColumn(name, F.col(name) + 1)


def with_sum_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                    name: str, max_group_rows: int = MAX_GROUP_ROWS,
                    sizes: DataFrame | None = None,
                    rows_at_most: int | None = None) -> DataFrame:
    """Add the sum of whole ``value`` over the earlier rows of each ordered group, 0 at first.

    With the number of rows that each row stands for, this gives their positions before
    they are exploded.
    """
    ordinary, cut = _split_hot(df, keys, order, max_group_rows, sizes, rows_at_most)

    def before(*names: str) -> Column:
        window = Window.partitionBy(*names).orderBy(*_sort_key(order)).rowsBetween(
            Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long")

    result = ordinary.withColumn(name, before(*keys))
    if cut is None:
        return result

    parts = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*keys, _PART).agg(F.sum(value).alias("total"))
               .withColumn(_CARRY, F.coalesce(F.sum("total").over(parts), F.lit(0)))
               .drop("total"))
    hot = (null_safe_join(cut, F.broadcast(offsets), [*keys, _PART])
           .withColumn(name, before(*keys, _PART) + F.col(_CARRY)))
    return result.unionByName(hot.drop(_PART, _CARRY))
