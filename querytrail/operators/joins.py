"""Equi-joins in which a NULL key matches a NULL key.

No side is marked for broadcast: frames read several times are written first, so the planner
knows their bytes and broadcasts below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Tuning parameter: a key with more rows than this on the right is joined by itself.
HOT_ROWS = 5_000_000
# Buckets of mixed keys that are counted before any key is.
BUCKETS = 1 << 16
KEY = "_key"
SESSION_KEY = "_session_key"  # the key of JOB_ID in a table that is bucketed by it


def key_of(*names: str) -> Column:
    """One text that is never NULL and differs wherever the values (or their being NULL) do."""
    return F.concat(*[F.when(F.col(n).isNull(), "-").otherwise(F.concat(
        F.length(F.col(n).cast("string")).cast("string"), F.lit(":"), F.col(n).cast("string")))
        for n in names])


def keyed(df: DataFrame, *names: str, key: str = KEY) -> DataFrame:
    """``df`` with one key column, on which grouping, windows and joins share an exchange."""
    return df.withColumn(key, key_of(*names))


def session_keyed(df: DataFrame, key: str = KEY) -> DataFrame:
    """``df`` with the key of JOB_ID; a bucketed table brings it along and keeps its buckets."""
    return (df.withColumn(key, F.col(SESSION_KEY)) if SESSION_KEY in df.columns
            else keyed(df, "JOB_ID", key=key))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """Join on ``keys`` with ``<=>``; the result keeps the left key columns.

    The big side is shuffled straight into the join, so adaptive execution can
    split a hot key of the left side (inner, left, left_semi, left_anti).
    """
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    condition = reduce(lambda a, b: a & b,
                       [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"_right_{k}" for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """``keys`` and ``rows`` of every key with more than ``most`` rows, or None if there is none.

    Rows are first counted per bucket of mixed keys, at most BUCKETS small rows a task however
    many keys there are. A key is in one bucket, so buckets of up to ``most`` rows hold no hot
    key; only rows of the others are counted by key. Exact: buckets that fill up by many small
    keys cost time, never a key.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    full = stored(df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("rows"))
                  .where(F.col("rows") > most).select("_bucket"))
    if full.isEmpty():
        return None
    # At most BUCKETS whole numbers: small by definition.
    suspects = df.select(*keys).withColumn("_bucket", bucket).join(
        F.broadcast(full), "_bucket", "left_semi")
    hot = stored(suspects.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
                 .where(F.col("rows") > most))
    return None if hot.isEmpty() else hot


def fan_out_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join to a side that may hold very many rows for one key.

    A left outer join cannot be split on its right side. ``hot_keys`` finds the keys with more
    than ``hot_rows`` rows on the right; usually there are none and this is a plain left
    join. Rows with a hot key have a partner, so for them an inner join gives the same rows,
    and adaptive execution may split either side of it.
    """
    found = hot_keys(right, keys, hot_rows)
    if found is None:
        return null_safe_join(left, right, keys)
    hot = found.select(*keys)
    ordinary = null_safe_join(null_safe_join(left, hot, keys, "left_anti"),
                              null_safe_join(right, hot, keys, "left_anti"), keys)
    spread = null_safe_join(null_safe_join(left, hot, keys, "left_semi"),
                            null_safe_join(right, hot, keys, "left_semi"), keys, "inner")
    return ordinary.unionByName(spread)
