"""Consistency checks of the query log per (job, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import as_long, as_number
from ..operators.ordered import MAX_GROUP_ROWS, with_previous
from .clean import SESSION_COLUMNS


def audit_counter(log: DataFrame) -> DataFrame:
    """Whether the counters of a session, sorted, run exactly 1, 2, ... n.

    They do if the smallest is 1, the largest is n and all are distinct: a plain
    aggregate, so no session is ever sorted.
    """
    counter = F.col("counter")
    known = log.where(F.col("QUERY_COUNTER").isNotNull()).select(
        *SESSION_COLUMNS, as_number(F.col("QUERY_COUNTER")).alias("counter"))
    n = F.count(F.lit(1))
    whole = (F.min(counter) == 1) & (F.max(counter) == n) & (F.count_distinct(counter) == n)
    return (known.groupBy(*SESSION_COLUMNS)
            .agg(F.coalesce(whole & F.bool_and(counter == F.floor(counter)), F.lit(False))
                 .alias("counter_ok")))


def audit_time_sorted(log: DataFrame) -> DataFrame:
    """Whether time runs backwards in a session *sorted by time*.

    Sorting first makes the answer no for every session, so only the sessions
    have to be listed.
    """
    return (log.where(as_number(F.col("TIMESTAMP")).isNotNull())
            .select(*SESSION_COLUMNS).distinct().withColumn("backwards", F.lit(False)))


def audit_time_by_counter(log: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Whether time runs backwards in a session when read in counter order."""
    steps = log.select(
        *SESSION_COLUMNS, "row_id", as_long(F.col("QUERY_COUNTER")).alias("counter"),
        as_number(F.col("TIMESTAMP")).alias("time")).where(F.col("time").isNotNull())
    stepped = with_previous(steps, SESSION_COLUMNS, ["counter", "row_id"],
                            {"before": "time"}, max_group_rows)
    return (stepped.groupBy(*SESSION_COLUMNS)
            .agg(F.coalesce(F.bool_or(F.col("time") < F.col("before")), F.lit(False))
                 .alias("backwards")))


def flag_counts(audit: DataFrame, flag: str) -> DataFrame:
    """Sessions per value of an audit's flag."""
    return audit.groupBy(flag).agg(F.count(F.lit(1)).alias("n"))
