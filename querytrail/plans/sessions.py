"""Search behaviour per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.timecols import as_number, fix_timestamp_units
from ..operators.joins import SESSION_KEY, null_safe_join
from ..operators.plotdata import linear_trend, quantiles
from ..session import stored

# Session limits in minutes, and the names of the session types.
SHORTEST_MIN, LONGEST_MIN = 1, 240
MATCHING_UP_TO_MIN = 60
MATCHING, RECRUITING, OTHER = "Matching", "Recruiting", "Other"


def query_features(log: DataFrame, null_text: str = "keep", fix_units: bool = False) -> DataFrame:
    """Typed log with length, boolean and wildcard use of every query.

    ``null_text="keep"`` leaves the features of a missing query NULL, ``"empty"``
    measures it as empty text.
    """
    query = F.col("QUERY") if null_text == "keep" else F.coalesce("QUERY", F.lit(""))
    time = fix_timestamp_units if fix_units else as_number
    return log.withColumns({
        "JOB_ID": F.col("JOB_ID").cast("string"),
        "QUERY_COUNTER": as_number(F.col("QUERY_COUNTER")),
        "TIMESTAMP": time(F.col("TIMESTAMP")) if "TIMESTAMP" in log.columns
        else F.lit(None).cast("double"),
        "token_count": X.word_count(query),
        "contains_boolean": X.has_boolean(query),
        "contains_wildcard": X.has_wildcard(query),
    })


def query_filtered(features: DataFrame) -> DataFrame:
    """Queries with at least one word and a positive time."""
    return features.where((F.col("token_count") > 0) & (F.col("TIMESTAMP") > 0))


def unique_tokens_per_session(log: DataFrame) -> DataFrame:
    """Distinct lower-case words per session.

    Words are made distinct per query before they are exploded; the distinct
    count itself is partitioned by (session, word), so a hot session is spread.
    """
    by = _session_of(log)
    tokens = _with_job_text(log).select(*by, F.explode(X.words(F.lower("QUERY"))).alias("token"))
    return (tokens.distinct().groupBy(*by)
            .agg(F.count(F.lit(1)).alias("unique_token_count")))


def _with_job_text(df: DataFrame) -> DataFrame:
    return df.withColumn("JOB_ID", F.col("JOB_ID").cast("string"))


def _session_of(log: DataFrame) -> list[str]:
    """What tells sessions apart: in a bucketed table the key first, so that no row is moved."""
    return [c for c in (SESSION_KEY, "JOB_ID") if c in log.columns]


def _share(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def session_measures(features: DataFrame) -> DataFrame:
    """One row of query statistics per session, whatever its length.

    First and last length are picked by the smallest and largest (counter, row
    id), which needs no sort. A missing counter sorts last.
    """
    counter, tokens = F.col("QUERY_COUNTER"), F.col("token_count")
    place = F.struct(counter.isNull(), counter, F.col("row_id"))
    return features.groupBy(*_session_of(features)).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(tokens).alias("avg_query_length"),
        F.median(tokens).alias("median_query_length"),
        _share(F.col("contains_boolean")).alias("boolean_usage_rate"),
        _share(F.col("contains_wildcard")).alias("wildcard_usage_rate"),
        F.min("TIMESTAMP").alias("session_start"),
        F.max("TIMESTAMP").alias("session_end"),
        ((F.max("TIMESTAMP") - F.min("TIMESTAMP")) / 60).alias("session_duration_min"),
        F.min_by(tokens, place).alias("first_query_len"),
        F.max_by(tokens, place).alias("last_query_len"))


def session_profile(log: DataFrame, shortest_min: float = SHORTEST_MIN,
                    longest_min: float = LONGEST_MIN, fix_units: bool = False) -> DataFrame:
    """Sessions of usual length with their measures, type and flags, but no count of words.

    Nothing is written, so a statistic of the minutes alone reads only the times.
    """
    minutes = F.col("session_duration_min")
    kept = session_measures(query_features(log, fix_units=fix_units)).where(
        minutes.between(shortest_min, longest_min))
    session_type = (F.when(minutes <= MATCHING_UP_TO_MIN, MATCHING)
                    .when(minutes <= longest_min, RECRUITING).otherwise(OTHER))
    return kept.withColumns({
        "session_type": session_type,
        "used_boolean": F.col("boolean_usage_rate") > 0,
        "used_wildcard": F.col("wildcard_usage_rate") > 0,
    })


def session_summary(log: DataFrame, shortest_min: float = SHORTEST_MIN,
                    longest_min: float = LONGEST_MIN, fix_units: bool = False) -> DataFrame:
    """The profile with the distinct words of each session."""
    kept = stored(session_profile(log, shortest_min, longest_min, fix_units))
    # Only words of the sessions kept are taken apart and shuffled.
    own = _with_job_text(log).select(*_session_of(log), "QUERY")
    if SESSION_KEY in log.columns:
        tokens = unique_tokens_per_session(own.join(kept.select(SESSION_KEY), SESSION_KEY, "left_semi"))
        return kept.join(tokens.drop("JOB_ID"), SESSION_KEY, "left").drop(SESSION_KEY)
    own = null_safe_join(own, kept.select("JOB_ID"), ["JOB_ID"], "left_semi")
    return null_safe_join(kept, unique_tokens_per_session(own), ["JOB_ID"])


def summary_stats(sessions: DataFrame) -> DataFrame:
    """Study-wide means, medians and spread over sessions.

    Lengths are whole or half numbers of words, so their medians are of few values; minutes
    are not, so theirs is found by rank.
    """
    minutes = quantiles(sessions, F.col("session_duration_min"), [0.5]).select(
        F.col("q")[0].alias("median_session_duration"))
    return sessions.agg(
        F.avg("n_queries").alias("avg_queries_per_session"),
        F.median("n_queries").alias("median_queries_per_session"),
        F.stddev_samp("n_queries").alias("sd_queries"),
        F.avg("boolean_usage_rate").alias("avg_boolean_rate"),
        F.avg("wildcard_usage_rate").alias("avg_wildcard_usage"),
        F.avg("avg_query_length").alias("avg_query_length"),
        F.median("median_query_length").alias("median_query_length"),
        F.avg("session_duration_min").alias("avg_session_duration")).withColumn(
            "median_session_duration", minutes.scalar())


def boolean_query_stats(filtered: DataFrame) -> DataFrame:
    """How many queries use a boolean operator."""
    flag = F.col("contains_boolean")
    return filtered.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(flag).alias("boolean_queries"),
        F.count_if(~flag).alias("non_boolean_queries"),
        (F.avg(flag.cast("int")) * 100).alias("pct_boolean"))


def session_type_stats(sessions: DataFrame) -> DataFrame:
    """Duration statistics per session type."""
    sessions = stored(sessions.select("session_type", "session_duration_min"))
    middle = quantiles(sessions, F.col("session_duration_min"), [0.5], ["session_type"]).select(
        "session_type", F.col("q")[0].alias("median_duration"))
    stats = sessions.groupBy("session_type").agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.avg("session_duration_min").alias("mean_duration"),
        F.stddev_samp("session_duration_min").alias("sd_duration"))
    return null_safe_join(stats, middle, ["session_type"]).select(
        "session_type", "n_sessions", "mean_duration", "median_duration", "sd_duration")


def duration_query_correlation(sessions: DataFrame) -> DataFrame:
    """Pearson correlation of session length and number of queries."""
    return sessions.agg(
        F.corr("session_duration_min", F.col("n_queries").cast("double")).alias("correlation"))


def duration_query_trend(sessions: DataFrame) -> DataFrame:
    return linear_trend(sessions, "session_duration_min", "n_queries")
