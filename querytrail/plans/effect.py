"""Search effort, reformulation and time to a positive response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.columns import pick_column
from ..functions.timecols import as_integer, fix_timestamp_units
from ..operators.joins import KEY, SESSION_KEY, session_keyed
from ..operators.ordered import MAX_GROUP_ROWS, with_previous
from ..operators.plotdata import box_statistics, linear_trend, trend_band
from ..operators.ranking import top
from ..session import stored
from .sessions import query_features

# Session limits in seconds, response limits in minutes, the
# response type that counts as positive, bounds and names of the boolean-use
# groups, names of the response states, the glue between sector names.
SHORTEST_S, LONGEST_S = 60, 14400
RESPONSE_MIN, RESPONSE_MAX = 0, 240
POSITIVE = 1
NONE_AT, LOW_UP_TO, MEDIUM_UP_TO = 0, 0.33, 0.66
NONE, LOW, MEDIUM, HIGH = "None", "Low", "Medium", "High"
ANSWERED, UNANSWERED = "At least one response", "No response"
NAME_GLUE = ";"


def _industry_names(industry: DataFrame, *by: str) -> DataFrame:
    name = pick_column(industry, ["INDUSTRY_SECTOR_NAME"])
    if name is None:
        return industry.select(*by).distinct().withColumn(
            "INDUSTRY_SECTOR_NAME", F.lit(None).cast("string"))
    firsts = (industry.select(*by, F.col(name).alias("name"), "row_id")
              .groupBy(*by, "name").agg(F.min("row_id").alias("first_row")))
    named = F.when(F.col("name").isNotNull(), F.struct("first_row", "name"))
    in_order = F.transform(F.array_sort(F.collect_list(named)), lambda pair: pair["name"])
    return firsts.groupBy(*by).agg(
        F.array_join(in_order, NAME_GLUE).alias("INDUSTRY_SECTOR_NAME"))


def _with_job_text(df: DataFrame) -> DataFrame:
    return df.withColumn("JOB_ID", F.col("JOB_ID").cast("string"))


def industry_one(industry: DataFrame) -> DataFrame:
    """One row per session: its distinct sector names, joined, first seen first.

    Each name is reduced to its first row before names are gathered, so a session
    gathers no more than the number of sectors. Without any name the text is empty.
    """
    return _industry_names(_with_job_text(industry), "JOB_ID")


def _response_measures(responses: DataFrame, *by: str) -> DataFrame:
    kind_name = pick_column(responses, ["RESPONSE_TYPE"])
    time_name = pick_column(responses, ["TIMESTAMP"])
    kind = as_integer(F.col(kind_name)) if kind_name else F.lit(None).cast("int")
    time = fix_timestamp_units(F.col(time_name)) if time_name else F.lit(None).cast("double")
    positive = F.col("kind") == POSITIVE
    return (responses.select(*by, kind.alias("kind"), time.alias("time"))
            .groupBy(*by).agg(
                F.coalesce(F.bool_or(positive), F.lit(False)).alias("any_positive_response"),
                F.count_if(positive).alias("total_positive_responses"),
                F.min(F.when(positive, F.col("time"))).alias("first_positive_resp_ts"),
                F.min("time").alias("first_any_response_ts")))


def response_summary(responses: DataFrame) -> DataFrame:
    """Positive responses and first response times per session."""
    return _response_measures(_with_job_text(responses), "JOB_ID")


def effort_features(log: DataFrame) -> DataFrame:
    """Query features with repaired times; a missing query counts as empty text."""
    return query_features(log, null_text="empty", fix_units=True).withColumn(
        "QUERY_COUNTER", as_integer(F.col("QUERY_COUNTER")))


def session_times(log: DataFrame) -> DataFrame:
    """Session and repaired time of every row; the queries are not read."""
    time = (fix_timestamp_units(F.col("TIMESTAMP")) if "TIMESTAMP" in log.columns
            else F.lit(None).cast("double"))
    carried = [c for c in log.columns if c == SESSION_KEY]
    return _with_job_text(log).select("JOB_ID", time.alias("TIMESTAMP"), *carried)


def _bounds(times: DataFrame, *by: str) -> DataFrame:
    return times.groupBy(*by).agg(
        F.min("TIMESTAMP").alias("start_ts"), F.max("TIMESTAMP").alias("end_ts"),
        (F.max("TIMESTAMP") - F.min("TIMESTAMP")).alias("duration_s"),
        F.count(F.lit(1)).alias("rows"))


def session_bounds(times: DataFrame) -> DataFrame:
    """Start, end, length in seconds and number of rows of every session."""
    return _bounds(times, "JOB_ID")


def valid_sessions(times: DataFrame, shortest_s: float = SHORTEST_S,
                   longest_s: float = LONGEST_S) -> DataFrame:
    """Bounds of the sessions of usual length, with the key on which all else joins.

    The key is never NULL, so grouping, windows and joins on it share one exchange of the
    log, which a null-safe join would not.
    """
    return _bounds(session_keyed(times), KEY, "JOB_ID").where(
        F.col("duration_s").between(shortest_s, longest_s))


def _of_valid(df: DataFrame, valid: DataFrame) -> DataFrame:
    """The rows of valid sessions, with the key."""
    return session_keyed(_with_job_text(df)).join(valid.select(KEY), KEY, "left_semi")


def only_valid(df: DataFrame, valid: DataFrame) -> DataFrame:
    """The rows of ``df`` that belong to valid sessions."""
    return _of_valid(df, valid).select(*df.columns)


def _distances(features: DataFrame, valid: DataFrame, max_group_rows: int) -> DataFrame:
    """Valid queries with the time since, and edit distance to, the previous one."""
    stepped = with_previous(
        _of_valid(features, valid), [KEY], ["QUERY_COUNTER", "row_id"],
        {"previous_time": "TIMESTAMP", "previous_query": "QUERY"}, max_group_rows, valid)
    return stepped.withColumns({
        "time_gap_s": F.col("TIMESTAMP") - F.col("previous_time"),
        "reformulation_dist": X.edit_distance(
            F.col("previous_query"), F.col("QUERY")).cast("double"),
    }).drop("previous_time", "previous_query")


def query_reformulation(log: DataFrame, responses: DataFrame, industry: DataFrame,
                        max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Every valid query with its gap, edit distance, response and industry.

    Response and industry meet first, session to session, so that the queries,
    of which one session may hold very many, are joined once.
    """
    valid = stored(valid_sessions(session_times(log)))
    queries = _distances(effort_features(log), valid, max_group_rows)
    answered = _response_measures(_of_valid(responses, valid), KEY)
    named = _industry_names(_of_valid(industry, valid), KEY)
    described = valid.select(KEY).join(answered, KEY, "left").join(named, KEY, "left")
    return queries.join(described, KEY, "left").drop(KEY, SESSION_KEY)


def _timed_responses(responses: DataFrame, valid: DataFrame) -> DataFrame:
    """Response summary of valid sessions with minutes from start to first positive."""
    summary = _response_measures(_of_valid(responses, valid), KEY)
    started = summary.join(valid.select(KEY, "JOB_ID", "start_ts"), KEY)
    minutes = (F.col("first_positive_resp_ts") - F.col("start_ts")) / 60
    return started.withColumn("time_to_first_pos_response_min",
                              F.when(minutes.between(RESPONSE_MIN, RESPONSE_MAX), minutes))


def time_to_response(log: DataFrame, responses: DataFrame) -> DataFrame:
    """Minutes to the first positive response, where that is 0 to 240."""
    valid = stored(valid_sessions(session_times(log)))
    minutes = F.col("time_to_first_pos_response_min")
    return _timed_responses(responses, valid).select("JOB_ID", minutes).where(minutes.isNotNull())


def session_effectiveness(log: DataFrame, responses: DataFrame, industry: DataFrame,
                          max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """One row per valid session: effort, response, industry, time to response.

    Response and industry are constant within a session, so they are joined after
    the queries have been aggregated, session to session.
    """
    valid = stored(valid_sessions(session_times(log)))
    sessions = _distances(effort_features(log), valid, max_group_rows).groupBy(KEY, "JOB_ID").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg("time_gap_s").alias("avg_time_gap_s"),
        F.median("time_gap_s").alias("median_time_gap_s"),
        F.avg("reformulation_dist").alias("avg_reformulation"),
        F.median("reformulation_dist").alias("median_reformulation"),
        F.avg(F.col("contains_boolean").cast("int")).alias("boolean_usage_rate"))
    answered = _timed_responses(responses, valid).select(
        KEY, "any_positive_response", "total_positive_responses",
        "time_to_first_pos_response_min")
    sectors = _industry_names(_of_valid(industry, valid), KEY).withColumnRenamed(
        "INDUSTRY_SECTOR_NAME", "industry_sector")
    return sessions.join(answered, KEY, "left").join(sectors, KEY, "left").drop(KEY)


def industry_efficiency(sessions: DataFrame) -> DataFrame:
    """Sessions and mean time to response per single industry, most sessions first."""
    minutes = F.col("time_to_first_pos_response_min")
    single = sessions.where(F.col("industry_sector").isNotNull()
                            & ~F.col("industry_sector").contains(NAME_GLUE) & (minutes > 0))
    return single.groupBy("industry_sector").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg(minutes).alias("mean_time_to_first_pos_response_min")).orderBy(
            F.desc("sessions"), "industry_sector")


def industry_efficiency_top(sessions: DataFrame, n: int = 8) -> DataFrame:
    """The industries with most sessions."""
    return top(industry_efficiency(sessions), [F.desc("sessions"), F.col("industry_sector")], n)


def response_share(sessions: DataFrame) -> DataFrame:
    """Sessions with and without a positive response; NULL where none is on record."""
    positive = F.col("any_positive_response")
    status = F.when(positive, ANSWERED).when(~positive, UNANSWERED)
    counts = sessions.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def boolean_effort_trend(sessions: DataFrame) -> DataFrame:
    """Line of the mean gap between queries on boolean use."""
    return linear_trend(sessions, "boolean_usage_rate", "avg_time_gap_s")


def boolean_effort_band(sessions: DataFrame) -> DataFrame:
    """Points of that line with its 95 % confidence band."""
    return trend_band(sessions, "boolean_usage_rate", "avg_time_gap_s")


def boolean_groups(sessions: DataFrame) -> DataFrame:
    """Sessions labelled by how much they use boolean operators."""
    rate = F.col("boolean_usage_rate")
    return sessions.withColumn(
        "boolean_group", F.when(rate == NONE_AT, NONE).when(rate <= LOW_UP_TO, LOW)
        .when(rate <= MEDIUM_UP_TO, MEDIUM).otherwise(HIGH))


def boolean_group_box(sessions: DataFrame) -> DataFrame:
    """Box-plot numbers of the time to response per boolean-use group."""
    return box_statistics(boolean_groups(sessions), "boolean_group",
                          "time_to_first_pos_response_min")
