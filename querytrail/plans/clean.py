"""Cleaning of the logs and of the job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.columns import present, without_empty_columns
from ..functions.timecols import as_integer, as_number, datetime_text, parse_datetime
from ..operators.joins import null_safe_join
from ..operators.repeats import MARK, keep_repeating_rows, row_mark, without_exact_copies
from ..session import stored

# The columns that make a row usable, name a session, or describe
# when a query was sent rather than what it says.
QUERY_ESSENTIALS = ("JOB_ID", "TIMESTAMP", "QUERY_COUNTER")
RESPONSE_ESSENTIALS = ("JOB_ID", "CV_ID", "TIMESTAMP", "RESPONSE_TYPE")
SESSION_COLUMNS = ("JOB_ID", "MESSAGE_ID")
TIMING_COLUMNS = ("TIMESTAMP", "TIMESTAMP_FORMATTED", "QUERY_COUNTER")
ROW_ID = "row_id"


def _repeats(df: DataFrame, mode: str, anchor: str) -> DataFrame:
    if mode == "exact":
        return without_exact_copies(df, ROW_ID)
    return keep_repeating_rows(df, ROW_ID, anchor if anchor in df.columns else None)


def _with_datetime(df: DataFrame) -> DataFrame:
    if "TIMESTAMP_FORMATTED" not in df.columns:
        return df
    return df.withColumn("TIMESTAMP_FORMATTED", parse_datetime(F.col("TIMESTAMP_FORMATTED")))


def clean_query_log(log: DataFrame, mode: str = "any_column",
                    anchor: str = "MESSAGE_ID") -> DataFrame:
    """Usable rows of the query log as lower-case text.

    Rows in which every value is new are dropped (``mode="any_column"``: the
    duplicates themselves stay) or exact copies are (``mode="exact"``); then rows
    without an essential value, columns without any value, and sessions in which
    all rows say the same, which includes every session of a single row.
    """
    kept = _with_datetime(_repeats(log, mode, anchor))
    usable = without_empty_columns(kept.dropna(subset=present(kept, QUERY_ESSENTIALS)))

    lowered = usable.select(
        *[ROW_ID] if ROW_ID in usable.columns else [],
        *[F.lower(datetime_text(F.col(c)) if c == "TIMESTAMP_FORMATTED"
                  else F.col(c).cast("string")).alias(c)
          for c in usable.columns if c != ROW_ID])
    # Written first: the planner then knows whether the log must be shuffled for them.
    alike = stored(single_content_sessions(lowered))
    return null_safe_join(lowered, alike, present(lowered, SESSION_COLUMNS), "left_anti")


def single_content_sessions(log: DataFrame) -> DataFrame:
    """Sessions whose rows agree in everything but time and counter."""
    session = present(log, SESSION_COLUMNS)
    content = [c for c in log.columns
               if c not in (*SESSION_COLUMNS, *TIMING_COLUMNS, ROW_ID)]
    if not content:
        return log.select(*session).distinct()
    # Rows that agree have the same mark, so contents are compared only where all marks agree.
    marks = log.select(*session, row_mark(log, content).alias(MARK)).groupBy(*session).agg(
        F.min(MARK).alias("least"), F.max(MARK).alias("most"), F.count(F.lit(1)).alias("rows"))
    alike = stored(marks.where(F.col("least") == F.col("most")).select(*session, "rows"))
    several = alike.where(F.col("rows") > 1).select(*session)
    # All rows agree if the least and the greatest do; in a struct NULL is a value.
    row = F.struct(*content)
    agreed = (null_safe_join(log, several, session, "left_semi")
              .groupBy(*session).agg(F.min(row).alias("least"), F.max(row).alias("most"))
              .where(F.col("least") == F.col("most")).select(*session))
    return alike.where(F.col("rows") == 1).select(*session).union(agreed)


def clean_response_log(log: DataFrame, mode: str = "any_column",
                       anchor: str = "RESPONSE_TYPE") -> DataFrame:
    """Usable rows of the response log; essentials are checked before repeats."""
    usable = log.dropna(subset=present(log, RESPONSE_ESSENTIALS))
    return without_empty_columns(_with_datetime(_repeats(usable, mode, anchor)))


def clean_job_ads(ads: DataFrame) -> DataFrame:
    """Ad text without links, its length in characters and words, and a title."""
    cleaned = ads.withColumn("text", X.clean_ad_text(F.col("text")))
    text = F.col("text")
    return cleaned.withColumns({
        "n_chars": F.char_length(text),
        "n_words": X.word_count(text),
        "job_title_raw": X.match_or_null(text, X.TITLE),
        "job_title": X.squish(X.match_or_null(text, X.TITLE)),
    })


def clean_skills(skills: DataFrame) -> DataFrame:
    """Distinct lower-case skill tags per job, without missing ones.

    Only an exact ``NA`` is a missing mark: it is looked for before lower-casing.
    """
    tag = F.lower(F.nullif(X.trim_space(F.col("skill")), F.lit(X.MISSING_MARK)))
    return skills.withColumn("skill", tag).where(F.col("skill") != "").distinct()


def clean_industry(industry: DataFrame) -> DataFrame:
    """Distinct company rows with the first number of the employee range."""
    size = F.nullif(X.trim_space(F.col("employee_count")), F.lit(X.MISSING_MARK))
    return industry.select(
        "job_id", "company_id", "company_name", "industry_sector_name",
        as_number(X.match_or_null(size, X.FIRST_NUMBER)).alias("employee_count")).distinct()


def split_locations(areas: DataFrame) -> DataFrame:
    """Leading postal code and the rest of the name.

    A code range keeps its whole text as the city and its first code as the code.
    """
    name = F.col("location_name")
    return areas.select(
        "location_id",
        as_integer(X.match_or_null(name, X.LEADING_DIGITS)).alias("postal_code"),
        X.squish(F.regexp_replace(name, X.LEADING_POSTAL_CODE, "")).alias("city_full"))
