"""The queries that can be run by name over a folder of tables.

Doubles are rounded to six places here, and only here, because sums of doubles
differ in their last digits with the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns
from ..functions.timecols import as_number, datetime_text, parse_datetime
from ..operators.plotdata import histogram
from ..session import scratch_path, stored
from ..sources import adapters as A
from ..sources import buckets, logs, results
from . import audit, clean, effect, jobs, sessions, skills

PLACES = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, PLACES).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else f.name
                       for f in df.schema.fields])


def query(name: str) -> Callable:
    """Register a function of the given tables under ``name``."""
    def register(build: Callable[[A.Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: rounded(build(A.Tables(spark, folder)))
        return build
    return register


# ---- cleaned inputs that several queries start from

def _log(t: A.Tables) -> DataFrame:
    """The query log as a table: the jobs below read it more than once, and it is
    far smaller than the texts it is derived from."""
    return stored(A.query_log(t))


def _log_with_empty_column(t: A.Tables) -> DataFrame:
    return _log(t).withColumn("EMPTY_COL", F.lit(None).cast("string"))


def _ads(t: A.Tables) -> DataFrame:
    return clean.clean_job_ads(A.job_ads(t))


def _ad_sizes(t: A.Tables) -> DataFrame:
    return _ads(t).select("row_id", "job_id", "job_title", "n_words", "n_chars")


def _skills(t: A.Tables) -> DataFrame:
    return clean.clean_skills(A.skills_raw(t))


def _industry(t: A.Tables) -> DataFrame:
    return clean.clean_industry(A.industry_raw(t))


def _summary(t: A.Tables) -> DataFrame:
    return sessions.session_summary(_log(t))


def _bucketed_log(t: A.Tables) -> DataFrame:
    """The query log as one study hands it on to the next.

    It is written once, straight into its buckets; its sessions are counted without the texts.
    """
    path = scratch_path(t.spark, "buckets")
    buckets.write(A.query_log(t), path, counted=A.event_log(t))
    return buckets.load(t.spark, path)


def _profile(t: A.Tables) -> DataFrame:
    return sessions.session_profile(A.query_log(t))


def _lengths(t: A.Tables) -> DataFrame:
    """Minutes and number of queries per session, for which no query need be read."""
    log = A.event_log(t).withColumn("QUERY", F.lit(None).cast("string"))
    return sessions.session_profile(log).select(
        "JOB_ID", "n_queries", "session_duration_min", "session_type")


def _features(t: A.Tables) -> DataFrame:
    return sessions.query_features(A.query_log(t))


def _effectiveness(t: A.Tables) -> DataFrame:
    return effect.session_effectiveness(_log(t), A.response_log(t), A.industry_session(t))


def _valid(t: A.Tables) -> DataFrame:
    return effect.valid_sessions(effect.session_times(A.event_log(t)))


def _overlap(t: A.Tables) -> DataFrame:
    return skills.skill_query_overlap(_skills(t), A.job_queries(t))


def _overview(t: A.Tables) -> DataFrame:
    return skills.skill_mismatch_overview(_overlap(t))


def _coverage(t: A.Tables) -> DataFrame:
    return skills.job_skill_coverage(_overlap(t))


def _by_company(t: A.Tables) -> DataFrame:
    return jobs.weighted_ads(_ad_sizes(t), jobs.job_company(_industry(t)), _skills(t))


def _level(t: A.Tables) -> DataFrame:
    return jobs.job_level(_ad_sizes(t), _industry(t), _skills(t))


# ---- loading, cleaning, audits

@query("dataset_manifest")
def _(t):
    return logs.manifest({"skills": _skills(t), "industry": _industry(t),
                          "jobads": _ads(t), "queries": A.job_queries(t)})


@query("load_log_roundtrip")
def _(t):
    path = scratch_path(t.spark, "query-log")
    logs.write_csv(A.query_log(t), path)
    return logs.load_log(t.spark, path)


@query("export_roundtrip")
def _(t):
    overlap = stored(_overlap(t))
    coverage = skills.job_skill_coverage(overlap)
    tags = _skills(t)
    tables = {
        "skill_frequency": skills.skill_frequency(tags),
        "skill_concept_counts": skills.skill_concept_counts(tags),
        "skill_mismatch_overview": skills.skill_mismatch_overview(overlap),
        "job_skill_coverage": coverage,
        "industry_skill_mismatch":
            skills.industry_skill_mismatch(_ad_sizes(t), _industry(t), coverage),
        "skills_per_job": skills.skills_per_job(tags),
        "job_ads": _ad_sizes(t),
        "industry": _industry(t),
        "locations": clean.split_locations(A.area_raw(t)),
    }
    measured = {
        "skill_frequency": "n", "skill_concept_counts": "total_frequency",
        "skill_mismatch_overview": "n_jobs_with_skill",
        "job_skill_coverage": "n_skills_queried", "industry_skill_mismatch": "n_jobs",
        "skills_per_job": "n_skills", "job_ads": "n_words", "industry": "employee_count",
        "locations": "postal_code",
    }
    folder = scratch_path(t.spark, "export")
    logs.export(tables, folder, typed=["job_ads", "locations"])

    def totals(name: str, back: DataFrame) -> DataFrame:
        number = as_number(F.col(measured[name])).cast("long")
        return back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(number).alias("total")).select(
            F.lit(name).alias("table_name"), "n_rows", "total")

    back = [totals(name, logs.load_log(t.spark, f"{folder}/{name}.csv")) for name in tables]
    typed = logs.load_parquet(t.spark, f"{folder}/job_ads.parquet")
    back.append(totals("job_ads", typed).withColumn("table_name", F.lit("job_ads typed")))
    return reduce(DataFrame.unionByName, back)


@query("export_replaced")
def _(t):
    """A result folder after a first run over half of the jobs and a second over all."""
    folder = results.ResultFolder(t.spark, scratch_path(t.spark, "study"))
    tables = {"skills_per_job": skills.skills_per_job(_skills(t)), "industry": _industry(t),
              "job_ads": _ad_sizes(t)}
    logs.export({name: df.where("job_id % 2 = 0") for name, df in tables.items()}, folder.folder,
                ["job_ads"])
    logs.export(tables, folder.folder, ["job_ads"])
    counted = folder.rows("tables")
    measured = {"skills_per_job.csv": "n_skills", "industry.csv": "employee_count",
                "job_ads.csv": "n_words", "job_ads.parquet": "n_words"}

    def totals(file: str, number: str) -> DataFrame:
        load = logs.load_parquet if file.endswith(".parquet") else logs.load_log
        return load(t.spark, folder.path(file)).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(as_number(F.col(number)).cast("long")).alias("total")).select(
                F.lit(file).alias("table_name"), "n_rows", "total",
                F.lit(counted[file]).cast("long").alias("manifest_rows"))

    return reduce(DataFrame.unionByName, [totals(*item) for item in measured.items()])


@query("log_column_types")
def _(t):
    """The types that the cells of the written query log fit, and the values that have them.

    The written log is packed: it takes 2.4 times less room, at no cost in time.
    """
    path = scratch_path(t.spark, "query-log")
    logs.write_csv(A.query_log(t).withColumns({
        "HOUR": F.concat_ws(".", F.expr("QUERY_COUNTER % 24").cast("string"), F.lit("5")),
        "DAY": F.substring("TIMESTAMP_FORMATTED", 1, 10),
        "EVEN": F.when(F.expr("QUERY_COUNTER % 2 = 0"), "TRUE").otherwise("FALSE"),
        "CODE": F.lpad(F.expr("QUERY_COUNTER % 100").cast("string"), 4, "0")}), path, "lz4")
    log = logs.load_log(t.spark, path, snake=False, infer=True)
    kinds = {"boolean": "logical", "bigint": "integer", "double": "double", "date": "date",
             "timestamp": "datetime", "string": "text"}
    counts = log.agg(*[F.count(c).alias(c) for c in log.columns])
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit(kinds[kind]).alias("column_type"),
        F.col(c).alias("n_values")) for c, kind in log.dtypes])))


@query("parsed_datetimes")
def _(t):
    """The time of every event, written in one of twelve ways and read back."""
    ts = F.col("ts").cast("timestamp")
    layouts = ("yyyy-MM-dd HH:mm:ss", "yyyyMMddHHmmss", "yyMMddHHmmss", "yy-M-d H:m:s",
               "yyyyMMdd HHmmss", "yyyy.MM.dd HH.mm.ss", "yyyy, MMM d, HH:mm:ss",
               "yyyy MMMM d HH'h'mm'm'ss's'", "yyyy/MM/dd hh:mm:ss a", "yyyy-MM-dd'T'HH:mm:ss'Z'",
               "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "'on' yyyy_MM_dd 'at' HH_mm_ss")
    kind = F.col("event_id") % len(layouts)
    written = F.coalesce(*[F.when(kind == i, F.date_format(ts, layout))
                           for i, layout in enumerate(layouts)])
    return t.events.select("event_id", datetime_text(parse_datetime(written)).alias("parsed"))


@query("clean_headers")
def _(t):
    """Customers under headers as a Danish sheet would have them, with the names made clean."""
    headers = {"c_custkey": "Kunde #", "c_name": "Navn på kunden", "c_nationkey": "Område-nr.",
               "c_acctbal": "Størrelse %"}
    named = columns.clean_names(t.customer.select(
        *[F.col(c).alias(h) for c, h in headers.items()], F.col("c_custkey").alias("Kunde (#)")))
    return named.groupBy("omrade_nr").agg(
        F.sum("kunde_number").alias("kunde_number"), F.max("navn_pa_kunden").alias("navn_pa_kunden"),
        F.sum("storrelse_percent").alias("storrelse_percent"),
        F.count("kunde_number_2").alias("kunde_number_2"))


@query("clean_query_log")
def _(t):
    return clean.clean_query_log(_log_with_empty_column(t))


@query("clean_query_log_exact")
def _(t):
    return clean.clean_query_log(_log_with_empty_column(t), mode="exact")


@query("audit_counter")
def _(t):
    return audit.audit_counter(A.event_log(t))


@query("audit_counter_counts")
def _(t):
    return audit.flag_counts(audit.audit_counter(A.event_log(t)), "counter_ok")


@query("audit_time_sorted")
def _(t):
    return audit.audit_time_sorted(A.event_log(t))


@query("audit_time_sorted_counts")
def _(t):
    return audit.flag_counts(audit.audit_time_sorted(A.event_log(t)), "backwards")


@query("audit_time_by_counter")
def _(t):
    return audit.audit_time_by_counter(stored(A.event_log(t)))


@query("audit_time_by_counter_counts")
def _(t):
    return audit.flag_counts(audit.audit_time_by_counter(stored(A.event_log(t))), "backwards")


@query("clean_response_log")
def _(t):
    return clean.clean_response_log(A.response_log(t))


@query("clean_job_ads")
def _(t):
    return _ads(t)


@query("clean_skills")
def _(t):
    return _skills(t)


@query("clean_industry")
def _(t):
    return _industry(t)


@query("split_locations")
def _(t):
    return clean.split_locations(A.area_raw(t))


# ---- search behaviour

@query("query_features")
def _(t):
    return _features(t)


@query("query_filtered")
def _(t):
    return sessions.query_filtered(_features(t))


@query("unique_tokens_per_session")
def _(t):
    return sessions.unique_tokens_per_session(A.query_log(t))


@query("session_summary")
def _(t):
    return _summary(t)


@query("summary_stats")
def _(t):
    return sessions.summary_stats(stored(_profile(t)))


@query("boolean_query_stats")
def _(t):
    return sessions.boolean_query_stats(sessions.query_filtered(_features(t)))


@query("session_type_stats")
def _(t):
    return sessions.session_type_stats(_lengths(t))


@query("duration_query_correlation")
def _(t):
    return sessions.duration_query_correlation(_lengths(t))


@query("duration_query_trend")
def _(t):
    return sessions.duration_query_trend(_lengths(t))


# ---- effort and response

@query("industry_one")
def _(t):
    return effect.industry_one(A.industry_session(t))


@query("response_summary")
def _(t):
    return effect.response_summary(A.response_log(t))


@query("session_bounds")
def _(t):
    return effect.session_bounds(effect.session_times(A.event_log(t))).drop("rows")


@query("valid_queries")
def _(t):
    log = _log(t)
    return effect.only_valid(effect.effort_features(log),
                             effect.valid_sessions(effect.session_times(log)))


@query("valid_responses")
def _(t):
    return effect.only_valid(effect.response_summary(A.response_log(t)), _valid(t))


@query("valid_industry")
def _(t):
    return effect.only_valid(effect.industry_one(A.industry_session(t)), _valid(t))


@query("query_reformulation")
def _(t):
    return effect.query_reformulation(_log(t), A.response_log(t), A.industry_session(t))


@query("time_to_response")
def _(t):
    return effect.time_to_response(A.event_log(t), A.response_log(t))


@query("session_effectiveness")
def _(t):
    return _effectiveness(t)


@query("session_effectiveness_bucketed")
def _(t):
    return effect.session_effectiveness(_bucketed_log(t), A.response_log(t), A.industry_session(t))


@query("session_summary_bucketed")
def _(t):
    return sessions.session_summary(_bucketed_log(t))


@query("industry_efficiency")
def _(t):
    return effect.industry_efficiency(_effectiveness(t))


@query("industry_efficiency_top8")
def _(t):
    return effect.industry_efficiency_top(_effectiveness(t))


@query("response_share")
def _(t):
    return effect.response_share(_effectiveness(t))


@query("boolean_effort_trend")
def _(t):
    return effect.boolean_effort_trend(_effectiveness(t))


@query("boolean_effort_band")
def _(t):
    return effect.boolean_effort_band(_effectiveness(t))


@query("boolean_group_box")
def _(t):
    return effect.boolean_group_box(_effectiveness(t))


# ---- skills and mismatch

@query("skills_per_job")
def _(t):
    return skills.skills_per_job(_skills(t))


@query("skill_freq")
def _(t):
    return skills.skill_frequency(_skills(t))


@query("top_skills")
def _(t):
    return skills.top_skills(_skills(t))


@query("top_skill_jobs")
def _(t):
    return skills.top_skill_jobs(_skills(t))


@query("rare_skills")
def _(t):
    return skills.rare_skills(_skills(t))


@query("skill_freq_of_freq")
def _(t):
    return skills.frequency_of_frequencies(_skills(t))


@query("skill_concept_counts")
def _(t):
    return skills.skill_concept_counts(_skills(t))


@query("query_terms")
def _(t):
    return skills.query_terms(A.job_queries(t))


@query("skill_query_overlap")
def _(t):
    return _overlap(t)


@query("skill_mismatch_overview")
def _(t):
    return _overview(t)


@query("least_queried_30")
def _(t):
    return skills.least_queried(_overview(t))


@query("top_common_skills")
def _(t):
    return skills.top_common_skills(_overview(t))


@query("job_skill_coverage")
def _(t):
    return _coverage(t)


@query("industry_skill_mismatch")
def _(t):
    return skills.industry_skill_mismatch(_ad_sizes(t), _industry(t), _coverage(t))


# ---- job ads and companies

@query("longest_ads")
def _(t):
    return jobs.longest_ads(_ads(t))


@query("ad_word_profile")
def _(t):
    return jobs.ad_word_profile(_ads(t))


@query("job_company")
def _(t):
    return jobs.job_company(_industry(t))


@query("job_master")
def _(t):
    return jobs.job_master(_ads(t).drop("row_id"), _industry(t), _skills(t))


@query("job_level")
def _(t):
    return _level(t)


@query("skill_present_counts")
def _(t):
    return jobs.skill_present_counts(_by_company(t))


@query("sector_counts_top20")
def _(t):
    return jobs.sector_counts_top(_by_company(t))


@query("sector_skill_counts")
def _(t):
    return jobs.sector_skill_counts(_ad_sizes(t), jobs.job_company(_industry(t)), _skills(t))


@query("master_skill_counts_top20")
def _(t):
    return jobs.master_skill_counts_top(_ad_sizes(t), jobs.job_company(_industry(t)), _skills(t))


@query("industry_rare")
def _(t):
    counts = jobs.sector_skill_counts(_ad_sizes(t), jobs.job_company(_industry(t)), _skills(t))
    return jobs.rare_by_sector(counts, skills.rare_skills(_skills(t)))


@query("industry_complexity")
def _(t):
    return jobs.industry_complexity(_by_company(t))


@query("skills_by_industry_top15")
def _(t):
    return jobs.skills_by_industry_top(_skills(t), _industry(t))


@query("skills_per_job_summary")
def _(t):
    return jobs.six_numbers(skills.skills_per_job(_skills(t)), "n_skills")


@query("complexity_by_employee_count")
def _(t):
    weighted = jobs.weighted_ads(_ad_sizes(t), _industry(t), _skills(t))
    return jobs.complexity_by(weighted, "employee_count")


@query("complexity_smooth")
def _(t):
    weighted = jobs.weighted_ads(_ad_sizes(t), _industry(t), _skills(t))
    return jobs.complexity_smooth(weighted)


@query("complexity_by_location")
def _(t):
    places = A.job_locations(t, clean.split_locations(A.area_raw(t)))
    return jobs.complexity_by(jobs.weighted_ads(_ad_sizes(t), places, _skills(t)),
                              "location_name")


@query("efficiency_score")
def _(t):
    return jobs.efficiency_score(_level(t))


@query("efficiency_by_industry")
def _(t):
    return jobs.efficiency_by_industry(jobs.efficiency_score(_level(t)))


# ---- histogram data

@query("hist_queries_per_session")
def _(t):
    return histogram(_lengths(t), F.col("n_queries"), 25, within=(1, 50), centre=True)


@query("hist_unique_tokens")
def _(t):
    return histogram(_summary(t), F.col("unique_token_count"), 25)


@query("hist_duration_by_type")
def _(t):
    return histogram(_lengths(t), F.col("session_duration_min"), 30, by=["session_type"])


@query("hist_skill_freq_log10")
def _(t):
    return histogram(skills.skill_frequency(_skills(t)), F.log10("n"), 40)


@query("hist_skill_freq_log10_50")
def _(t):
    return histogram(skills.skill_frequency(_skills(t)), F.log10("n"), 50)


@query("hist_concept_log10")
def _(t):
    return histogram(skills.skill_concept_counts(_skills(t)), F.log10("total_frequency"), 40)


@query("hist_coverage")
def _(t):
    return histogram(_coverage(t), F.col("share_skills_queried"), 40)


@query("hist_skills_per_job")
def _(t):
    return histogram(skills.skills_per_job(_skills(t)), F.col("n_skills"), 40)
