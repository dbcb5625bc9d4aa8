"""Run a whole study over CSV files.

    spark-submit querytrail/run.py STUDY --input FOLDER --output FOLDER

Studies and the files they read from the input folder (any that is a folder of
part files works as well):

    clean       queries, responses, job_ads, skills, industry, areas (those present)
    behaviour   queries_clean
    effect      queries_clean, responses_clean, industry
    mismatch    queries_clean, skills_clean, industry_clean, job_ads_clean
    explore     skills_clean, industry_clean, job_ads_clean

Each study writes its tables as CSV into the output folder, in place of those of an earlier
run; ``clean`` also writes the
``*_clean`` tables as Parquet, which the others read where they find them, so its output
folder is their input folder. The queries also come bucketed by session, so that ``behaviour``
and ``effect`` read them without a shuffle.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Sequence

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.errors import AnalysisException  # noqa: E402

from querytrail.functions.timecols import as_long, as_number  # noqa: E402
from querytrail.operators.plotdata import histogram  # noqa: E402
from querytrail.plans import audit, clean, effect, jobs, sessions, skills  # noqa: E402
from querytrail.session import build_session, sized_for, stored  # noqa: E402
from querytrail.sources import buckets, logs  # noqa: E402
from querytrail.sources.results import ResultFolder  # noqa: E402

Load = Callable[..., DataFrame]
NUMBERS = ("JOB_ID", "MESSAGE_ID", "CV_ID", "QUERY_COUNTER", "TIMESTAMP", "RESPONSE_TYPE")


def _numeric(df: DataFrame, columns: Sequence[str], cast=as_long) -> DataFrame:
    return df.withColumns({c: cast(F.col(c)) for c in columns if c in df.columns})


def _query_tables(raw: DataFrame) -> dict[str, DataFrame]:
    log = raw  # written when its rows were numbered
    return {
        "queries_clean": clean.clean_query_log(log),
        "audit_counter_counts": audit.flag_counts(audit.audit_counter(log), "counter_ok"),
        "audit_time_counts": audit.flag_counts(audit.audit_time_sorted(log), "backwards"),
        "audit_time_by_counter_counts":
            audit.flag_counts(audit.audit_time_by_counter(log), "backwards"),
    }


def _skill_tables(raw: DataFrame) -> dict[str, DataFrame]:
    tags = clean.clean_skills(raw)
    return {"skills_clean": tags, "skills_per_job": skills.skills_per_job(tags),
            "skills_frequency": skills.skill_frequency(tags)}


LOG_OPTIONS = {"snake": False, "blank_as_null": NUMBERS, "row_id": True}
# Raw file, how to read it, what to make of it.
RAW_FILES = (
    ("queries", LOG_OPTIONS, _query_tables),
    ("responses", LOG_OPTIONS, lambda raw: {"responses_clean": clean.clean_response_log(raw)}),
    ("job_ads", {}, lambda raw: {"job_ads_clean": clean.clean_job_ads(raw)}),
    ("skills", {}, _skill_tables),
    ("industry", {}, lambda raw: {"industry_clean": clean.clean_industry(raw)}),
    ("areas", {}, lambda raw: {"areas_clean": clean.split_locations(raw)}),
)


def clean_study(load: Load) -> dict[str, DataFrame]:
    """Cleaned tables of whichever raw files there are, and the query-log audits."""
    tables: dict[str, DataFrame] = {}
    for name, options, make in RAW_FILES:
        try:
            raw = load(name, **options)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            tables.update(make(raw))
    return tables


def _clean_log(load: Load, name: str) -> DataFrame:
    """A cleaned log; its row ids were written with it."""
    return _numeric(load(name, snake=False), ["row_id"])


def _session_log(load: Load) -> DataFrame:
    """The cleaned queries, bucketed by session where the cleaning left them so."""
    return _numeric(load("queries_clean", bucketed=True, snake=False), ["row_id"])


def behaviour_study(load: Load) -> dict[str, DataFrame]:
    log = _session_log(load)
    summary = stored(sessions.session_summary(log))
    filtered = sessions.query_filtered(sessions.query_features(log))
    return {
        "session_summary": summary,
        "summary_stats": sessions.summary_stats(summary),
        "boolean_query_stats": sessions.boolean_query_stats(filtered),
        "session_type_stats": sessions.session_type_stats(summary),
        "duration_query_correlation": sessions.duration_query_correlation(summary),
        "duration_query_trend": sessions.duration_query_trend(summary),
        "hist_queries_per_session": histogram(summary, F.col("n_queries"), 25, within=(1, 50),
                                              centre=True),
        "hist_unique_tokens": histogram(summary, F.col("unique_token_count"), 25),
        "hist_duration_by_type": histogram(summary, F.col("session_duration_min"), 30,
                                           by=["session_type"]),
    }


def effect_study(load: Load) -> dict[str, DataFrame]:
    table = stored(effect.session_effectiveness(
        _session_log(load), _clean_log(load, "responses_clean"),
        load("industry", snake=False, row_id=True)))
    return {
        "session_effectiveness": table,
        "industry_efficiency": effect.industry_efficiency(table),
        "industry_efficiency_top8": effect.industry_efficiency_top(table),
        "response_share": effect.response_share(table),
        "boolean_effort_trend": effect.boolean_effort_trend(table),
        "boolean_effort_band": effect.boolean_effort_band(table),
        "boolean_group_box": effect.boolean_group_box(table),
    }


def _job_tables(load: Load) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (_numeric(load("job_ads_clean"), ["n_chars", "n_words"]),
            _numeric(load("industry_clean"), ["employee_count"], as_number),
            load("skills_clean"))


def mismatch_study(load: Load) -> dict[str, DataFrame]:
    ads, industry, tags = _job_tables(load)
    queries = load("queries_clean")
    overlap = stored(skills.skill_query_overlap(tags, queries))
    overview = stored(skills.skill_mismatch_overview(overlap))
    coverage = skills.job_skill_coverage(overlap)
    frequency = skills.skill_frequency(tags)
    concepts = skills.skill_concept_counts(tags)
    return {
        "dataset_manifest": logs.manifest({"skills": tags, "industry": industry,
                                           "jobads": ads, "queries": queries}),
        "skill_frequency": frequency,
        "skill_concept_counts": concepts,
        "skill_mismatch_overview": overview,
        "least_queried_30": skills.least_queried(overview),
        "top_common_skills": skills.top_common_skills(overview),
        "job_skill_coverage": coverage,
        "industry_skill_mismatch": skills.industry_skill_mismatch(ads, industry, coverage),
        "hist_skill_freq_log10": histogram(frequency, F.log10("n"), 40),
        "hist_concept_log10": histogram(concepts, F.log10("total_frequency"), 40),
        "hist_coverage": histogram(coverage, F.col("share_skills_queried"), 40),
    }


def explore_study(load: Load) -> dict[str, DataFrame]:
    ads, industry, tags = _job_tables(load)
    company = jobs.job_company(industry)
    weighted = stored(jobs.weighted_ads(ads, company, tags))
    by_size = jobs.weighted_ads(ads, industry, tags)
    pairs = stored(jobs.sector_skill_counts(ads, company, tags))
    per_job = skills.skills_per_job(tags)
    scored = stored(jobs.efficiency_score(jobs.job_level(ads, industry, tags)))
    return {
        "longest_ads": jobs.longest_ads(ads),
        "ad_word_profile": jobs.ad_word_profile(ads),
        "job_level": scored,
        "skill_present_counts": jobs.skill_present_counts(weighted),
        "sector_counts_top20": jobs.sector_counts_top(weighted),
        "master_skill_counts_top20": jobs.master_skill_counts_top(ads, company, tags),
        "sector_skill_counts": pairs,
        "industry_complexity": jobs.industry_complexity(weighted),
        "top_skill_jobs": skills.top_skill_jobs(tags),
        "skills_by_industry_top15": jobs.skills_by_industry_top(tags, industry),
        "skills_per_job_summary": jobs.six_numbers(per_job, "n_skills"),
        "hist_skills_per_job": histogram(per_job, F.col("n_skills"), 40),
        "industry_rare": jobs.rare_by_sector(pairs, skills.rare_skills(tags)),
        "hist_skill_freq_log10": histogram(skills.skill_frequency(tags), F.log10("n"), 50),
        "skill_freq_of_freq": skills.frequency_of_frequencies(tags),
        "complexity_by_employee_count": jobs.complexity_by(by_size, "employee_count"),
        "complexity_smooth": jobs.complexity_smooth(by_size),
        "efficiency_by_industry": jobs.efficiency_by_industry(scored),
    }


STUDIES = {"clean": clean_study, "behaviour": behaviour_study, "effect": effect_study,
           "mismatch": mismatch_study, "explore": explore_study}


def run(spark: SparkSession, study: str, source: str, target: str) -> list[str]:
    """Run one study and return the paths written.

    The study's earlier tables are replaced when all new ones are written. A run that broke
    off is taken up where it stopped if no file of the input has changed since.
    """
    given = ResultFolder(spark, source)
    given.recover()

    def load(name: str, bucketed: bool = False, **options) -> DataFrame:
        place = given.path(f"{name}.buckets")
        if bucketed and given.files.exists(place):
            return buckets.load(spark, place)
        try:
            return logs.load_parquet(spark, given.path(f"{name}.parquet"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        return logs.load_log(spark, given.path(f"{name}.csv"), **options)

    tables = STUDIES[study](load)
    typed = [name for name in tables if name.endswith("_clean")] if study == "clean" else ()
    by_session = {"queries_clean": buckets.write} if study == "clean" else None
    return logs.export(tables, target, typed, study, given.files.signature(source), by_session)


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("study", choices=STUDIES)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--input-gb", type=int, help="size of the input, to size the shuffles")
    chosen = parser.parse_args(arguments)
    settings = sized_for(chosen.input_gb * 1024 ** 3) if chosen.input_gb else None
    spark = build_session(settings=settings)
    for path in run(spark, chosen.study, chosen.input, chosen.output):
        print(path)


if __name__ == "__main__":
    main()
