"""Skill tags, query terms and the mismatch between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.joins import KEY, key_of, keyed, null_safe_join
from ..operators.ranking import top, top_with_ties
from ..session import stored
from .jobs import job_sectors

# Fixed value: a skill seen less often than this is rare.
RARE_BELOW = 20


def skills_per_job(skills: DataFrame) -> DataFrame:
    return skills.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_skills"))


def skill_frequency(skills: DataFrame) -> DataFrame:
    """Rows per skill, most frequent first."""
    return skills.groupBy("skill").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "skill")


def top_skills(skills: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent skills."""
    return top(skill_frequency(skills), [F.desc("n"), F.col("skill")], n)


def top_skill_jobs(skills: DataFrame, n: int = 20) -> DataFrame:
    """The jobs with most skills."""
    return top(skills_per_job(skills), [F.desc("n_skills"), F.asc_nulls_last("job_id")], n)


def rare_skills(skills: DataFrame, below: int = RARE_BELOW) -> DataFrame:
    return skill_frequency(skills).where(F.col("n") < below)


def frequency_of_frequencies(skills: DataFrame) -> DataFrame:
    """How many skills occur how often, rarest first."""
    return skill_frequency(skills).groupBy("n").agg(
        F.count(F.lit(1)).alias("n_skills")).orderBy("n")


def normalised_skills(skills: DataFrame) -> DataFrame:
    return skills.withColumn("skill_clean", X.concept(F.col("skill")))


def skill_concept_counts(skills: DataFrame) -> DataFrame:
    return (normalised_skills(skills).groupBy("skill_clean")
            .agg(F.count(F.lit(1)).alias("total_frequency"))
            .orderBy(F.desc("total_frequency"), "skill_clean"))


def _terms(queries: DataFrame) -> DataFrame:
    """Normalised words of the queries, distinct within each query only."""
    words = queries.select("job_id", F.explode(X.search_terms(F.col("query"))).alias("term"))
    return words.select("job_id", X.without_separators(F.col("term")).alias("term_clean"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct normalised words searched for per job.

    A word of separators only normalises to empty text, which stays a term.
    """
    return _terms(queries).distinct()


def skill_query_overlap(skills: DataFrame, queries: DataFrame) -> DataFrame:
    """Per job and skill: 1 if the skill was searched for in that job, else 0.

    Most words of the queries are no skill anywhere; they are left out first, by a join to
    the distinct concepts, whose bytes the planner knows. What is left is made distinct and
    joined on one key of job and term that is never NULL, so the join needs no exchange
    beyond that of the distinct, never multiplies rows, and a job with very many skills is
    spread over its terms.
    """
    pairs = stored(normalised_skills(skills).select("job_id", "skill", "skill_clean").distinct())
    concepts = stored(pairs.select(F.col("skill_clean").alias("term_clean")).distinct())
    searched = (_terms(queries).join(concepts, "term_clean", "left_semi")
                .select(key_of("job_id", "term_clean").alias(KEY)).distinct()
                .withColumn("found", F.lit(1)))
    return keyed(pairs, "job_id", "skill_clean").join(searched, KEY, "left").select(
        "job_id", "skill", "skill_clean", F.coalesce("found", F.lit(0)).alias("skill_queried"))


def skill_mismatch_overview(overlap: DataFrame) -> DataFrame:
    """Per skill: jobs that ask for it, that searched for it, and the share, lowest first."""
    n, queried = F.count(F.lit(1)), F.sum("skill_queried")
    return overlap.groupBy("skill", "skill_clean").agg(
        n.alias("n_jobs_with_skill"), queried.alias("n_jobs_where_queried"),
        (queried / n).alias("share_queried")).orderBy(
            "share_queried", F.desc("n_jobs_with_skill"), "skill", "skill_clean")


def least_queried(overview: DataFrame, n: int = 30) -> DataFrame:
    """The skills searched for least, the more common ones first."""
    return top(overview, [F.col("share_queried"), F.desc("n_jobs_with_skill"),
                          F.col("skill"), F.col("skill_clean")], n)


def top_common_skills(overview: DataFrame, n: int = 30) -> DataFrame:
    """The most common skills, ties included, least searched for first."""
    return top_with_ties(overview, "n_jobs_with_skill", n).orderBy(
        "share_queried", F.desc("n_jobs_with_skill"), "skill", "skill_clean")


def job_skill_coverage(overlap: DataFrame) -> DataFrame:
    """Per job: skills, skills searched for, and the share."""
    n, queried = F.count(F.lit(1)), F.sum("skill_queried")
    return overlap.groupBy("job_id").agg(
        n.alias("n_skills"), queried.alias("n_skills_queried"),
        (queried / n).alias("share_skills_queried"))


def industry_skill_mismatch(ads: DataFrame, industry: DataFrame,
                            coverage: DataFrame) -> DataFrame:
    """Mean skill coverage and number of jobs per industry, lowest first.

    Skills would only multiply the job-sector pairs, which are made distinct.
    """
    pairs = job_sectors(ads, industry)
    return (null_safe_join(pairs, coverage, ["job_id"]).groupBy("industry_sector_name")
            .agg(F.avg("share_skills_queried").alias("avg_share_skills_queried"),
                 F.count(F.lit(1)).alias("n_jobs"))
            .orderBy(F.asc_nulls_last("avg_share_skills_queried"),
                     F.asc_nulls_last("industry_sector_name")))
