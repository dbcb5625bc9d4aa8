"""Job ads, their companies and their complexity.

The master table repeats an ad for every company row and every skill. The
statistics over it weigh each ad by the number of its master rows instead of
building them, which gives the same numbers from one row per ad and company.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present
from ..operators.joins import fan_out_left_join, null_safe_join
from ..operators.ranking import top
from ..operators.smooth import smooth_curve
from ..session import stored

# The company columns a job is described by, and the weights of the
# efficiency score.
COMPANY_COLUMNS = ("job_id", "company_id", "company_name", "industry_sector_id",
                   "industry_sector_name", "industry_division_id", "industry_division_name")
WORDS_WEIGHT, SKILLS_WEIGHT = 0.5, 0.5


def longest_ads(ads: DataFrame, n: int = 10) -> DataFrame:
    return top(ads.select("job_id", "n_words", "job_title"),
               [F.desc_nulls_last("n_words"), F.asc_nulls_last("job_id")], n)


def ad_word_profile(ads: DataFrame) -> DataFrame:
    """Smallest, quartiles and largest word count."""
    q = F.percentile("n_words", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return ads.agg(F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"),
                   q.alias("q")).select(
        "min_words", F.col("q")[0].alias("q1_words"), F.col("q")[1].alias("median_words"),
        F.col("q")[2].alias("q3_words"), "max_words")


def job_company(industry: DataFrame) -> DataFrame:
    """Distinct company rows, of the columns that exist."""
    return industry.select(*present(industry, COMPANY_COLUMNS)).distinct()


def job_master(ads: DataFrame, industry: DataFrame, skills: DataFrame) -> DataFrame:
    """Ads with their companies and skills, one row per combination."""
    return fan_out_left_join(fan_out_left_join(ads, job_company(industry), ["job_id"]),
                             skills, ["job_id"])


def job_sectors(ads: DataFrame, industry: DataFrame) -> DataFrame:
    """Distinct (job, sector) pairs of the advertised jobs."""
    sectors = industry.select("job_id", "industry_sector_name").distinct()
    return null_safe_join(ads.select("job_id").distinct(), sectors, ["job_id"])


def _skill_counts(skills: DataFrame) -> DataFrame:
    return skills.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_skills"))


def weighted_ads(ads: DataFrame, details: DataFrame, skills: DataFrame) -> DataFrame:
    """Ads with their detail rows, number of skills, and number of master rows."""
    narrow = ads.select(*present(ads, ["row_id", "job_id", "job_title", "n_words", "n_chars"]))
    detailed = fan_out_left_join(narrow, details, ["job_id"])
    return (null_safe_join(detailed, _skill_counts(skills), ["job_id"])
            .withColumn("weight", F.greatest(F.coalesce("n_skills", F.lit(0)), F.lit(1))))


def _weighted_mean(value: str) -> Column:
    known = F.when(F.col(value).isNotNull(), F.col("weight"))
    return F.sum(F.col(value) * F.col("weight")) / F.sum(known)


def _distinct_with_null(column: str) -> Column:
    """Number of distinct values, NULL being one."""
    return F.count_distinct(column) + F.coalesce(
        F.max(F.col(column).isNull().cast("int")), F.lit(0))


def skill_present_counts(weighted: DataFrame) -> DataFrame:
    """Master rows with and without a skill."""
    return weighted.groupBy(F.col("n_skills").isNotNull().alias("has_skill")).agg(
        F.sum("weight").alias("n"))


def sector_counts(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("industry_sector_name").agg(F.sum("weight").alias("n"))


def sector_counts_top(weighted: DataFrame, n: int = 20) -> DataFrame:
    """The sectors with most master rows."""
    return top(sector_counts(weighted),
               [F.desc("n"), F.asc_nulls_last("industry_sector_name")], n)


def sector_skill_counts(ads: DataFrame, details: DataFrame, skills: DataFrame) -> DataFrame:
    """Master rows per sector and skill, most frequent first.

    Ads and details shrink to counted (job, sector) pairs before the join.
    """
    sectors = fan_out_left_join(ads.select("job_id"),
                                details.select("job_id", "industry_sector_name"), ["job_id"])
    pairs = sectors.groupBy("job_id", "industry_sector_name").agg(
        F.count(F.lit(1)).alias("rows"))
    known = skills.where(F.col("skill").isNotNull()).select("job_id", "skill")
    return (null_safe_join(known, pairs, ["job_id"], "inner")
            .groupBy("industry_sector_name", "skill").agg(F.sum("rows").alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_last("industry_sector_name"), "skill"))


def master_skill_counts(ads: DataFrame, details: DataFrame, skills: DataFrame) -> DataFrame:
    """Master rows per skill; the rows of ads without any skill count under NULL.

    Counted skills meet ads that are already counted per job, one row a job.
    """
    ad_rows = fan_out_left_join(ads.select("job_id"), details.select("job_id"), ["job_id"])
    per_job = ad_rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("rows"))
    tags = skills.select("job_id", "skill")
    return (fan_out_left_join(per_job, tags, ["job_id"])
            .groupBy("skill").agg(F.sum("rows").alias("n")))


def master_skill_counts_top(ads: DataFrame, details: DataFrame, skills: DataFrame,
                            n: int = 20) -> DataFrame:
    return top(master_skill_counts(ads, details, skills),
               [F.desc("n"), F.asc_nulls_last("skill")], n)


def rare_by_sector(counts: DataFrame, rare: DataFrame) -> DataFrame:
    """Sector counts of the rare skills only, most frequent first."""
    return null_safe_join(counts, rare.select("skill"), ["skill"], "left_semi").orderBy(
        F.desc("n"), F.asc_nulls_last("industry_sector_name"), "skill")


def industry_complexity(weighted: DataFrame) -> DataFrame:
    """Ad length per sector, longest first, each ad weighing as many rows as it has skills.

    The median comes from counted (sector, length) pairs, whole numbers of words of which
    there are few; ads are counted apart from it.
    """
    narrow = stored(weighted.select("industry_sector_name", "job_id", "n_words", "weight"))
    lengths = narrow.groupBy("industry_sector_name", "n_words").agg(F.sum("weight").alias("weight"))
    words = lengths.groupBy("industry_sector_name").agg(
        _weighted_mean("n_words").alias("avg_words"),
        F.percentile("n_words", F.lit(0.5), F.col("weight")).alias("median_words"))
    ads = (narrow.select("industry_sector_name", "job_id").distinct()
           .groupBy("industry_sector_name").agg(F.count(F.lit(1)).alias("n_ads")))
    return null_safe_join(words, ads, ["industry_sector_name"]).orderBy(
        F.desc_nulls_last("avg_words"), F.asc_nulls_last("industry_sector_name"))


def complexity_by(weighted: DataFrame, dimension: str) -> DataFrame:
    """Mean words, mean skills and number of ads per value of ``dimension``."""
    return weighted.groupBy(dimension).agg(
        _weighted_mean("n_words").alias("avg_words"),
        _weighted_mean("n_skills").alias("avg_skills"),
        _distinct_with_null("job_id").alias("n_ads"))


def complexity_smooth(weighted: DataFrame) -> DataFrame:
    """Smooth curve of the mean number of skills over the number of employees.

    One point per number of employees, as in the table of ``complexity_by``.
    """
    return smooth_curve(complexity_by(weighted, "employee_count"), "employee_count", "avg_skills")


def job_level(ads: DataFrame, industry: DataFrame, skills: DataFrame) -> DataFrame:
    """One row per job, title and company, with distinct skills and ad length.

    A job without skills counts one, as its missing skill is a value. Ads that
    share job and title give the length of the first one.
    """
    distinct = skills.groupBy("job_id").agg(_distinct_with_null("skill").alias("n_skills"))
    first_row = F.col("row_id") if "row_id" in ads.columns else F.col("job_id")
    first_ads = ads.groupBy("job_id", "job_title").agg(
        F.min_by("n_words", first_row).alias("n_words"),
        F.min_by("n_chars", first_row).alias("n_chars"))
    detailed = fan_out_left_join(first_ads, job_company(industry), ["job_id"])
    return null_safe_join(detailed, distinct, ["job_id"]).withColumn(
        "n_skills", F.coalesce("n_skills", F.lit(1)))


def skills_by_industry(skills: DataFrame, industry: DataFrame) -> DataFrame:
    """Mean and largest number of skills per sector; every industry row counts."""
    rows = industry.groupBy("job_id", "industry_sector_name").agg(
        F.count(F.lit(1)).alias("rows"))
    joined = fan_out_left_join(_skill_counts(skills), rows, ["job_id"]).withColumn(
        "weight", F.coalesce("rows", F.lit(1)))
    return joined.groupBy("industry_sector_name").agg(
        _weighted_mean("n_skills").alias("avg_skills"),
        F.max("n_skills").alias("max_skills"), F.sum("weight").alias("n_jobs"))


def skills_by_industry_top(skills: DataFrame, industry: DataFrame, n: int = 15) -> DataFrame:
    return top(skills_by_industry(skills, industry),
               [F.desc_nulls_last("avg_skills"), F.asc_nulls_last("industry_sector_name")], n)


def six_numbers(df: DataFrame, column: str) -> DataFrame:
    """Smallest, quartiles, mean and largest value."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"),
                  F.avg(column).alias("mean"), q.alias("q")).select(
        "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), "mean",
        F.col("q")[2].alias("q3"), "max")


def efficiency_score(level: DataFrame, names: Sequence[str] = ("n_words", "n_skills"),
                     weights: Sequence[float] = (WORDS_WEIGHT, SKILLS_WEIGHT)) -> DataFrame:
    """Weighted sum of z-scores of ad length and number of skills.

    The narrow job rows are written once: counting the words of all ads again for
    the means would cost far more.
    """
    level = stored(level)
    measures = [m for c in names for m in (F.avg(c).alias(f"mean_{c}"),
                                           F.stddev_samp(c).alias(f"sd_{c}"))]
    scale = level.agg(F.struct(*measures)).scalar()
    scaled = level.withColumn("scale", scale)
    score = sum(w * F.try_divide(F.col(c) - F.col(f"scale.mean_{c}"), F.col(f"scale.sd_{c}"))
                for c, w in zip(names, weights))
    return scaled.withColumn("efficiency_score", score).drop("scale")


def efficiency_by_industry(scored: DataFrame) -> DataFrame:
    """Mean score per sector, highest first; one missing score makes the mean missing."""
    score = F.col("efficiency_score")
    return scored.groupBy("industry_sector_name").agg(
        F.when(F.count_if(score.isNull()) == 0, F.avg(score)).alias("avg_efficiency_score")).orderBy(
            F.desc_nulls_last("avg_efficiency_score"), F.asc_nulls_last("industry_sector_name"))
