"""The derived query log reads every word; plans of the queries on it."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from querytrail.operators.joins import null_safe_join
from querytrail.plans import audit, effect, jobs, skills
from querytrail.sources import adapters as A

from conftest import rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"),
                                reason="needs the given tables")


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_every_word_of_every_document_is_used(spark, folder):
    t = A.Tables(spark, folder)
    kind = (F.floor(F.col("row_id") / A.ROWS_OF_EVENT) + F.col("row_id") % A.ROWS_OF_EVENT)
    words = A.query_log(t).where("QUERY is not null").select(
        (F.floor(F.col("row_id") / A.ROWS_OF_EVENT) % t.rows("documents")).alias("doc_id"),
        F.explode(F.split(
            F.when(kind % 5 == 0, F.replace("QUERY", F.lit(" and "), F.lit(" ")))
            .when(kind % 7 == 0, F.expr("substring(QUERY, 2, length(QUERY) - 2)"))
            .otherwise(F.col("QUERY")), " ")).alias("word"))
    texts = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), A.WORD_BREAK))
                               .alias("word"))
    # A text's own word "and" may go with the glue; every other word is there as often at least.
    used = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("used"))
    given = texts.where("word <> 'and'").groupBy("doc_id", "word").agg(
        F.count(F.lit(1)).alias("given"))
    short = null_safe_join(given, used, ["doc_id", "word"]).where(
        "used is null or used < given")
    assert short.count() == 0


def executed(spark, df, settings):
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.enabled": "false"}


def log_frames(spark):
    t = A.Tables(spark, "/root/testdata/sf0.001")
    from querytrail.session import stored
    return stored(A.query_log(t)), A.response_log(t), A.industry_session(t)


def exchanges_of(plan, column):
    """Shuffles whose input still has a column."""
    blocks = re.split(r"\n(?=[ :+-]*Exchange hashpartitioning)", plan)[1:]
    return sum(column in block.split("Exchange", 2)[1] if block.count("Exchange") > 1
               else column in block for block in blocks)


@pytest.mark.parametrize("build", [effect.query_reformulation, effect.session_effectiveness])
def test_the_log_is_shuffled_once(spark, build):
    frames = log_frames(spark)
    plan = executed(spark, lambda: build(*frames), NO_BROADCAST)
    scans = [line for line in plan.split("\n") if "QUERY" in line and "Exchange" in line]
    assert plan.count("Window") >= 1
    assert not scans  # an exchange names its keys only
    assert exchanges_of(plan, "FileScan parquet [JOB_ID") + exchanges_of(plan, "QUERY") <= 2


def test_the_job_master_needs_few_shuffles(spark):
    t = A.Tables(spark, "/root/testdata/sf0.001")
    from querytrail.plans import clean
    ads, industry = clean.clean_job_ads(A.job_ads(t)), clean.clean_industry(A.industry_raw(t))
    tags = clean.clean_skills(A.skills_raw(t))
    plan = executed(spark, lambda: jobs.job_master(ads, industry, tags), NO_BROADCAST)
    # Spreading a scan that one task would read is the source's, not the job's.
    assert plan.count("Exchange ") - plan.count("REPARTITION_BY_NUM") <= 7
    assert {"text", "job_title_raw"} <= set(jobs.job_master(ads, industry, tags).columns)


def test_audits_read_no_text(spark):
    t = A.Tables(spark, "/root/testdata/sf0.001")
    plan = audit.audit_counter(A.event_log(t))._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan


def test_tables_come_sorted(frame):
    tags = frame([(1, "b"), (2, "b"), (1, "a-x"), (2, "a-x"), (3, "c"), (4, "b")],
                 "job_id int, skill string")
    queries = frame([(1, "b"), (3, "c"), (2, "a x")], "job_id int, query string")
    assert [tuple(r) for r in skills.skill_frequency(tags).collect()] == [
        ("b", 3), ("a-x", 2), ("c", 1)]
    assert [tuple(r) for r in skills.skill_concept_counts(tags).collect()] == [
        ("b", 3), ("ax", 2), ("c", 1)]
    assert [r["n"] for r in skills.frequency_of_frequencies(tags).collect()] == [1, 2, 3]
    overview = skills.skill_mismatch_overview(skills.skill_query_overlap(tags, queries))
    assert [r["skill"] for r in overview.collect()] == ["a-x", "b", "c"]
    assert [r["skill"] for r in skills.top_common_skills(overview, 2).collect()] == ["a-x", "b"]
    sectors = frame([(1, "s"), (2, "t"), (3, None)], "job_id int, industry_sector_name string")
    ads = frame([(1, 10, "x"), (2, 30, "y"), (3, 20, "z")], "job_id int, n_words int, job_title string")
    weighted = jobs.weighted_ads(ads, sectors, tags)
    assert [r["industry_sector_name"] for r in jobs.industry_complexity(weighted).collect()] == [
        "t", None, "s"]
    assert [tuple(r) for r in jobs.sector_skill_counts(ads, sectors, tags).collect()] == [
        ("s", "a-x", 1), ("s", "b", 1), ("t", "a-x", 1), ("t", "b", 1), (None, "c", 1)]
    table = frame([("x", 2.0), ("y", 3.0), ("y", 1.0), ("a", 5.0)],
                  "industry_sector string, time_to_first_pos_response_min double")
    assert [r[0] for r in effect.industry_efficiency(table).collect()] == ["y", "a", "x"]
    assert rows_of(effect.industry_efficiency(table)) == [
        ("a", 1, 5.0), ("x", 1, 2.0), ("y", 2, 2.0)]
