from __future__ import annotations

import os
import sys

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(ROOT, "tools"))

from check_queries import connect  # noqa: E402
from oracles.statements import ORACLES  # noqa: E402
from querytrail import run
from querytrail.sources import adapters, logs

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Raw CSV files of the derived tables, and the cleaned ones made from them."""
    raw, cleaned = (str(tmp_path_factory.mktemp(name)) for name in ("raw", "cleaned"))
    t = adapters.Tables(spark, FOLDER)
    logs.export({
        "queries": adapters.query_log(t).orderBy("row_id").drop("row_id").withColumn(
            "EMPTY_COL", F.lit(None).cast("string")),
        "responses": adapters.response_log(t).orderBy("row_id").drop("row_id"),
        "industry": adapters.industry_raw(t), "job_ads": adapters.job_ads(t).drop("row_id"),
        "skills": adapters.skills_raw(t)}, raw)
    written = run.run(spark, "clean", raw, cleaned)
    return raw, cleaned, written


def test_clean_study(spark, folders):
    _, cleaned, written = folders
    names = {os.path.basename(path) for path in written}
    assert {"queries_clean.csv", "responses_clean.csv", "job_ads_clean.csv",
            "job_ads_clean.parquet", "skills_clean.csv", "industry_clean.csv"} <= names
    assert "areas_clean.csv" not in names
    ads = logs.load_log(spark, f"{cleaned}/job_ads_clean.csv")
    assert ads.count() == 200
    counted = logs.load_log(spark, f"{cleaned}/audit_counter_counts.csv")
    assert {r["counter_ok"] for r in counted.collect()} == {"true", "false"}


def test_behaviour_study(spark, folders, tmp_path):
    _, cleaned, _ = folders
    written = run.run(spark, "behaviour", cleaned, str(tmp_path / "out"))
    assert len(written) == 9
    stats = logs.load_log(spark, f"{tmp_path}/out/session_type_stats.csv")
    assert {r["session_type"] for r in stats.collect()} <= {"Matching", "Recruiting"}


def test_explore_study(spark, folders, tmp_path):
    _, cleaned, _ = folders
    written = run.run(spark, "explore", cleaned, str(tmp_path / "out"))
    assert len(written) == len(set(written)) == 18
    best = logs.load_log(spark, f"{tmp_path}/out/top_skill_jobs.csv")
    assert best.count() == 20


def test_effect_study(spark, folders, tmp_path):
    raw, cleaned, _ = folders
    t = adapters.Tables(spark, FOLDER)
    logs.export({"industry": adapters.industry_session(t).drop("row_id")}, cleaned)
    run.run(spark, "effect", cleaned, str(tmp_path / "out"))
    shares = logs.load_log(spark, f"{tmp_path}/out/response_share.csv")
    assert sum(float(r["share"]) for r in shares.collect()) == pytest.approx(1.0)


def test_mismatch_study(spark, folders, tmp_path):
    raw, cleaned, _ = folders
    written = run.run(spark, "mismatch", cleaned, str(tmp_path / "out"))
    assert f"{tmp_path}/out/skill_mismatch_overview.csv" in written
    sizes = {r["table_name"]: int(r["n_rows"]) for r in logs.load_log(
        spark, f"{tmp_path}/out/dataset_manifest.csv").collect()}
    assert sizes["jobads"] == 200


def plain(rows):
    """Rows of text or numbers in a form that CSV files and SQL results share."""
    def cell(value):
        try:
            return f"{round(float(value), 6):.4f}"
        except (TypeError, ValueError):
            return None if value is None else str(value)
    return sorted((tuple(map(cell, row)) for row in rows), key=str)


def by_sql(name, columns):
    return plain(connect(FOLDER).execute(
        f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("table,query,columns", [
    ("queries_clean", "clean_query_log",
     ["JOB_ID", "MESSAGE_ID", "QUERY_COUNTER", "TIMESTAMP", "TIMESTAMP_FORMATTED", "QUERY"]),
    ("responses_clean", "clean_response_log", ["JOB_ID", "CV_ID", "TIMESTAMP", "RESPONSE_TYPE"]),
    ("job_ads_clean", "clean_job_ads", ["job_id", "text", "n_words", "n_chars", "job_title"]),
    ("skills_clean", "clean_skills", ["job_id", "skill"]),
    ("industry_clean", "clean_industry", ["job_id", "company_id", "industry_sector_name",
                                          "employee_count"])])
def test_cleaned_tables_agree_with_sql(spark, folders, table, query, columns):
    got = spark.read.parquet(f"{folders[1]}/{table}.parquet").select(*columns).collect()
    assert plain(got) == by_sql(query, [f'"{c}"' for c in columns])


def test_study_tables_agree_with_sql(spark, folders, tmp_path):
    """On cleaned tables whose queries are those of the advertised jobs."""
    source = str(tmp_path / "source")
    for name in ("job_ads_clean", "skills_clean", "industry_clean"):
        spark.read.parquet(f"{folders[1]}/{name}.parquet").write.parquet(f"{source}/{name}.parquet")
    adapters.job_queries(adapters.Tables(spark, FOLDER)).write.parquet(
        f"{source}/queries_clean.parquet")
    for study, tables in (("mismatch", ["skill_mismatch_overview", "job_skill_coverage",
                                        "industry_skill_mismatch", "least_queried_30"]),
                          ("explore", ["industry_complexity", "sector_skill_counts",
                                       "efficiency_by_industry", "skill_freq_of_freq"])):
        target = str(tmp_path / study)
        run.run(spark, study, source, target)
        for name in tables:
            table = logs.load_log(spark, f"{target}/{name}.csv", blank_as_null=False)
            assert plain(table.collect()) == by_sql(name, table.columns), name
    overview = logs.load_log(spark, f"{tmp_path}/mismatch/skill_mismatch_overview.csv",
                             row_id=True).orderBy("row_id").collect()
    order = [(float(r["share_queried"]), -int(r["n_jobs_with_skill"])) for r in overview]
    assert order == sorted(order) and any(share > 0 for share, _ in order)
