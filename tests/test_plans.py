from __future__ import annotations

import math

import pytest
from conftest import rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from querytrail.operators.repeats import without_exact_copies
from querytrail.plans import audit, clean, effect, jobs, sessions, skills

LOG = "row_id long, JOB_ID string, MESSAGE_ID string, QUERY_COUNTER int, TIMESTAMP long, " \
      "TIMESTAMP_FORMATTED string, QUERY string"


def log_rows(*rows):
    """(job, message, counter, time, query) rows with ids and a fixed date."""
    return [(i, job, message, counter, time, "2021-01-02 03:04:05", query)
            for i, (job, message, counter, time, query) in enumerate(rows)]


def test_clean_query_log(frame):
    log = frame(log_rows(("a", "0", 1, 5, "One"), ("a", "0", 2, 6, "Two"), ("b", "0", 1, 7, "x"),
                         ("c", "0", 1, 8, "same"), ("c", "0", 2, 9, "same"),
                         (None, "0", 1, 8, "lost"), ("d", "0", 1, 5, None),
                         ("d", "0", 2, 6, "y")), LOG).withColumn("EMPTY", F.lit(None).cast("int"))
    cleaned = clean.clean_query_log(log)
    # row 0 is new in every column; then "a" has one row left and goes, as do the
    # single row of "b" and the two equal ones of "c"; NULL and "y" differ.
    assert "EMPTY" not in cleaned.columns
    assert rows_of(cleaned, "JOB_ID", "QUERY") == [("d", "y"), ("d", None)]
    assert dict(cleaned.dtypes)["QUERY_COUNTER"] == "string"
    assert cleaned.first()["TIMESTAMP_FORMATTED"] == "2021-01-02 03:04:05"


def test_clean_query_log_exact_copies(frame):
    log = frame(log_rows(("A", "0", 1, 5, "One"), ("A", "0", 1, 5, "One"),
                         ("A", "0", 2, 6, "Two")), LOG)
    assert rows_of(clean.clean_query_log(log, mode="exact"), "JOB_ID", "QUERY") == [
        ("a", "one"), ("a", "two")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_copies_are_grouped_only_where_marks_are_shared(frame):
    kind = "row_id long, a string, b double"
    rows = [(5, "x", 0.0), (3, "x", -0.0), (None, None, 1.0), (7, None, 1.0), (1, "y", None), (1, "z", None)]
    kept = without_exact_copies(frame(rows, kind))
    assert rows_of(kept) == sorted([(3, "x", 0.0), (7, None, 1.0), (1, "y", None), (1, "z", None)],
                                   key=lambda r: [(v is None, str(v)) for v in r])
    assert "Exchange" not in plan_of(without_exact_copies(frame(rows[1:3], kind)))


def test_contents_are_compared_only_where_marks_agree(frame):
    log = frame(log_rows(("a", "0", 1, 5, "one"), ("b", "0", 1, 5, None), ("b", "0", 2, 6, None),
                         ("c", "0", 1, 5, None), ("c", "0", 2, 6, "x"), ("c", "1", 3, 7, "x"),
                         (None, "0", 1, 5, "q"), (None, "0", 2, 5, "q")), LOG)
    found = clean.single_content_sessions(log)
    assert rows_of(found) == [("a", "0"), ("b", "0"), ("c", "1"), (None, "0")]
    assert "LeftSemi" in plan_of(found)


def test_clean_response_log(frame):
    log = frame([(1, "a", 1, 10, 0, "2021-01-01 00:00:00"), (2, "b", None, 11, 0, "x"),
                 (3, "b", 2, 12, 0, "bad"), (4, "c", 3, 13, 7, "2021-01-01 10:00:00")],
                "row_id long, JOB_ID string, CV_ID int, TIMESTAMP long, RESPONSE_TYPE int, "
                "TIMESTAMP_FORMATTED string")
    cleaned = clean.clean_response_log(log)
    # essentials first, then the repeat filter: only row 3 repeats a response type;
    # its date is unreadable, so that column is empty and goes
    assert rows_of(cleaned) == [(3, "b", 2, 12, 0)]


def test_clean_job_ads(frame):
    ads = frame([(1, "  Software engineer   wanted. Mail mailto:x@y.z now ")],
                "job_id int, text string")
    row = clean.clean_job_ads(ads).first()
    assert row["text"] == "Software engineer wanted. Mail  now"
    assert (row["n_chars"], row["n_words"]) == (35, 5)
    assert row["job_title"] == "Software engineer wanted"


def test_clean_skills(frame):
    raw = frame([(1, " SQL "), (1, "sql"), (1, "NA"), (1, "na"), (2, "  "), (2, None)],
                "job_id int, skill string")
    assert rows_of(clean.clean_skills(raw)) == [(1, "na"), (1, "sql")]


def test_clean_industry(frame):
    raw = frame([(1, 2, "c", "s", " 10-19 "), (1, 2, "c", "s", "10"), (3, 2, "c", None, "NA")],
                "job_id int, company_id int, company_name string, industry_sector_name string, "
                "employee_count string")
    assert rows_of(clean.clean_industry(raw)) == [(1, 2, "c", "s", 10.0), (3, 2, "c", None, None)]


@pytest.mark.parametrize("name, code, city", [
    ("1050 København K", 1050, "København K"),
    ("1500-1799 København V", 1500, "1500-1799 København V"),
    ("Region Hovedstaden", None, "Region Hovedstaden")])
def test_split_locations(frame, name, code, city):
    areas = frame([(1, name)], "location_id int, location_name string")
    assert rows_of(clean.split_locations(areas)) == [(1, code, city)]


def test_audit_counter_equals_window_form(frame):
    log = frame(log_rows(*[(job, "0", c, 1, "q") for job, counters in {
        "ok": (2, 1, 3), "gap": (1, 3), "twice": (1, 1, 2), "late": (2, 3), "one": (1,),
        None: (1, 2)}.items() for c in counters], ("void", "0", None, 1, "q")), LOG)
    place = F.row_number().over(Window.partitionBy("JOB_ID", "MESSAGE_ID")
                                .orderBy("QUERY_COUNTER"))
    expected = (log.where("QUERY_COUNTER is not null").withColumn("place", place)
                .groupBy("JOB_ID", "MESSAGE_ID")
                .agg(F.bool_and(F.col("QUERY_COUNTER") == F.col("place")).alias("counter_ok")))
    assert rows_of(audit.audit_counter(log)) == rows_of(expected)
    assert rows_of(audit.flag_counts(audit.audit_counter(log), "counter_ok")) == [
        (False, 3), (True, 3)]


def test_audit_time(frame):
    log = frame(log_rows(("a", "0", 1, 10, "q"), ("a", "0", 2, 5, "q"), ("b", "0", 1, 1, "q"),
                         ("b", "0", 2, 2, "q"), ("c", "0", 1, None, "q")), LOG)
    assert rows_of(audit.audit_time_by_counter(log)) == [("a", "0", True), ("b", "0", False)]
    assert rows_of(audit.audit_time_sorted(log)) == [("a", "0", False), ("b", "0", False)]
    assert rows_of(audit.audit_time_by_counter(log, max_group_rows=1)) == rows_of(
        audit.audit_time_by_counter(log))


def test_query_features_null_modes(frame):
    log = frame(log_rows(("a", "0", 1, 10, None)), LOG)
    kept = sessions.query_features(log).first()
    assert (kept["token_count"], kept["contains_boolean"]) == (None, None)
    empty = sessions.query_features(log, null_text="empty").first()
    assert (empty["token_count"], empty["contains_boolean"]) == (0, False)


def test_query_features_without_time(frame):
    log = frame(log_rows(("a", "0", 1, 10, "x")), LOG).drop("TIMESTAMP")
    assert sessions.query_features(log).first()["TIMESTAMP"] is None


def test_unique_tokens(frame):
    log = frame(log_rows(("a", "0", 1, 1, " Java  sql"), ("a", "0", 2, 1, "JAVA"),
                         ("b", "0", 1, 1, None), (None, "0", 1, 1, "x")), LOG)
    assert rows_of(sessions.unique_tokens_per_session(log)) == [("a", 2), (None, 1)]


def test_first_and_last_length(frame):
    log = frame(log_rows(("s", "0", 3, 90, None), ("s", "0", 1, 1, None), ("s", "0", 1, 1, "b"),
                         ("s", "0", 2, 1, "c d")), LOG)
    row = sessions.session_measures(sessions.query_features(log)).first()
    assert (row["first_query_len"], row["last_query_len"]) == (None, None)
    assert (row["n_queries"], row["avg_query_length"]) == (4, 1.5)


def test_session_types_and_limits(frame):
    minutes = {"short": 0.9, "one": 1.0, "match": 60.0, "recruit": 60.01, "long": 240.0,
               "over": 240.1}
    log = frame(log_rows(*[(k, "0", c, t, "a and b" if k == "one" else "a")
                           for k, m in minutes.items()
                           for c, t in ((1, 1000), (2, 1000 + round(m * 60)))]), LOG)
    summary = sessions.session_summary(log)
    assert dict(summary.select("JOB_ID", "session_type").collect()) == {
        "one": "Matching", "match": "Matching", "recruit": "Recruiting", "long": "Recruiting"}
    assert [r[0] for r in rows_of(summary.where("used_boolean"), "JOB_ID")] == ["one"]


def test_session_statistics_of_one_session(frame):
    log = frame(log_rows(("a", "0", 1, 100, "x"), ("a", "0", 2, 400, "x y")), LOG)
    summary = sessions.session_summary(log)
    stats = sessions.session_type_stats(summary).first()
    assert (stats["n_sessions"], stats["mean_duration"], stats["sd_duration"]) == (1, 5.0, None)
    assert sessions.summary_stats(summary).first()["sd_queries"] is None
    assert sessions.duration_query_correlation(summary).first()[0] is None


def test_industry_one(frame):
    rows = frame([(3, "s", "b"), (1, "s", "c"), (2, "s", "b"), (4, "s", None), (5, "n", None)],
                 "row_id long, JOB_ID string, INDUSTRY_SECTOR_NAME string")
    assert rows_of(effect.industry_one(rows)) == [("n", ""), ("s", "c;b")]
    assert rows_of(effect.industry_one(rows.drop("INDUSTRY_SECTOR_NAME"))) == [
        ("n", None), ("s", None)]


def test_response_summary(frame):
    rows = frame([("a", 1, 50), ("a", 1, 40), ("a", 0, 10), ("b", None, 0), ("c", 2, None)],
                 "JOB_ID string, RESPONSE_TYPE int, TIMESTAMP long")
    assert rows_of(effect.response_summary(rows)) == [
        ("a", True, 2, 40.0, 10.0), ("b", False, 0, None, None), ("c", False, 0, None, None)]
    bare = effect.response_summary(rows.drop("RESPONSE_TYPE", "TIMESTAMP"))
    assert rows_of(bare)[0] == ("a", False, 0, None, None)


def test_valid_sessions(frame):
    spans = {"59": 59, "60": 60, "14400": 14400, "14401": 14401}
    log = frame(log_rows(*[(k, "0", c, t, "q") for k, s in spans.items()
                           for c, t in ((1, 1000), (2, 1000 + s))]), LOG)
    assert [r[0] for r in rows_of(effect.valid_sessions(effect.session_times(log)).select("JOB_ID"))] == [
        "14400", "60"]


EFFORT = log_rows(("s", "0", 1, 1000, "køb"), ("s", "0", 2, 1100, "kob"),
                  ("s", "1", 1, 1050, None), ("s", "0", 3, 1200, "a and b"),
                  (None, "0", 1, 500, "x"), (None, "0", 2, 600, "xy"))
RESPONSES = [(1, "s", 1, 1300)]
INDUSTRY = [(1, "s", "IT"), (2, "s", "IT")]


@pytest.mark.parametrize("limit", [5_000_000, 1])
def test_reformulation(frame, limit):
    log = frame(EFFORT, LOG)
    responses = frame(RESPONSES, "row_id long, JOB_ID string, RESPONSE_TYPE int, TIMESTAMP long")
    industry = frame(INDUSTRY, "row_id long, JOB_ID string, INDUSTRY_SECTOR_NAME string")
    out = effect.query_reformulation(log, responses, industry, limit)
    assert rows_of(out, "row_id", "time_gap_s", "reformulation_dist", "any_positive_response",
                   "INDUSTRY_SECTOR_NAME") == [
        (0, None, None, True, "IT"), (1, 50.0, None, True, "IT"), (2, 50.0, None, True, "IT"),
        (3, 100.0, 6.0, True, "IT"), (4, None, None, None, None), (5, 100.0, 1.0, None, None)]
    table = {r["JOB_ID"]: r for r in effect.session_effectiveness(
        log, responses, industry, limit).collect()}
    assert table["s"]["time_to_first_pos_response_min"] == 5.0
    assert table["s"]["boolean_usage_rate"] == 0.25
    assert table[None]["any_positive_response"] is None
    assert table[None]["avg_reformulation"] == 1.0


def test_distance_counts_characters(frame):
    log = frame(log_rows(("s", "0", 1, 1000, "køb"), ("s", "0", 2, 1100, "kob")), LOG)
    empty = frame([], "row_id long, JOB_ID string, RESPONSE_TYPE int, TIMESTAMP long, "
                      "INDUSTRY_SECTOR_NAME string")
    out = effect.query_reformulation(log, empty, empty)
    assert [r[0] for r in rows_of(out, "reformulation_dist")] == [1.0, None]


def test_response_share_and_groups(frame):
    table = frame([("a", True, 0.0, 3.0), ("b", False, 0.33, None), ("c", None, 0.34, 5.0),
                   ("d", True, 0.66, 1.0), ("e", True, 0.67, 2.0)],
                  "JOB_ID string, any_positive_response boolean, boolean_usage_rate double, "
                  "time_to_first_pos_response_min double")
    assert rows_of(effect.response_share(table)) == [
        ("At least one response", 3, 0.6), ("No response", 1, 0.2), (None, 1, 0.2)]
    assert [r[0] for r in rows_of(effect.boolean_groups(table), "JOB_ID", "boolean_group")]
    assert dict(effect.boolean_groups(table).select("JOB_ID", "boolean_group").collect()) == {
        "a": "None", "b": "Low", "c": "Medium", "d": "Medium", "e": "High"}


def test_industry_efficiency(frame):
    table = frame([("x", 2.0), ("x", 4.0), ("y;z", 3.0), (None, 3.0), ("", 1.0), ("x", 0.0)],
                  "industry_sector string, time_to_first_pos_response_min double")
    assert rows_of(effect.industry_efficiency(table)) == [("", 1, 1.0), ("x", 2, 3.0)]


SKILLS = [(1, "front-end"), (1, "sql"), (2, "sql"), (3, "-"), (None, "sql")]
QUERIES = [(1, "SQL* (frontend)"), (2, "java"), (3, "a - b"), (None, "sql"), (4, None)]


def test_overlap_and_mismatch(frame):
    tags = frame(SKILLS, "job_id int, skill string")
    queries = frame(QUERIES, "job_id int, query string")
    overlap = skills.skill_query_overlap(tags, queries)
    assert rows_of(overlap) == [
        (1, "front-end", "frontend", 1), (1, "sql", "sql", 1), (2, "sql", "sql", 0),
        (3, "-", "", 1), (None, "sql", "sql", 1)]
    overview = skills.skill_mismatch_overview(overlap)
    assert rows_of(overview.where("skill = 'sql'"))[0][2:] == (3, 2, pytest.approx(2 / 3))
    assert skills.least_queried(overview, 1).first()["skill"] == "sql"
    assert rows_of(skills.job_skill_coverage(overlap))[0] == (1, 2, 2, 1.0)


def test_skill_counts(frame):
    tags = frame(SKILLS, "job_id int, skill string")
    assert rows_of(skills.skill_frequency(tags)) == [("-", 1), ("front-end", 1), ("sql", 3)]
    assert rows_of(skills.frequency_of_frequencies(tags)) == [(1, 2), (3, 1)]
    assert rows_of(skills.rare_skills(tags, 2)) == [("-", 1), ("front-end", 1)]
    assert rows_of(skills.skill_concept_counts(tags))[0] == ("", 1)


ADS = [(1, 1, "t1", 10, 100), (2, 2, "t2", 20, 200), (3, 3, "t3", None, None),
       (4, 4, "t4", 40, 400)]
COMPANIES = [(1, 7, "c", "it", 5.0), (1, 7, "c", "law", 5.0), (2, 8, "d", "it", None),
             (9, 9, "e", "none", 1.0)]
TAGS = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (4, "z"), (4, "y"), (8, "q")]


@pytest.fixture(scope="module")
def market(frame):
    return (frame(ADS, "row_id int, job_id int, job_title string, n_words int, n_chars int"),
            frame(COMPANIES, "job_id int, company_id int, company_name string, "
                             "industry_sector_name string, employee_count double"),
            frame(TAGS, "job_id int, skill string"))


def test_weights_equal_master_rows(market):
    ads, industry, tags = market
    master = jobs.job_master(ads, industry, tags)
    assert master.count() == 6 + 1 + 1 + 2
    weighted = jobs.weighted_ads(ads, jobs.job_company(industry), tags)
    sector = "industry_sector_name"
    assert rows_of(jobs.skill_present_counts(weighted)) == rows_of(
        master.groupBy(F.col("skill").isNotNull()).count())
    assert rows_of(jobs.sector_counts(weighted)) == rows_of(master.groupBy(sector).count())
    expected = master.groupBy(sector).agg(F.avg("n_words"), F.median("n_words"),
                                          F.count_distinct("job_id"))
    assert rows_of(jobs.industry_complexity(weighted)) == rows_of(expected)
    pairs = jobs.sector_skill_counts(ads, jobs.job_company(industry), tags)
    assert rows_of(pairs) == rows_of(
        master.where("skill is not null").groupBy(sector, "skill").count())
    assert rows_of(jobs.rare_by_sector(pairs, skills.rare_skills(tags, 2))) == rows_of(
        pairs.where("skill <> 'a'"))
    level = jobs.job_level(ads, industry, tags)
    assert rows_of(level, "job_id", sector, "n_skills", "n_words") == [
        (1, "it", 3, 10), (1, "law", 3, 10), (2, "it", 1, 20), (3, None, 1, None),
        (4, None, 2, 40)]


def test_complexity_by(market):
    ads, industry, tags = market
    weighted = jobs.weighted_ads(ads, industry, tags)
    got = {r["employee_count"]: r for r in jobs.complexity_by(weighted, "employee_count").collect()}
    assert (got[5.0]["avg_words"], got[5.0]["avg_skills"], got[5.0]["n_ads"]) == (10.0, 3.0, 1)
    # ads 2 (one row), 3 (one row, no words, no skills) and 4 (two rows)
    assert got[None]["avg_words"] == pytest.approx((20 + 2 * 40) / 3)
    assert got[None]["avg_skills"] == pytest.approx((1 + 2 * 2) / 3)
    assert got[None]["n_ads"] == 3


def test_skills_by_industry(market):
    _, industry, tags = market
    doubled = industry.unionByName(industry.where("company_id = 8"))
    assert rows_of(jobs.skills_by_industry(tags, doubled)) == [
        ("it", pytest.approx(5 / 3), 3, 3), ("law", 3.0, 3, 1), (None, 1.5, 2, 2)]


def test_efficiency_score(frame):
    level = frame([("a", 1, 1), ("a", 3, 3), ("b", 2, 2), ("b", None, 2)],
                  "industry_sector_name string, n_words int, n_skills int")
    scored = jobs.efficiency_score(level)
    means = {r[0]: r[1] for r in jobs.efficiency_by_industry(scored).collect()}
    assert means["a"] == pytest.approx(0.0)
    assert means["b"] is None
    flat = jobs.efficiency_score(level.withColumn("n_skills", F.lit(1)))
    assert {r[0] for r in rows_of(flat, "efficiency_score")} == {None}


def test_profiles(market):
    ads, _, tags = market
    assert tuple(jobs.ad_word_profile(ads).first()) == (10, 15.0, 20.0, 30.0, 40)
    numbers = jobs.six_numbers(skills.skills_per_job(tags), "n_skills").first()
    assert (numbers["min"], numbers["median"], numbers["mean"], numbers["max"]) == (1, 1.5, 1.75, 3)
    assert [r["job_id"] for r in jobs.longest_ads(ads, 2).collect()] == [4, 2]


def test_partitioning_does_not_matter(frame):
    rows = log_rows(*[(f"j{i % 11}", str(i % 2), i % 9, 1000 + (i * 37) % 5000,
                       f"word{i % 13} and {'x' * (i % 5)}") for i in range(400)])
    log = frame(rows, LOG)
    one, many = (sessions.session_summary(log.repartition(n)) for n in (1, 17))
    def shown(df):
        return [tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r)
                for r in rows_of(df)]
    assert shown(one) == shown(many)
    assert rows_of(clean.clean_query_log(log.repartition(1))) == rows_of(
        clean.clean_query_log(log.repartition(17)))
