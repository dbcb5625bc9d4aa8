"""One DuckDB statement per registered query."""

from __future__ import annotations

import re

from .inputs import QUERY_COLUMNS, TABLES


def statement(final: str) -> str:
    """``final`` with the common table expressions it needs, in dependency order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)) & set(TABLES):
            if name not in needed:
                needed.add(name)
                visit(TABLES[name])

    visit(final)
    parts = [f"{name} AS ({TABLES[name].strip()})" for name in TABLES if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + final.strip()


def rounded(*columns: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)


EFFECTIVENESS = f"""
        SELECT JOB_ID, n_queries,
               {rounded('avg_time_gap_s', 'median_time_gap_s', 'avg_reformulation',
                        'median_reformulation', 'boolean_usage_rate')},
               any_positive_response, total_positive_responses, industry_sector,
               {rounded('time_to_first_pos_response_min')}
        FROM effectiveness"""


def histogram(values: str, bins: int, by: str = "", within: str = "true",
              centre: bool = False) -> str:
    """``values``: a SELECT of ``value`` (and the group column ``by``)."""
    group = f"{by}, " if by else ""
    extra = ", round(mean_value, 6) AS mean_value, round(median_value, 6) AS median_value"
    return f"""
        SELECT {group}CAST(bin AS INTEGER) AS bin, round(low + bin * width, 6) AS bin_start,
               round(low + (bin + 1) * width, 6) AS bin_end, count(*) AS n{extra if centre else ''}
        FROM (SELECT *, CASE WHEN width = 0 THEN 0
                             ELSE least(floor((value - low) / width), {bins - 1}) END AS bin
              FROM (SELECT v.*, low, (high - low) / {bins} AS width, mean_value, median_value
                    FROM ({values}) v CROSS JOIN (
                        SELECT CAST(min(value) FILTER (WHERE {within}) AS DOUBLE) AS low,
                               CAST(max(value) FILTER (WHERE {within}) AS DOUBLE) AS high,
                               CAST(avg(value) AS DOUBLE) AS mean_value,
                               CAST(median(value) AS DOUBLE) AS median_value
                        FROM ({values})) WHERE value IS NOT NULL AND {within}))
        GROUP BY ALL"""


def band(source: str, x: str, y: str) -> str:
    """Line and 95 % band at 80 points; the t quantile by halving the angle, for any degrees."""
    even = "exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * power(cos(a), 2 * k)"
    odd = "exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * power(cos(a), 2 * k + 1)"
    share = f"""
        CASE WHEN v % 2 = 0
             THEN sin(a) * list_sum(list_transform(range(0, v // 2), lambda k: {even}))
             ELSE 2 / pi() * (a + sin(a) * coalesce(list_sum(list_transform(
                      range(0, (v - 1) // 2), lambda k: {odd})), 0)) END"""
    return f"""
        SELECT point, {rounded('x', 'fit', 'lower', 'upper')}
        FROM (SELECT *, fit - t * error AS lower, fit + t * error AS upper
              FROM (SELECT *, intercept + slope * x AS fit,
                           se * sqrt(1 / n + power(x - mean_x, 2) / sxx) AS error
                    FROM (SELECT *, low + (high - low) * point / 79.0 AS x
                          FROM (SELECT *, CAST(unnest(range(0, 80)) AS INTEGER) AS point
                                FROM (SELECT n, slope, intercept, mean_x, sxx, low, high,
                                             sqrt(greatest(syy - slope * sxy, 0) / v) AS se,
                                             sqrt(v) * tan(first_low) AS t
                                      FROM (
            WITH RECURSIVE sums AS (
                SELECT CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS slope,
                       regr_intercept(y, x) AS intercept, regr_avgx(y, x) AS mean_x,
                       regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy,
                       min(x) FILTER (WHERE y IS NOT NULL) AS low,
                       max(x) FILTER (WHERE y IS NOT NULL) AS high,
                       CAST(regr_count(y, x) AS BIGINT) - 2 AS v
                FROM (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source})),
            halving AS (
                SELECT 0 AS step, 0.0::DOUBLE AS l, pi() / 2 AS h, v FROM sums WHERE v >= 1
                UNION ALL
                SELECT step + 1, CASE WHEN part < 0.95 THEN a ELSE l END,
                       CASE WHEN part < 0.95 THEN h ELSE a END, v
                FROM (SELECT *, {share} AS part FROM (SELECT *, (l + h) / 2 AS a FROM halving))
                WHERE step < 60)
            SELECT sums.*, l AS first_low FROM sums LEFT JOIN halving ON step = 60
            WHERE sxx > 0))))))"""


def trend(source: str, x: str, y: str) -> str:
    return f"""
        SELECT n, {rounded('slope', 'intercept', 'r2', 'mean_x', 'sxx')},
               round(CASE WHEN n > 2 THEN sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) END, 6)
                   AS residual_se
        FROM (SELECT CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS slope,
                     regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
                     regr_avgx(y, x) AS mean_x, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
                     regr_sxy(y, x) AS sxy
              FROM (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source}))"""


def complexity(source: str, dimension: str) -> str:
    return f"""
        SELECT {dimension}, round(avg(n_words), 6) AS avg_words,
               round(avg(n_skills), 6) AS avg_skills,
               count(DISTINCT job_id) + max(CASE WHEN job_id IS NULL THEN 1 ELSE 0 END) AS n_ads
        FROM {source} GROUP BY {dimension}"""


SESSION_COLUMNS = f"""
    JOB_ID, n_queries, {rounded('avg_query_length', 'median_query_length', 'boolean_usage_rate',
                                'wildcard_usage_rate', 'session_start', 'session_end',
                                'session_duration_min')},
    first_query_len, last_query_len, unique_token_count, session_type, used_boolean, used_wildcard
"""
VALID_LOG = f"""
    row_id, JOB_ID, MESSAGE_ID, QUERY_COUNTER, {rounded('"TIMESTAMP"')}, TIMESTAMP_FORMATTED,
    QUERY, token_count, contains_boolean, contains_wildcard
"""
RESPONSE_SUMMARY = f"""
    any_positive_response, total_positive_responses,
    {rounded('first_positive_resp_ts', 'first_any_response_ts')}
"""
STATEMENTS: dict[str, str] = {
    "dataset_manifest": """
        SELECT 'skills' AS table_name, count(*) AS n_rows FROM skills
        UNION ALL SELECT 'industry', count(*) FROM industry
        UNION ALL SELECT 'jobads', count(*) FROM ads
        UNION ALL SELECT 'queries', count(*) FROM job_queries""",
    "load_log_roundtrip": "SELECT CAST(row_id AS VARCHAR) AS row_id, "
        + ", ".join(f'nullif(trim(CAST("{c}" AS VARCHAR)), \'\') AS {c.lower()}'
                    for c in QUERY_COLUMNS) + " FROM query_log",
    "clean_query_log": "SELECT * FROM query_clean",
    "clean_query_log_exact": """
        SELECT l.row_id, """ + ", ".join(
            f'lower(CAST(l."{c}" AS VARCHAR)) AS "{c}"' for c in QUERY_COLUMNS) + """
        FROM query_log l
        JOIN (SELECT JOB_ID, MESSAGE_ID FROM query_log
              WHERE JOB_ID IS NOT NULL
              GROUP BY JOB_ID, MESSAGE_ID
              HAVING count(DISTINCT QUERY)
                     + max(CASE WHEN QUERY IS NULL THEN 1 ELSE 0 END) > 1) s
          ON s.JOB_ID = l.JOB_ID AND s.MESSAGE_ID = l.MESSAGE_ID
        WHERE l.row_id IN (SELECT min(row_id) FROM query_log
                           GROUP BY """ + ", ".join(f'"{c}"' for c in QUERY_COLUMNS) + ")",
    "audit_counter": """
        SELECT JOB_ID, MESSAGE_ID, bool_and(QUERY_COUNTER = place) AS counter_ok
        FROM (SELECT *, row_number() OVER (PARTITION BY JOB_ID, MESSAGE_ID
                                           ORDER BY QUERY_COUNTER, row_id) AS place
              FROM query_log)
        GROUP BY JOB_ID, MESSAGE_ID""",
    "audit_time_sorted": """
        SELECT JOB_ID, MESSAGE_ID, coalesce(bool_or("TIMESTAMP" < before), false) AS backwards
        FROM (SELECT *, lag("TIMESTAMP") OVER (PARTITION BY JOB_ID, MESSAGE_ID
                                               ORDER BY "TIMESTAMP", row_id) AS before
              FROM query_log)
        GROUP BY JOB_ID, MESSAGE_ID""",
    "audit_time_by_counter": """
        SELECT JOB_ID, MESSAGE_ID, coalesce(bool_or("TIMESTAMP" < before), false) AS backwards
        FROM (SELECT *, lag("TIMESTAMP") OVER (PARTITION BY JOB_ID, MESSAGE_ID
                                               ORDER BY QUERY_COUNTER, row_id) AS before
              FROM query_log)
        GROUP BY JOB_ID, MESSAGE_ID""",
    "clean_response_log": """
        SELECT * REPLACE (strptime(TIMESTAMP_FORMATTED, '%Y-%m-%d %H:%M:%S')
                          AS TIMESTAMP_FORMATTED)
        FROM response_clean""",
    "clean_job_ads": """
        SELECT row_id, job_id, text, n_chars, n_words, job_title_raw, job_title FROM ads""",
    "longest_ads": """
        SELECT job_id, n_words, job_title FROM ads
        ORDER BY n_words DESC NULLS LAST, job_id LIMIT 10""",
    "ad_word_profile": f"""
        SELECT min(n_words) AS min_words, round(quantile_cont(n_words, 0.25), 6) AS q1_words,
               round(median(n_words), 6) AS median_words,
               round(quantile_cont(n_words, 0.75), 6) AS q3_words, max(n_words) AS max_words
        FROM ads""",
    "clean_skills": "SELECT job_id, skill FROM skills",
    "skills_per_job": "SELECT * FROM per_job",
    "skill_freq": "SELECT * FROM freq",
    "top_skills": "SELECT * FROM freq ORDER BY n DESC, skill LIMIT 20",
    "top_skill_jobs": "SELECT * FROM per_job ORDER BY n_skills DESC, job_id LIMIT 20",
    "clean_industry": "SELECT * FROM industry",
    "split_locations": "SELECT * FROM locations",
    "query_features": """
        SELECT * FROM features""",
    "query_filtered": """
        SELECT * FROM features WHERE token_count > 0 AND "TIMESTAMP" > 0""",
    "unique_tokens_per_session": "SELECT * FROM tokens",
    "session_summary": f"SELECT {SESSION_COLUMNS} FROM sessions",
    "session_summary_bucketed": f"SELECT {SESSION_COLUMNS} FROM sessions",
    "summary_stats": """
        SELECT round(avg(n_queries), 6) AS avg_queries_per_session,
               round(median(n_queries), 6) AS median_queries_per_session,
               round(stddev_samp(n_queries), 6) AS sd_queries,
               round(avg(boolean_usage_rate), 6) AS avg_boolean_rate,
               round(avg(wildcard_usage_rate), 6) AS avg_wildcard_usage,
               round(avg(s.avg_query_length), 6) AS avg_query_length,
               round(median(s.median_query_length), 6) AS median_query_length,
               round(avg(session_duration_min), 6) AS avg_session_duration,
               round(median(session_duration_min), 6) AS median_session_duration
        FROM sessions s""",
    "boolean_query_stats": """
        SELECT count(*) AS total_queries, count(*) FILTER (WHERE contains_boolean)
                   AS boolean_queries,
               count(*) FILTER (WHERE NOT contains_boolean) AS non_boolean_queries,
               round(avg(CAST(contains_boolean AS INTEGER)) * 100, 6) AS pct_boolean
        FROM features WHERE token_count > 0 AND "TIMESTAMP" > 0""",
    "session_type_stats": """
        SELECT session_type, count(*) AS n_sessions,
               round(avg(session_duration_min), 6) AS mean_duration,
               round(median(session_duration_min), 6) AS median_duration,
               round(stddev_samp(session_duration_min), 6) AS sd_duration
        FROM sessions GROUP BY session_type""",
    "duration_query_correlation": """
        SELECT round(corr(session_duration_min, n_queries), 6) AS correlation FROM sessions""",
    "duration_query_trend": trend("sessions", "session_duration_min", "n_queries"),
    "industry_one": "SELECT * FROM industry_one",
    "response_summary": f"SELECT JOB_ID, {RESPONSE_SUMMARY} FROM responses",
    "session_bounds": f"""
        SELECT JOB_ID, {rounded('start_ts', 'end_ts', 'duration_s')} FROM bounds""",
    "valid_queries": f"SELECT {VALID_LOG} FROM valid_effort",
    "valid_responses": f"""
        SELECT JOB_ID, {RESPONSE_SUMMARY} FROM responses r
        WHERE EXISTS (SELECT 1 FROM valid v WHERE v.JOB_ID IS NOT DISTINCT FROM r.JOB_ID)""",
    "valid_industry": """
        SELECT * FROM industry_one i
        WHERE EXISTS (SELECT 1 FROM valid v WHERE v.JOB_ID IS NOT DISTINCT FROM i.JOB_ID)""",
    "query_reformulation": f"""
        SELECT s.row_id, s.JOB_ID, s.MESSAGE_ID, s.QUERY_COUNTER,
               round(s."TIMESTAMP", 6) AS "TIMESTAMP", s.TIMESTAMP_FORMATTED, s.QUERY,
               s.token_count, s.contains_boolean, s.contains_wildcard,
               round(s.time_gap_s, 6) AS time_gap_s, s.reformulation_dist,
               {RESPONSE_SUMMARY}, i.INDUSTRY_SECTOR_NAME
        FROM stepped s LEFT JOIN responses r ON r.JOB_ID IS NOT DISTINCT FROM s.JOB_ID
        LEFT JOIN industry_one i ON i.JOB_ID IS NOT DISTINCT FROM s.JOB_ID""",
    "time_to_response": f"SELECT JOB_ID, {rounded('time_to_first_pos_response_min')} FROM waits",
    "session_effectiveness": EFFECTIVENESS,
    "session_effectiveness_bucketed": EFFECTIVENESS,
    "industry_efficiency": f"""
        SELECT industry_sector, sessions, {rounded('mean_time_to_first_pos_response_min')}
        FROM efficiency""",
    "industry_efficiency_top8": f"""
        SELECT industry_sector, sessions, {rounded('mean_time_to_first_pos_response_min')}
        FROM efficiency ORDER BY sessions DESC, industry_sector LIMIT 8""",
    "response_share": """
        SELECT status, n, round(n / sum(n) OVER (), 6) AS share
        FROM (SELECT CASE WHEN any_positive_response THEN 'At least one response'
                          WHEN NOT any_positive_response THEN 'No response' END AS status,
                     count(*) AS n
              FROM effectiveness GROUP BY 1)""",
    "boolean_effort_trend": trend("effectiveness", "boolean_usage_rate", "avg_time_gap_s"),
    "boolean_effort_band": band("effectiveness", "boolean_usage_rate", "avg_time_gap_s"),
    "boolean_group_box": """
        SELECT boolean_group, n_values, round(q1, 6) AS q1, round(median, 6) AS median,
               round(q3, 6) AS q3, round(min(t) FILTER (WHERE inside), 6) AS lower_whisker,
               round(max(t) FILTER (WHERE inside), 6) AS upper_whisker,
               count(*) FILTER (WHERE NOT inside) AS n_outliers
        FROM (SELECT *, t BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
              FROM (SELECT boolean_group, t, count(*) OVER g AS n_values,
                           quantile_cont(t, 0.25) OVER g AS q1, median(t) OVER g AS median,
                           quantile_cont(t, 0.75) OVER g AS q3
                    FROM (SELECT CASE WHEN boolean_usage_rate = 0 THEN 'None'
                                      WHEN boolean_usage_rate <= 0.33 THEN 'Low'
                                      WHEN boolean_usage_rate <= 0.66 THEN 'Medium'
                                      ELSE 'High' END AS boolean_group,
                                 time_to_first_pos_response_min AS t
                          FROM effectiveness WHERE time_to_first_pos_response_min IS NOT NULL)
                    WINDOW g AS (PARTITION BY boolean_group)))
        GROUP BY boolean_group, n_values, q1, median, q3""",
    "job_company": "SELECT * FROM company",
    "job_master": "SELECT * FROM master",
    "skill_concept_counts": "SELECT * FROM concept_counts",
    "query_terms": "SELECT * FROM terms",
    "skill_query_overlap": "SELECT * FROM overlap",
    "skill_mismatch_overview": f"""
        SELECT skill, skill_clean, n_jobs_with_skill, n_jobs_where_queried,
               {rounded('share_queried')} FROM overview""",
    "least_queried_30": f"""
        SELECT skill, skill_clean, n_jobs_with_skill, n_jobs_where_queried,
               round(o.share_queried, 6) AS share_queried FROM overview o
        ORDER BY o.share_queried, n_jobs_with_skill DESC, skill, skill_clean LIMIT 30""",
    "top_common_skills": f"""
        SELECT skill, skill_clean, n_jobs_with_skill, n_jobs_where_queried,
               {rounded('share_queried')}
        FROM (SELECT *, rank() OVER (ORDER BY n_jobs_with_skill DESC) AS place FROM overview)
        WHERE place <= 30""",
    "job_skill_coverage": f"""
        SELECT job_id, n_skills, n_skills_queried, {rounded('share_skills_queried')}
        FROM coverage""",
    "industry_skill_mismatch": """
        SELECT industry_sector_name,
               round(avg(share_skills_queried), 6) AS avg_share_skills_queried,
               count(DISTINCT job_id) AS n_jobs
        FROM (SELECT DISTINCT m.job_id, industry_sector_name, share_skills_queried
              FROM master m LEFT JOIN coverage c ON c.job_id = m.job_id)
        GROUP BY industry_sector_name""",
    "job_level": "SELECT * FROM level",
    "skill_present_counts": """
        SELECT skill IS NOT NULL AS has_skill, count(*) AS n FROM master GROUP BY 1""",
    "sector_counts_top20": """
        SELECT industry_sector_name, count(*) AS n FROM master GROUP BY 1
        ORDER BY n DESC, industry_sector_name NULLS LAST LIMIT 20""",
    "sector_skill_counts": """
        SELECT industry_sector_name, skill, count(*) AS n FROM master
        WHERE skill IS NOT NULL GROUP BY 1, 2""",
    "master_skill_counts_top20": """
        SELECT skill, count(*) AS n FROM master GROUP BY skill
        ORDER BY n DESC, skill NULLS LAST LIMIT 20""",
    "industry_complexity": """
        SELECT industry_sector_name, round(avg(n_words), 6) AS avg_words,
               round(median(n_words), 6) AS median_words, count(DISTINCT job_id) AS n_ads
        FROM master GROUP BY 1""",
    "skills_by_industry_top15": """
        SELECT industry_sector_name, round(avg(n_skills), 6) AS avg_skills,
               max(n_skills) AS max_skills, count(*) AS n_jobs
        FROM per_job p LEFT JOIN industry i ON i.job_id = p.job_id
        GROUP BY 1 ORDER BY avg(n_skills) DESC, 1 NULLS LAST LIMIT 15""",
    "skills_per_job_summary": """
        SELECT min(n_skills) AS min, round(quantile_cont(n_skills, 0.25), 6) AS q1,
               round(median(n_skills), 6) AS median, round(avg(n_skills), 6) AS mean,
               round(quantile_cont(n_skills, 0.75), 6) AS q3, max(n_skills) AS max
        FROM per_job""",
    "rare_skills": "SELECT * FROM freq WHERE n < 20",
    "industry_rare": """
        SELECT industry_sector_name, skill, count(*) AS n FROM master
        WHERE skill IN (SELECT f.skill FROM freq f WHERE f.n < 20) GROUP BY 1, 2""",
    "skill_freq_of_freq": "SELECT n, count(*) AS n_skills FROM freq GROUP BY n",
    "complexity_by_employee_count": complexity("""
        (SELECT a.job_id, a.n_words, i.employee_count, p.n_skills
         FROM ads a LEFT JOIN industry i ON i.job_id = a.job_id
         LEFT JOIN skills s ON s.job_id = a.job_id
         LEFT JOIN per_job p ON p.job_id = a.job_id)""", "employee_count"),
    "complexity_by_location": complexity("""
        (SELECT a.job_id, a.n_words, j.location_name, p.n_skills
         FROM ads a LEFT JOIN job_city j ON j.job_id = a.job_id
         LEFT JOIN skills s ON s.job_id = a.job_id
         LEFT JOIN per_job p ON p.job_id = a.job_id)""", "location_name"),
    "efficiency_score": f"""
        SELECT job_id, job_title, company_id, company_name, industry_sector_name, n_skills,
               n_words, n_chars, {rounded('efficiency_score')} FROM scored""",
    "efficiency_by_industry": """
        SELECT industry_sector_name,
               round(CASE WHEN count(*) = count(efficiency_score) THEN avg(efficiency_score) END,
                     6) AS avg_efficiency_score
        FROM scored GROUP BY 1""",
    "hist_queries_per_session": histogram("SELECT n_queries AS value FROM sessions", 25,
                                          within="value BETWEEN 1 AND 50", centre=True),
    "hist_unique_tokens": histogram("SELECT unique_token_count AS value FROM sessions", 25),
    "hist_duration_by_type": histogram(
        "SELECT session_type, session_duration_min AS value FROM sessions", 30,
        by="session_type"),
    "hist_skill_freq_log10": histogram("SELECT log10(n) AS value FROM freq", 40),
    "hist_skill_freq_log10_50": histogram("SELECT log10(n) AS value FROM freq", 50),
    "hist_concept_log10": histogram("SELECT log10(total_frequency) AS value FROM concept_counts",
                                    40),
    "hist_coverage": histogram("SELECT share_skills_queried AS value FROM coverage", 40),
    "hist_skills_per_job": histogram("SELECT n_skills AS value FROM per_job", 40),
    "export_roundtrip": """
        SELECT 'skill_frequency' AS table_name, count(*) AS n_rows,
               CAST(sum(n) AS BIGINT) AS total FROM freq
        UNION ALL SELECT 'skill_concept_counts', count(*), CAST(sum(total_frequency) AS BIGINT)
                  FROM concept_counts
        UNION ALL SELECT 'skill_mismatch_overview', count(*),
                         CAST(sum(n_jobs_with_skill) AS BIGINT) FROM overview
        UNION ALL SELECT 'job_skill_coverage', count(*), CAST(sum(n_skills_queried) AS BIGINT)
                  FROM coverage
        UNION ALL SELECT 'industry_skill_mismatch', count(*), CAST(sum(n_jobs) AS BIGINT)
                  FROM (SELECT industry_sector_name, count(DISTINCT job_id) AS n_jobs
                        FROM master GROUP BY 1)
        UNION ALL SELECT 'skills_per_job', count(*), CAST(sum(n_skills) AS BIGINT) FROM per_job
        UNION ALL SELECT 'job_ads', count(*), CAST(sum(n_words) AS BIGINT) FROM ads
        UNION ALL SELECT 'job_ads typed', count(*), CAST(sum(n_words) AS BIGINT) FROM ads
        UNION ALL SELECT 'industry', count(*), CAST(sum(employee_count) AS BIGINT) FROM industry
        UNION ALL SELECT 'locations', count(*), CAST(sum(postal_code) AS BIGINT)
                  FROM locations""",
    "export_replaced": """
        SELECT *, n_rows AS manifest_rows FROM (
            SELECT 'skills_per_job.csv' AS table_name, count(*) AS n_rows,
                   CAST(sum(n_skills) AS BIGINT) AS total FROM per_job
            UNION ALL SELECT 'industry.csv', count(*), CAST(sum(employee_count) AS BIGINT)
                      FROM industry
            UNION ALL SELECT 'job_ads.csv', count(*), CAST(sum(n_words) AS BIGINT) FROM ads
            UNION ALL SELECT 'job_ads.parquet', count(*), CAST(sum(n_words) AS BIGINT) FROM ads)""",
    "log_column_types": """
        SELECT column_name, CASE
                   WHEN bool_and(v IN ('T', 'TRUE', 'true', 'F', 'FALSE', 'false')) THEN 'logical'
                   WHEN bool_and(NOT regexp_matches(v, '^[+-]?0[0-9]')
                                 AND regexp_matches(v, '^[+-]?[0-9]+$')
                                 AND TRY_CAST(v AS BIGINT) IS NOT NULL) THEN 'integer'
                   WHEN bool_and(NOT regexp_matches(v, '^[+-]?0[0-9]')
                                 AND TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'double'
                   WHEN bool_and(length(v) <= 10 AND TRY_CAST(v AS DATE) IS NOT NULL) THEN 'date'
                   WHEN bool_and(TRY_CAST(v AS TIMESTAMP) IS NOT NULL) THEN 'datetime'
                   ELSE 'text' END AS column_type, count(*) AS n_values
        FROM (
            UNPIVOT (SELECT CAST(row_id AS VARCHAR) AS row_id, JOB_ID, MESSAGE_ID,
                            CAST(QUERY_COUNTER AS VARCHAR) AS QUERY_COUNTER,
                            CAST("TIMESTAMP" AS VARCHAR) AS "TIMESTAMP", TIMESTAMP_FORMATTED,
                            nullif(trim(QUERY), '') AS QUERY,
                            CAST(QUERY_COUNTER % 24 AS VARCHAR) || '.5' AS HOUR,
                            substr(TIMESTAMP_FORMATTED, 1, 10) AS DAY,
                            CASE WHEN QUERY_COUNTER % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS EVEN,
                            lpad(CAST(QUERY_COUNTER % 100 AS VARCHAR), 4, '0') AS CODE
                     FROM query_log) ON COLUMNS(*) INTO NAME column_name VALUE v)
        GROUP BY column_name""",
    "parsed_datetimes": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events",
    "clean_headers": """
        SELECT c_nationkey AS omrade_nr, CAST(sum(c_custkey) AS BIGINT) AS kunde_number,
               max(c_name) AS navn_pa_kunden, round(sum(c_acctbal), 6) AS storrelse_percent,
               count(c_custkey) AS kunde_number_2
        FROM customer GROUP BY 1""",
}
for _kind, _flag, _source in (("audit_counter_counts", "counter_ok", "audit_counter"),
                              ("audit_time_sorted_counts", "backwards", "audit_time_sorted"),
                              ("audit_time_by_counter_counts", "backwards",
                               "audit_time_by_counter")):
    STATEMENTS[_kind] = f"SELECT {_flag}, count(*) AS n FROM ({STATEMENTS[_source]}) GROUP BY 1"

ORACLES = {name: statement(sql) for name, sql in STATEMENTS.items()}
