"""Common table expressions: the derived logs and the cleaned tables in SQL."""

from __future__ import annotations

# White space and word characters of Unicode, spelled out because the regular
# expressions of DuckDB know only the ASCII ones.
SPACE = (r"\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
         r"\x{205F}\x{3000}")
WORD_CHAR = r"\p{L}\p{M}\p{Nd}_"
BOOLEAN = (rf"(^|[^{WORD_CHAR}])(and|or|not)([^{WORD_CHAR}]|$)" r"|\+|-|\|")


def word_count(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '[^{SPACE}]+')) AS INTEGER)"


def has_boolean(text: str) -> str:
    return f"regexp_matches({text}, '{BOOLEAN}')"


def trim_space(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def squish(text: str) -> str:
    return f"regexp_replace({trim_space(text)}, '[{SPACE}]+', ' ', 'g')"


def words(text: str) -> str:
    return f"string_split_regex({text}, '[{SPACE}]+')"


def first_match(text: str, pattern: str) -> str:
    return (f"CASE WHEN regexp_matches({text}, '{pattern}') "
            f"THEN regexp_extract({text}, '{pattern}') END")


def concept(text: str) -> str:
    return f"regexp_replace(lower({text}), '[-_ ]', '', 'g')"


def distance(a: str, b: str) -> str:
    """Edit distance in characters: DuckDB counts bytes, so each accented letter is
    first put as one capital, which lower-case queries do not have."""
    letters = "'éóèñçêüäößí', 'ABCDEFGHIJK'"
    return f"levenshtein(translate({a}, {letters}), translate({b}, {letters}))"


SID = "CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')"
SID_OF_EVENT = "CAST(e.user_id AS VARCHAR) || '-' || strftime(e.ts, '%Y%m%d')"
SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
STAMP = (f"CASE WHEN event_id % 301 = 0 THEN 0 WHEN event_id % 13 = 0 THEN {SECONDS} * 1000 "
         f"ELSE {SECONDS} END")
STAMP_TEXT = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def seconds(column: str) -> str:
    """Repaired epoch seconds."""
    return (f"CASE WHEN {column} > 1e11 THEN CAST({column} AS DOUBLE) / 1000 "
            f"WHEN {column} > 0 THEN CAST({column} AS DOUBLE) END")


def keep_repeats(source: str, columns: list[str]) -> str:
    ranks = ", ".join(f'row_number() OVER (PARTITION BY "{c}" ORDER BY row_id) AS r{i}'
                      for i, c in enumerate(columns))
    some = " OR ".join(f"r{i} > 1" for i in range(len(columns)))
    return (f"SELECT * EXCLUDE ({', '.join(f'r{i}' for i in range(len(columns)))}) "
            f"FROM (SELECT *, {ranks} FROM {source}) WHERE {some}")


QUERY_COLUMNS = ["JOB_ID", "MESSAGE_ID", "QUERY_COUNTER", "TIMESTAMP", "TIMESTAMP_FORMATTED",
                 "QUERY"]
RESPONSE_COLUMNS = ["JOB_ID", "CV_ID", "TIMESTAMP", "RESPONSE_TYPE", "TIMESTAMP_FORMATTED"]

TABLES: dict[str, str] = {
    "query_events": f"""
        SELECT event_id, doc_id, k, visits, n_queries, j, sid, event_ts, MESSAGE_ID,
               event_ts + to_seconds(j) AS ts,
               row_number() OVER (PARTITION BY sid, MESSAGE_ID
                                  ORDER BY event_ts, event_id, j) AS position
        FROM (SELECT *, unnest(range(n_queries + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END)) AS j
              FROM (SELECT e.event_id, e.ts AS event_ts, {SID_OF_EVENT} AS sid,
                           CAST(e.event_id % 2 AS VARCHAR) AS MESSAGE_ID,
                           d.doc_id, e.event_id // n_docs AS k, v.visits,
                           1 + (d.n_chars // v.visits) // 30 AS n_queries
                    FROM events e
                    CROSS JOIN (SELECT count(*) AS n_docs FROM documents) c
                    JOIN documents d ON d.doc_id = e.event_id % c.n_docs
                    JOIN (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id,
                                 count(*) AS visits FROM events GROUP BY 1) v
                      ON v.doc_id = d.doc_id))""",
    "event_log": f"""
        SELECT event_id * 1000000 + j AS row_id,
               CASE WHEN event_id % 211 <> 0 THEN sid END AS JOB_ID, MESSAGE_ID,
               position + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS QUERY_COUNTER,
               {STAMP} AS "TIMESTAMP", {STAMP_TEXT} AS TIMESTAMP_FORMATTED,
               event_id, doc_id, k, visits, n_queries, j
        FROM query_events""",
    "query_log": """
        SELECT row_id, JOB_ID, MESSAGE_ID, QUERY_COUNTER, "TIMESTAMP", TIMESTAMP_FORMATTED,
               CASE WHEN j = n_queries THEN NULL
                    WHEN (event_id + j) % 5 = 0 THEN array_to_string(w[s + 1:e], ' and ')
                    WHEN (event_id + j) % 7 = 0
                        THEN '+' || array_to_string(w[s + 1:e], ' ') || '*'
                    ELSE array_to_string(w[s + 1:e], ' ') END AS QUERY
        FROM (SELECT *, greatest(a + (b - a) * (j + 1) // n_queries, s + 1) AS e
              FROM (SELECT *, a + (b - a) * j // n_queries AS s
                    FROM (SELECT l.*, d.w, k * len(d.w) // visits AS a,
                                 greatest((k + 1) * len(d.w) // visits,
                                          k * len(d.w) // visits + 1) AS b
                          FROM event_log l
                          JOIN (SELECT doc_id, string_split_regex(lower(text), '[ \\n]+') AS w
                                FROM documents) d USING (doc_id))))""",
    "response_log": f"""
        SELECT event_id AS row_id, {SID} AS JOB_ID,
               CASE WHEN event_id % 89 <> 0 THEN event_id END AS CV_ID,
               {STAMP} AS "TIMESTAMP",
               CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type = 'purchase' THEN 1
                    WHEN event_type = 'signup' THEN 2 ELSE 0 END AS RESPONSE_TYPE,
               {STAMP_TEXT} AS TIMESTAMP_FORMATTED
        FROM events WHERE event_type <> 'view'""",
    "industry_session": f"""
        SELECT event_id AS row_id, {SID} AS JOB_ID,
               CASE WHEN user_id % 23 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'sector_x'
                    ELSE 'sector' || CAST(user_id % 12 AS VARCHAR) END AS INDUSTRY_SECTOR_NAME
        FROM events""",
    "job_ads": """
        SELECT doc_id AS row_id, doc_id AS job_id,
               '  ' || text || CASE doc_id % 4 WHEN 0 THEN ' mailto:hr@example.com end'
                   WHEN 1 THEN ' see http://jobs.example/1 now'
                   WHEN 2 THEN ' a' || chr(150) || 'b' || chr(146) || 's' ELSE '' END AS text
        FROM documents""",
    "skills_raw": """
        SELECT doc_id AS job_id,
               CASE WHEN n % 31 = 0 THEN 'NA' WHEN n % 29 = 0 THEN '  '
                    WHEN n % 3 = 0 THEN ' ' || translate(substr(k, 1, 1), 'abcdefghijklmnopqrstuvwxyz',
                                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
                                       || substr(k, 2) || ' '
                    WHEN n % 7 = 0 THEN substr(k, 1, 2) || '-' || substr(k, 3)
                    ELSE k END AS skill
        FROM (SELECT doc_id, doc_id + i - 1 AS n, w[i] AS k
              FROM (SELECT d.doc_id, b.w, unnest(range(1, len(b.w) + 1)) AS i
                    FROM documents d
                    CROSS JOIN (SELECT count(*) AS n_items FROM benchmark) c
                    JOIN (SELECT item_id, string_split_regex(text, '[ \\n]+') AS w
                          FROM benchmark) b ON b.item_id = d.doc_id % c.n_items))""",
    "job_queries": "SELECT doc_id AS job_id, text AS query FROM documents",
    "industry_raw": """
        SELECT doc_id AS job_id, doc_id % 100 AS company_id,
               'Company ' || CAST(doc_id % 100 AS VARCHAR) AS company_name,
               CASE WHEN doc_id % 23 <> 0 THEN source END AS industry_sector_name,
               lang AS industry_division_name,
               CASE WHEN doc_id % 9 = 0 THEN 'NA'
                    ELSE ' ' || CAST(doc_id % 7 * 50 AS VARCHAR) || '-'
                         || CAST(doc_id % 7 * 50 + 49 AS VARCHAR) || ' ' END AS employee_count
        FROM documents
        UNION ALL
        SELECT doc_id, doc_id % 100, 'Company ' || CAST(doc_id % 100 AS VARCHAR), 'src_extra',
               lang, ' 10-19 '
        FROM documents WHERE doc_id % 10 = 0""",
    "area_raw": """
        SELECT c_custkey AS location_id,
               CASE c_custkey % 10 WHEN 0 THEN n_name
                    WHEN 1 THEN CAST(1000 + c_custkey % 500 AS VARCHAR) || '-'
                                || CAST(1499 + c_custkey % 500 AS VARCHAR) || ' ' || n_name
                    ELSE CAST(1000 + c_custkey % 9000 AS VARCHAR) || ' ' || n_name
               END AS location_name
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    # ---- cleaned tables
    "query_padded": "SELECT *, NULL AS EMPTY_COL FROM query_log",
    "query_repeats": keep_repeats("query_padded", [*QUERY_COLUMNS, "EMPTY_COL"]),
    "query_lowered": """
        SELECT row_id, """ + ", ".join(
            f'lower(CAST("{c}" AS VARCHAR)) AS "{c}"' for c in QUERY_COLUMNS) + """
        FROM query_repeats
        WHERE JOB_ID IS NOT NULL AND "TIMESTAMP" IS NOT NULL AND QUERY_COUNTER IS NOT NULL""",
    "query_clean": """
        SELECT l.* FROM query_lowered l
        WHERE NOT EXISTS (
            SELECT 1 FROM (SELECT JOB_ID, MESSAGE_ID FROM query_lowered
                           GROUP BY JOB_ID, MESSAGE_ID
                           HAVING count(DISTINCT QUERY)
                                  + max(CASE WHEN QUERY IS NULL THEN 1 ELSE 0 END) = 1) s
            WHERE s.JOB_ID IS NOT DISTINCT FROM l.JOB_ID
              AND s.MESSAGE_ID IS NOT DISTINCT FROM l.MESSAGE_ID)""",
    "response_usable": """
        SELECT * FROM response_log WHERE JOB_ID IS NOT NULL AND CV_ID IS NOT NULL
          AND "TIMESTAMP" IS NOT NULL AND RESPONSE_TYPE IS NOT NULL""",
    "response_clean": keep_repeats("response_usable", RESPONSE_COLUMNS),
    "ads_text": f"""
        SELECT row_id, job_id,
               translate(regexp_replace(regexp_replace({squish('text')}, 'mailto:[^ ]+', '', 'g'),
                                        'http[^ ]+', '', 'g'),
                         chr(150) || chr(146), '-''') AS text
        FROM job_ads""",
    "ads": f"""
        SELECT row_id, job_id, text, CAST(length(text) AS INTEGER) AS n_chars,
               {word_count('text')} AS n_words,
               {first_match('text', '^[^.' + chr(92) + 'n]{10,120}')} AS job_title_raw,
               {squish(first_match('text', '^[^.' + chr(92) + 'n]{10,120}'))} AS job_title
        FROM ads_text""",
    "skills": f"""
        SELECT DISTINCT job_id, skill
        FROM (SELECT job_id, lower(nullif({trim_space('skill')}, 'NA')) AS skill FROM skills_raw)
        WHERE skill IS NOT NULL AND skill <> ''""",
    "industry": f"""
        SELECT DISTINCT job_id, company_id, company_name, industry_sector_name,
               TRY_CAST({first_match(f"nullif({trim_space('employee_count')}, 'NA')", '[0-9]+')}
                        AS DOUBLE) AS employee_count
        FROM industry_raw""",
    "locations": f"""
        SELECT location_id,
               TRY_CAST({first_match('location_name', '^[0-9]+')} AS INTEGER) AS postal_code,
               {squish("regexp_replace(location_name, '^[0-9]+[" + SPACE + "]+', '')")}
                   AS city_full
        FROM area_raw""",
    # ---- search behaviour
    "features": f"""
        SELECT row_id, JOB_ID, MESSAGE_ID, CAST(QUERY_COUNTER AS DOUBLE) AS QUERY_COUNTER,
               CAST("TIMESTAMP" AS DOUBLE) AS "TIMESTAMP", TIMESTAMP_FORMATTED, QUERY,
               {word_count('QUERY')} AS token_count,
               {has_boolean('QUERY')} AS contains_boolean,
               regexp_matches(QUERY, '\\*|\\?') AS contains_wildcard
        FROM query_log""",
    "tokens": f"""
        SELECT JOB_ID, count(DISTINCT token) AS unique_token_count
        FROM (SELECT JOB_ID, unnest({words('lower(QUERY)')}) AS token FROM query_log)
        WHERE token <> '' GROUP BY JOB_ID""",
    "sessions_all": """
        SELECT JOB_ID, count(*) AS n_queries, avg(token_count) AS avg_query_length,
               median(token_count) AS median_query_length,
               avg(CAST(coalesce(contains_boolean, false) AS INTEGER)) AS boolean_usage_rate,
               avg(CAST(coalesce(contains_wildcard, false) AS INTEGER)) AS wildcard_usage_rate,
               min("TIMESTAMP") AS session_start, max("TIMESTAMP") AS session_end,
               (max("TIMESTAMP") - min("TIMESTAMP")) / 60 AS session_duration_min,
               max(CASE WHEN up = 1 THEN token_count END) AS first_query_len,
               max(CASE WHEN down = 1 THEN token_count END) AS last_query_len
        FROM (SELECT *, row_number() OVER (PARTITION BY JOB_ID
                                           ORDER BY QUERY_COUNTER, row_id) AS up,
                     row_number() OVER (PARTITION BY JOB_ID
                                        ORDER BY QUERY_COUNTER DESC, row_id DESC) AS down
              FROM features)
        GROUP BY JOB_ID""",
    "sessions": """
        SELECT s.*, t.unique_token_count,
               CASE WHEN session_duration_min <= 60 THEN 'Matching' ELSE 'Recruiting' END
                   AS session_type,
               boolean_usage_rate > 0 AS used_boolean, wildcard_usage_rate > 0 AS used_wildcard
        FROM sessions_all s LEFT JOIN tokens t ON t.JOB_ID IS NOT DISTINCT FROM s.JOB_ID
        WHERE session_duration_min BETWEEN 1 AND 240""",
    # ---- effort and response
    "industry_one": """
        SELECT JOB_ID, coalesce(string_agg(name, ';' ORDER BY first_row), '')
                           AS INDUSTRY_SECTOR_NAME
        FROM (SELECT JOB_ID, INDUSTRY_SECTOR_NAME AS name, min(row_id) AS first_row
              FROM industry_session GROUP BY ALL)
        GROUP BY JOB_ID""",
    "responses": f"""
        SELECT JOB_ID, coalesce(bool_or(RESPONSE_TYPE = 1), false) AS any_positive_response,
               count(*) FILTER (WHERE RESPONSE_TYPE = 1) AS total_positive_responses,
               min(ts) FILTER (WHERE RESPONSE_TYPE = 1) AS first_positive_resp_ts,
               min(ts) AS first_any_response_ts
        FROM (SELECT JOB_ID, RESPONSE_TYPE, {seconds('"TIMESTAMP"')} AS ts FROM response_log)
        GROUP BY JOB_ID""",
    "effort": f"""
        SELECT row_id, JOB_ID, MESSAGE_ID, CAST(QUERY_COUNTER AS INTEGER) AS QUERY_COUNTER,
               {seconds('"TIMESTAMP"')} AS "TIMESTAMP", TIMESTAMP_FORMATTED, QUERY,
               {word_count("coalesce(QUERY, '')")} AS token_count,
               {has_boolean("coalesce(QUERY, '')")} AS contains_boolean,
               regexp_matches(coalesce(QUERY, ''), '\\*|\\?') AS contains_wildcard
        FROM query_log""",
    "bounds": """
        SELECT JOB_ID, min("TIMESTAMP") AS start_ts, max("TIMESTAMP") AS end_ts,
               max("TIMESTAMP") - min("TIMESTAMP") AS duration_s
        FROM effort GROUP BY JOB_ID""",
    "valid": "SELECT * FROM bounds WHERE duration_s BETWEEN 60 AND 14400",
    "valid_effort": """
        SELECT e.* FROM effort e JOIN valid v ON v.JOB_ID IS NOT DISTINCT FROM e.JOB_ID""",
    "stepped": f"""
        SELECT q.*, "TIMESTAMP" - lag("TIMESTAMP") OVER w AS time_gap_s,
               CAST({distance('lag(QUERY) OVER w', 'QUERY')} AS DOUBLE) AS reformulation_dist
        FROM valid_effort q
        WINDOW w AS (PARTITION BY JOB_ID ORDER BY QUERY_COUNTER, row_id)""",
    "waits": """
        SELECT r.JOB_ID, (first_positive_resp_ts - start_ts) / 60
                             AS time_to_first_pos_response_min
        FROM responses r JOIN valid v ON v.JOB_ID IS NOT DISTINCT FROM r.JOB_ID
        WHERE (first_positive_resp_ts - start_ts) / 60 BETWEEN 0 AND 240""",
    "effectiveness": """
        SELECT q.JOB_ID, q.n_queries, q.avg_time_gap_s, q.median_time_gap_s,
               q.avg_reformulation, q.median_reformulation, q.boolean_usage_rate,
               r.any_positive_response, r.total_positive_responses,
               i.INDUSTRY_SECTOR_NAME AS industry_sector, t.time_to_first_pos_response_min
        FROM (SELECT JOB_ID, count(*) AS n_queries, avg(time_gap_s) AS avg_time_gap_s,
                     median(time_gap_s) AS median_time_gap_s,
                     avg(reformulation_dist) AS avg_reformulation,
                     median(reformulation_dist) AS median_reformulation,
                     avg(CAST(contains_boolean AS INTEGER)) AS boolean_usage_rate
              FROM stepped GROUP BY JOB_ID) q
        LEFT JOIN responses r ON r.JOB_ID IS NOT DISTINCT FROM q.JOB_ID
        LEFT JOIN industry_one i ON i.JOB_ID IS NOT DISTINCT FROM q.JOB_ID
        LEFT JOIN waits t ON t.JOB_ID IS NOT DISTINCT FROM q.JOB_ID""",
    "efficiency": """
        SELECT industry_sector, count(*) AS sessions,
               avg(time_to_first_pos_response_min) AS mean_time_to_first_pos_response_min
        FROM effectiveness
        WHERE industry_sector IS NOT NULL AND NOT contains(industry_sector, ';')
          AND time_to_first_pos_response_min > 0
        GROUP BY industry_sector""",
    # ---- skills and jobs
    "terms": f"""
        SELECT DISTINCT job_id, regexp_replace(term, '[-_ ]', '', 'g') AS term_clean
        FROM (SELECT job_id, unnest({words(
            "lower(replace(regexp_replace(query, '[+()" + chr(34) + "'']', ' ', 'g'), '*', ''))"
        )}) AS term FROM job_queries)
        WHERE term <> ''""",
    "concepts": f"SELECT job_id, skill, {concept('skill')} AS skill_clean FROM skills",
    "overlap": """
        SELECT s.job_id, s.skill, s.skill_clean,
               CAST(CASE WHEN t.term_clean IS NULL THEN 0 ELSE 1 END AS INTEGER) AS skill_queried
        FROM (SELECT DISTINCT * FROM concepts) s
        LEFT JOIN terms t ON t.job_id = s.job_id AND t.term_clean = s.skill_clean""",
    "overview": """
        SELECT skill, skill_clean, count(*) AS n_jobs_with_skill,
               CAST(sum(skill_queried) AS BIGINT) AS n_jobs_where_queried,
               CAST(sum(skill_queried) AS DOUBLE) / count(*) AS share_queried
        FROM overlap GROUP BY skill, skill_clean""",
    "coverage": """
        SELECT job_id, count(*) AS n_skills, CAST(sum(skill_queried) AS BIGINT) AS n_skills_queried,
               CAST(sum(skill_queried) AS DOUBLE) / count(*) AS share_skills_queried
        FROM overlap GROUP BY job_id""",
    "per_job": "SELECT job_id, count(*) AS n_skills FROM skills GROUP BY job_id",
    "freq": "SELECT skill, count(*) AS n FROM skills GROUP BY skill",
    "concept_counts": """
        SELECT skill_clean, count(*) AS total_frequency FROM concepts GROUP BY skill_clean""",
    "company": """
        SELECT DISTINCT job_id, company_id, company_name, industry_sector_name FROM industry""",
    "master": """
        SELECT a.job_id, a.text, a.job_title_raw, a.job_title, a.n_words, a.n_chars, c.company_id, c.company_name,
               c.industry_sector_name, s.skill
        FROM ads a LEFT JOIN company c ON c.job_id = a.job_id
        LEFT JOIN skills s ON s.job_id = a.job_id""",
    "level": """
        SELECT job_id, job_title, company_id, company_name, industry_sector_name,
               count(DISTINCT skill) + max(CASE WHEN skill IS NULL THEN 1 ELSE 0 END) AS n_skills,
               max(n_words) AS n_words, max(n_chars) AS n_chars
        FROM master
        GROUP BY job_id, job_title, company_id, company_name, industry_sector_name""",
    "scored": """
        SELECT l.*, 0.5 * (n_words - mw) / sw + 0.5 * (n_skills - ms) / ss AS efficiency_score
        FROM level l CROSS JOIN (
            SELECT avg(n_words) AS mw, stddev_samp(n_words) AS sw,
                   avg(n_skills) AS ms, stddev_samp(n_skills) AS ss FROM level)""",
    "job_city": """
        SELECT d.doc_id AS job_id, l.city_full AS location_name
        FROM documents d CROSS JOIN (SELECT count(*) AS n FROM customer) c
        LEFT JOIN locations l ON l.location_id = d.doc_id % c.n + 1""",
}
