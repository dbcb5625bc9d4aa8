from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows_of
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querytrail.functions import columns as C
from querytrail.functions import text as X
from querytrail.functions import timecols as M


def value(frame, text, make):
    return frame([(text,)], "x string").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, expected", [
    ("a b c", 3), ("", 0), (None, None), ("  one  ", 1), ("two\twords\n", 2)])
def test_word_count(frame, text, expected):
    assert value(frame, text, X.word_count) == expected


@pytest.mark.parametrize("text, expected", [
    ("føor", False), ("a or b", True), ("e-mail", True), ("c++", True), ("a|b", True),
    ("nothing", False), ("AND", False), (None, None), ("not", True)])
def test_has_boolean(frame, text, expected):
    assert value(frame, text, X.has_boolean) is expected


@pytest.mark.parametrize("text, expected", [
    ("what?", True), ("develop*", True), ("plain", False), (None, None)])
def test_has_wildcard(frame, text, expected):
    assert value(frame, text, X.has_wildcard) is expected


@pytest.mark.parametrize("text, expected", [
    ("\t a   b\n", "a b"), ("", ""), (None, None), ("x", "x")])
def test_squish(frame, text, expected):
    assert value(frame, text, X.squish) == expected


def test_trim_takes_tabs(frame):
    assert value(frame, "\t a  b  ", X.trim_space) == "a  b"


@pytest.mark.parametrize("text, expected", [
    ("write mailto:a@b.dk now", "write  now"),
    ("see http://x.y/z", "see "),
    ("a\u0096b it\u0092s", "a-b it's"),
    ("  many   blanks ", "many blanks")])
def test_clean_ad_text(frame, text, expected):
    assert value(frame, text, X.clean_ad_text) == expected


@pytest.mark.parametrize("text, expected", [
    ("short", None), ("Software engineer wanted. Apply", "Software engineer wanted"),
    ("x" * 200, "x" * 120)])
def test_title(frame, text, expected):
    assert value(frame, text, lambda c: X.match_or_null(c, X.TITLE)) == expected


@pytest.mark.parametrize("text, expected", [
    ("Front-End dev_ops", "frontenddevops"), ("-", ""), (None, None)])
def test_concept(frame, text, expected):
    assert value(frame, text, X.concept) == expected


def test_search_terms(frame):
    got = value(frame, "+(Java \"SQL\") develop* 'C' java -", X.search_terms)
    assert got == ["java", "sql", "develop", "c", "-"]


@pytest.mark.parametrize("text, expected", [
    ("1609459200000", 1609459200.0), ("1609459200", 1609459200.0), ("0", None), ("-5", None),
    ("x", None), (None, None)])
def test_unit_repair(frame, text, expected):
    assert value(frame, text, M.fix_timestamp_units) == expected


@pytest.mark.parametrize("text, expected", [("1.9", 1), ("-1.9", -1), ("x", None), ("NaN", None)])
def test_as_integer(frame, text, expected):
    assert value(frame, text, M.as_integer) == expected


DATETIMES = [
    ('20100101120101', '2010-01-01 12:01:01'),
    ('2009-01-02 12-01-02', '2009-01-02 12:01:02'),
    ('2009.01.03 12:01:03', '2009-01-03 12:01:03'),
    ('2009-1-4 12-1-4', '2009-01-04 12:01:04'),
    ('2009-1, 5 12:1, 5', '2009-01-05 12:01:05'),
    ('200901-08 1201-08', '2009-01-08 12:01:08'),
    ('2009 arbitrary 1 non-decimal 6 chars 12 in between 1 !!! 6', '2009-01-06 12:01:06'),
    ('OR collapsed formats: 20090107 120107 (as long as prefixed with zeros)', '2009-01-07 12:01:07'),
    ('Automatic wday, Thu, detection, 10-01-10 10:01:10 and p format: AM', '2010-01-10 10:01:10'),
    ('Created on 10-01-11 at 10:01:10 PM', '2010-01-11 22:01:10'),
    ('21-03-05 10:11:12', '2021-03-05 10:11:12'),
    ('20210305 101112', '2021-03-05 10:11:12'),
    ('2021.03.05 10.11.12', '2021-03-05 10:11:12'),
    ('210305101112', '2021-03-05 10:11:12'),
    ('210305 101112', '2021-03-05 10:11:12'),
    ('2021-Mar-05 10:11:12', '2021-03-05 10:11:12'),
    ('2021 March 5, 10:11:12', '2021-03-05 10:11:12'),
    ('2021mar05 101112', '2021-03-05 10:11:12'),
    ('2021-03-05T10:11:12Z', '2021-03-05 10:11:12'),
    ('2021-03-05T10:11:12+02:00', '2021-03-05 08:11:12'),
    ('2021-03-05 10:11:12 -0530', '2021-03-05 15:41:12'),
    ('2021-03-05 10:11:12+01', '2021-03-05 09:11:12'),
    ('2021-03-05 10:11:12.750', '2021-03-05 10:11:12.75'),
    ('2021-03-05T10:11:12,5Z', '2021-03-05 10:11:12.5'),
    ('2021/3/5 1:1:2', '2021-03-05 01:01:02'),
    ('2021-03-05 12:00:00 AM', '2021-03-05 00:00:00'),
    ('2021-03-05 12:00:00 pm', '2021-03-05 12:00:00'),
    ('2021-03-05 1:02:03 p.m.', '2021-03-05 13:02:03'),
    ('69-12-31 23:59:59', '1969-12-31 23:59:59'),
    ('68-12-31 23:59:59', '2068-12-31 23:59:59'),
    ('2021_03_05_10_11_12', '2021-03-05 10:11:12'),
    ('2020-02-29 00:00:00', '2020-02-29 00:00:00'),
    ('2021-03-05 10h11m12s', '2021-03-05 10:11:12'),
    ('  2021-03-05 10:11:12  ', '2021-03-05 10:11:12'),
    ('2021-03-05 10:11:12 UTC', '2021-03-05 10:11:12'),
    ('[2021-03-05 10:11:12]', '2021-03-05 10:11:12'),
    ('2021-03-05', None),
    ('2021-03-05 10:11', None),
    ('2021-13-05 10:11:12', None),
    ('2021-02-29 10:11:12', None),
    ('2021-03-05 25:11:12', None),
    ('2021-03-05 10:61:12', None),
    ('yesterday', None),
    ('', None),
    (None, None),
    ('2021-03-05 13:02:03 PM', None),
    ('1|2|3|4|5|6|7|8|9', None),
    ('2021-03-05 10:11:12 99', None),
    ('202103051011', None),
    ('2021-03-05 0:00:00 AM', None),
    ('x|y', None)]


def test_datetimes_by_order(frame):
    """Each of the forms, by the whole parser and without its short cut."""
    df = frame(DATETIMES, "text string, expected string")
    text = F.col("text")
    got = df.select("text", "expected", M.parse_datetime(text).cast("string").alias("whole"),
                    M._by_order(F.trim(text)).cast("string").alias("pattern")).collect()
    assert [(r.text, r.whole, r.pattern) for r in got] == [
        (text, expected, expected) for text, expected in DATETIMES]


def test_long_cells_are_parsed_in_time(frame):
    cells = ["2021-03-05 10:11:12 " + "am - " * 20_000 + "7", "a-" * 50_000, "1 " * 50_000]
    assert [value(frame, cell, M.parse_datetime) for cell in cells] == [None] * 3


def test_parse_datetime_bad(frame):
    assert value(frame, "yesterday", M.parse_datetime) is None


def test_parse_datetime_takes_timestamps(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 2),)], "x timestamp")
    assert df.select(M.datetime_text(M.parse_datetime(F.col("x")))).first()[0] \
        == "2021-01-02 00:00:00"


NAMES = [
    ('JOB_ID', 'job_id'),
    ('Location Name', 'location_name'),
    ('employeeCount', 'employee_count'),
    ('2nd col', 'x2nd_col'),
    ('Størrelse', 'storrelse'),
    ('Æble %', 'aeble_percent'),
    ('Årsløn (kr.)', 'arslon_kr'),
    ('Jobområde', 'jobomrade'),
    ('Stillingsbetegnelse', 'stillingsbetegnelse'),
    ('Øre/time', 'ore_time'),
    ('Antal søgninger pr. måned', 'antal_sogninger_pr_maned'),
    ('Virksomhed #', 'virksomhed_number'),
    ('% af alle', 'percent_af_alle'),
    ('#', 'number'),
    ('Straße', 'strasse'),
    ('GROẞ', 'gross'),
    ('Größe', 'grosse'),
    ('São Paulo', 'sao_paulo'),
    ('Łódź', 'lodz'),
    ('Đorđe', 'dorde'),
    ('þorn Þing', 'thorn_thing'),
    ('garðr', 'gardr'),
    ('Œuvre', 'oeuvre'),
    ('ısı', 'isi'),
    ('Ñandú', 'nandu'),
    ('naïve café', 'naive_cafe'),
    ("don't", 'dont'),
    ('the "best"', 'the_best'),
    ('it’s', 'its'),
    ('ﬁnal', 'final'),
    ('Ⅳ', 'iv'),
    ('x²', 'x2'),
    ('URLName', 'url_name'),
    ('someURLName', 'some_url_name'),
    ('HTTPServerID', 'http_server_id'),
    ('ABC', 'abc'),
    ('aB', 'a_b'),
    ('__x__', 'x'),
    (' padded ', 'padded'),
    ('a--b..c', 'a_b_c'),
    ('', 'x'),
    ('...', 'x'),
    ('Ελλάδα', 'epsilonlamdalamdaalphadeltaalpha'),
    ('ÆØÅ', 'aeoa'),
    ('kr€', 'kr'),
    ('100%', 'x100_percent')]


@pytest.mark.parametrize("name, expected", NAMES)
def test_snake_case(name, expected):
    assert C.snake_case(name) == expected
    assert C.snake_case(expected) == expected


def test_danish_headers_stay_apart(frame):
    df = frame([(1, 2, 3, 4, 5)], "`Størrelse` int, `Storrelse` int, `Storrelse 2` int, `Æ` int, `Ø` int")
    assert C.clean_names(df).columns == ["storrelse", "storrelse_2", "storrelse_2_2", "ae", "o"]
    assert C.clean_names(C.clean_names(df)).columns == C.clean_names(df).columns


@given(st.text(max_size=20))
def test_snake_case_is_stable(name):
    once = C.snake_case(name)
    assert C.snake_case(once) == once


def test_clean_names_are_unique(frame):
    df = C.clean_names(frame([(1, 2, 3)], "`JOB ID` int, job_id int, Text int"))
    assert df.columns == ["job_id", "job_id_2", "text"]


def test_pick_column(frame):
    df = frame([(1, 2)], "a int, b int")
    assert C.pick_column(df, ["z", "b", "a"]) == "b"
    assert C.pick_column(df, ["z"]) is None


def test_index_and_empty_columns(frame):
    df = frame([(1, None, 2), (2, None, None)], "`...1` int, e string, v int")
    assert C.without_index_columns(df).columns == ["e", "v"]
    assert rows_of(C.without_empty_columns(df).select("v")) == [(2,), (None,)]
    assert "e" not in C.without_empty_columns(df).columns


def test_edit_distance_equals_the_whole_table(spark):
    """Texts on both sides of every bound, a few edits or none in common."""
    rng = random.Random(8)
    rows = [(None, "a"), ("a", None), ("", ""), ("", "x" * 300), ("æøå", "aeoeaa")]
    for size in (5, 60, 95, 97, 400, 770, 2500):
        text = "".join(rng.choices("abcdeæø ", k=size))
        for edits in (0, 1, 15, 16, 17, 129, 2 * size):
            other = list(text)
            for _ in range(min(edits, 1500)):
                other[rng.randrange(len(other))] = rng.choice("xyz")
            rows.append((text, "".join(other[rng.randrange(3):])))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(X.edit_distance(F.col("a"), F.col("b")).alias("got"),
                    F.levenshtein("a", "b").alias("whole")).collect()
    assert [r.got for r in got] == [r.whole for r in got]
    assert sum(r.whole is None for r in got) == 2


def test_empty_columns_are_found_while_writing(spark, frame):
    """One job, and what follows reads the written table, not the frame's own plan."""
    df = frame([(1, None, 2), (2, None, None)], "a int, e string, v int")
    spark.sparkContext.setJobGroup("empty-columns", "")
    try:
        kept = C.without_empty_columns(df.repartition(2))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Adaptive execution runs the shuffle's stage as a job of its own.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("empty-columns")) <= 2
    assert kept.columns == ["a", "v"] and len(kept.inputFiles()) > 0
    assert C.without_empty_columns(df.where("false")).columns == []
