from __future__ import annotations

import os
import sys

import pytest
from conftest import ROOT

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import comparable, connect  # noqa: E402
from oracles.statements import ORACLES  # noqa: E402
from querytrail.operators import smooth  # noqa: E402
from querytrail.plans.registry import QUERIES  # noqa: E402
from test_smooth import plain_curve  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


# A penalised fit is not a SQL statement; it is held against a plain solve.
WITHOUT_SQL = {"complexity_smooth"}


def test_every_query_has_a_statement():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark, duck):
    statement = entry.oracle_sql()["session_summary"]
    expected = duck.execute(f"SELECT count(*) FROM ({statement})").fetchall()[0][0]
    assert entry.entry(spark).count() == expected > 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(
        cursor.fetchall(), columns)


def test_smooth_curve_of_the_tables(spark, duck):
    """The curve of the points that the SQL of the table gives."""
    statement = ORACLES["complexity_by_employee_count"]
    pairs = duck.execute(f"""SELECT employee_count::DOUBLE, avg_skills FROM ({statement})
        WHERE employee_count IS NOT NULL AND avg_skills IS NOT NULL""").fetchall()
    places, fit, _ = plain_curve(*zip(*pairs), 80, smooth.SEGMENTS)
    rows = entry.queries()["complexity_smooth"](spark, FOLDER).orderBy("point").collect()
    assert [r["x"] for r in rows] == pytest.approx(list(places), abs=1e-5)
    assert [r["fit"] for r in rows] == pytest.approx(list(fit), abs=1e-5)
