"""The corpus queries against their SQL, and the registry."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import comparable, connect  # noqa: E402
from querytrail.llm.registry import ORACLES, QUERIES  # noqa: E402

from .conftest import SMALL  # noqa: E402


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    cursor = connect(SMALL).execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(
        cursor.fetchall(), columns)
