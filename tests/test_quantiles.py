"""Quantiles by sketch and refinement against sorted lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from querytrail.operators import plotdata

PROBABILITIES = [0.0, 0.25, 0.5, 0.77, 1.0]


def plain(values, p):
    ranked = sorted(values)
    place = (len(ranked) - 1) * p
    low, high = ranked[math.floor(place)], ranked[math.ceil(place)]
    share = place - math.floor(place)
    return low if share == 0 else low * (math.ceil(place) - place) + high * share


def groups():
    rng = random.Random(6)
    return {
        "one": [7.0], "two": [1.0, 2.0], "ties": [3.0] * 500 + [4.0] * 499,
        "skewed": [rng.expovariate(1e-3) for _ in range(3000)],
        "mostly one": [5.0] * 2000 + [rng.random() for _ in range(700)],
        None: [rng.gauss(0, 1) for _ in range(900)], "signs": [-math.inf, -1.0, 0.0, 1.0, math.inf],
    }


def check(got, data):
    assert set(got) == set(data)
    for name, values in data.items():
        assert got[name].n_values == len(values)
        for q, p in zip(got[name].q, PROBABILITIES, strict=True):
            assert q == pytest.approx(plain(values, p), rel=1e-12), (name, p)


@pytest.mark.parametrize("settings", [
    {}, {"ACCURACY": 50, "MOST_INSIDE": 20}, {"ACCURACY": 20, "MOST_INSIDE": 3, "CUTS": 4}])
def test_quantiles_match_sorted_lists(spark, frame, monkeypatch, settings):
    """Coarse sketches make every way of narrowing and giving up bounds happen."""
    for name, value in settings.items():
        monkeypatch.setattr(plotdata, name, value)
    data = groups()
    rows = [(name, v) for name, values in data.items() for v in [*values, None]] + [("empty", None)]
    random.Random(7).shuffle(rows)
    df = frame(rows, "kind string, v double").repartition(5)
    got = plotdata.quantiles(df, F.col("v"), PROBABILITIES, ["kind"]).collect()
    check({r.kind: r for r in got}, data)


def test_quantiles_of_all_rows_and_of_whole_numbers(spark):
    df = spark.range(10_001).select((F.col("id") * 3).alias("v"))
    row, = plotdata.quantiles(df, F.col("v"), PROBABILITIES).collect()
    assert row.n_values == 10_001 and row.q == [plain(range(0, 30_003, 3), p) for p in PROBABILITIES]
    assert plotdata.quantiles(df.where("v < 0"), F.col("v"), [0.5]).count() == 0


def test_approximate_quantiles_keep_their_error(spark, monkeypatch):
    monkeypatch.setattr(plotdata, "ACCURACY", 100)
    df = spark.range(50_000).select(F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("v"))
    values = sorted(r.v for r in df.collect())
    row, = plotdata.quantiles(df, F.col("v"), [0.1, 0.5, 0.9], exact=False).collect()
    for q, p in zip(row.q, [0.1, 0.5, 0.9], strict=True):
        rank = sum(v <= q for v in values)
        assert abs(rank - p * len(values)) <= len(values) / 100 + 2


def test_no_values_are_sorted_or_range_partitioned(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    plan = plotdata.quantiles(df, F.col("v"), [0.5], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "RepartitionByExpression" not in plan
    assert not [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Sort ")]
