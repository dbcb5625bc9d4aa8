"""The smooth curve against a plain solve over the whole design matrix."""

from __future__ import annotations

import numpy as np
import pytest

from querytrail.operators import smooth


def design(x, low, high, segments):
    at = (x - low) / (high - low) * segments
    segment = np.minimum(np.floor(at), segments - 1).astype(int)
    matrix = np.zeros((len(x), segments + 3))
    for i, (s, u) in enumerate(zip(segment, at - segment)):
        matrix[i, s:s + 4] = smooth.pieces(u)
    return matrix


def plain_curve(x, y, points, segments):
    """Every penalty solved as least squares over stacked rows; least cross-validation wins."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    low, high, middle = x.min(), x.max(), y.mean()
    b = design(x, low, high, segments)
    d = np.diff(np.eye(segments + 3), n=2, axis=0)
    scale = np.sum(b * b) / np.sum(d * d)
    best = None
    for penalty in smooth.PENALTIES:
        root = np.sqrt(penalty * scale) * d
        stacked = np.vstack([b, root])
        weights = np.linalg.lstsq(stacked, np.concatenate([y - middle, np.zeros(len(d))]),
                                  rcond=None)[0]
        inverse = np.linalg.inv(stacked.T @ stacked)
        freedom = len(x) - np.trace(b @ inverse @ b.T)
        rest = np.sum((y - middle - b @ weights) ** 2)
        score = len(x) * rest / freedom ** 2
        if freedom >= 1 and (best is None or score < best[0]):
            best = score, weights, inverse, rest / freedom
    places = np.linspace(low, high, points)
    at = design(places, low, high, segments)
    return (places, middle + at @ best[1],
            np.sqrt(best[3] * np.einsum("ij,jk,ik->i", at, best[2], at)))


@pytest.mark.parametrize("seed, n", [(1, 40), (2, 400), (3, 3000)])
def test_curve_is_that_of_a_plain_solve(spark, seed, n):
    random = np.random.default_rng(seed)
    x = np.round(random.gamma(2.0, 30.0, n), 2)
    y = 5000 + np.sin(x / 15) * 4 + random.normal(0, 1, n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    rows = smooth.smooth_curve(df, "x", "y").orderBy("point").collect()
    places, fit, error = plain_curve(x, y, 80, smooth.SEGMENTS)
    assert [r["point"] for r in rows] == list(range(80))
    assert np.allclose([r["x"] for r in rows], places)
    assert np.allclose([r["fit"] for r in rows], fit, atol=1e-6)
    reach = np.array([(r["upper"] - r["lower"]) / 2 for r in rows]) / error
    assert np.allclose(reach, reach[0]) and 1.95 < reach[0] < 2.1


def test_straight_line_stays_one(frame):
    df = frame([(i, 2 * i + 1) for i in range(50)] + [(None, 3), (4, None)], "x int, y int")
    for r in smooth.smooth_curve(df, "x", "y", points=11).collect():
        assert r["fit"] == pytest.approx(2 * r["x"] + 1, abs=1e-6)
        assert r["lower"] <= r["fit"] <= r["upper"]


def test_repeated_rows_weigh_and_gaps_are_bridged(frame):
    """Rows at both ends only: the segments between have no row."""
    df = frame([(0.0, 0.0)] * 30 + [(1.0, 1.0)] * 10 + [(100.0, 100.0)] * 30, "x double, y double")
    for r in smooth.smooth_curve(df, "x", "y", points=5).collect():
        assert r["fit"] == pytest.approx(r["x"], abs=1e-3)


def test_too_few_points(frame):
    empty = frame([], "x double, y double")
    single = frame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    pair = frame([(0.0, 0.0), (1.0, 2.0)], "x double, y double")
    assert smooth.smooth_curve(empty, "x", "y").count() == 0
    assert smooth.smooth_curve(single, "x", "y").count() == 0
    rows = smooth.smooth_curve(pair, "x", "y", points=3).orderBy("point").collect()
    assert [r["fit"] for r in rows] == pytest.approx([0, 1, 2], abs=1e-4)
    assert all(r["lower"] is None for r in rows)
