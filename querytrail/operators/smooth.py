"""A penalised regression spline: the smooth curve through a scatter of points."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .plotdata import t_quantile

SEGMENTS = 10
PIECES = 4  # cubic pieces that are not zero within a segment
# Penalties that are tried, against the scale of the data: 1e-6 to 1e6 in eighths of a power.
PENALTIES = [10 ** (step / 8) for step in range(-48, 49)]
# Scores this close are equal, and the stiffer curve is taken.
TIE = 1e-9


class Spline(NamedTuple):
    weights: np.ndarray
    spread: np.ndarray      # of the weights, for one unit of residual variance
    variance: float
    freedom: float
    penalty: float


def pieces(u: Column | np.ndarray) -> list:
    """The cubic pieces at a place from 0 to 1 within a segment; they sum to 1."""
    return [(1 - u) * (1 - u) * (1 - u) / 6,
            ((3 * u - 6) * u * u + 4) / 6,
            (((-3 * u + 3) * u + 3) * u + 1) / 6,
            u * u * u / 6]


def segment_sums(pairs: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Products of pieces and values summed per segment of equal width: all a fit needs.

    ``pairs`` has ``x`` and ``y``, both present. At most ``segments`` rows, combined before
    their shuffle, each with the ends of ``x`` and the mean of ``y``, about which ``y`` is taken.
    """
    ends = pairs.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high"),
                              F.avg("y").alias("middle"))).scalar()
    at = (F.col("x") - F.col("ends.low")) / (F.col("ends.high") - F.col("ends.low")) * segments
    placed = (pairs.withColumn("ends", ends).where("ends.low < ends.high")
              .withColumn("segment", F.least(F.floor(at), F.lit(segments - 1)).cast("int"))
              .withColumn("u", at - F.col("segment"))
              .withColumn("y", F.col("y") - F.col("ends.middle")))
    piece = pieces(F.col("u"))
    return placed.groupBy("segment", "ends").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.array(*[F.sum(p * F.col("y")) for p in piece]).alias("by"),
        F.array(*[F.sum(p * q) for p in piece for q in piece]).alias("bb"))


def fit_spline(n: int, yy: float, by: np.ndarray, bb: np.ndarray) -> Spline:
    """Weights of the pieces, with the penalty of the least generalised cross-validation.

    The penalty is on second differences of neighbouring weights, so a stiff curve becomes a
    straight line. Of penalties that leave less than one degree of freedom none is tried, but
    for the stiffest.
    """
    rough = np.diff(np.eye(len(by)), n=2, axis=0)
    rough = rough.T @ rough
    scale = np.trace(bb) / np.trace(rough)
    best, least = None, np.inf
    for penalty in reversed(PENALTIES):
        inverse = np.linalg.inv(bb + penalty * scale * rough)
        weights = inverse @ by
        rest = max(0.0, yy - 2 * weights @ by + weights @ bb @ weights)
        freedom = n - np.trace(inverse @ bb)
        if best is not None and freedom < 1:
            break
        score = n * rest / freedom ** 2 if freedom >= 1 else np.inf
        if best is None or score < least - TIE * (least + yy / n):
            variance = rest / freedom if freedom >= 1 else np.nan
            best, least = Spline(weights, inverse, variance, freedom, penalty), score
    return best


def smooth_curve(df: DataFrame, x: str, y: str, points: int = 80, level: float = 0.95,
                 segments: int = SEGMENTS) -> DataFrame:
    """``point, x, fit, lower, upper``: a smooth curve at places between the ends of ``x``.

    Least squares over cubic pieces on ``segments`` equal segments, held smooth by a penalty
    that generalised cross-validation picks. The rows go into one small aggregate; the
    driver gets its ``segments`` rows of sums, however many rows there are. ``lower`` and
    ``upper`` bound the curve with confidence ``level``, and are NULL where less than one degree
    of freedom is left. Pairs with a missing value are left out; without a spread in ``x``
    there are no rows. Rows may repeat: each counts.
    """
    pairs = stored(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                   .where("x IS NOT NULL AND y IS NOT NULL"))
    sums = segment_sums(pairs, segments).orderBy("segment").collect()  # at most ``segments`` rows
    rows: list[tuple] = []
    if sums:
        size = segments + PIECES - 1
        by, bb = np.zeros(size), np.zeros((size, size))
        for row in sums:
            own = slice(row["segment"], row["segment"] + PIECES)
            by[own] += row["by"]
            bb[own, own] += np.reshape(row["bb"], (PIECES, PIECES))
        spline = fit_spline(sum(r["n"] for r in sums), sum(r["yy"] for r in sums), by, bb)
        low, high, middle = sums[0]["ends"]
        for point in range(points):
            at = point / (points - 1) * segments
            segment = min(int(at), segments - 1)
            piece = np.array(pieces(at - segment))
            own = slice(segment, segment + PIECES)
            error = np.sqrt(spline.variance * (piece @ spline.spread[own, own] @ piece))
            rows.append((point, low + (high - low) * point / (points - 1),
                         float(middle + piece @ spline.weights[own]),
                         None if np.isnan(error) else float(error), int(spline.freedom)))
    schema = T.StructType([
        T.StructField("point", T.IntegerType()), T.StructField("x", T.DoubleType()),
        T.StructField("fit", T.DoubleType()), T.StructField("error", T.DoubleType()),
        T.StructField("freedom", T.LongType())])
    reach = t_quantile(F.col("freedom"), level) * F.col("error")
    return df.sparkSession.createDataFrame(rows, schema).select(
        "point", "x", "fit", (F.col("fit") - reach).alias("lower"),
        (F.col("fit") + reach).alias("upper"))
