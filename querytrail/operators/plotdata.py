"""The numbers behind histograms, trend lines and box plots."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .joins import null_safe_join

ALL = "_all"
# A sketch knows the rank of a value to this part of the rows; a further one cuts an interval
# in so many pieces; so many values between two bounds are listed in a row.
ACCURACY = 10_000
CUTS = 64
MOST_INSIDE = 10_000
# Degrees of freedom from which the expansion of the t quantile is used, and halvings before.
SERIES_FROM = 120
HALVINGS = 60


def value_counts(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value (and group); the compact input of the statistics below."""
    return (df.select(*by, value.alias("value")).where(F.col("value").isNotNull())
            .groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, value: Column, bins: int, by: Sequence[str] = (),
              within: tuple[float, float] | None = None, centre: bool = False) -> DataFrame:
    """Equal-width bins between the smallest and the largest value.

    ``bin`` counts from 0 and the last one includes its upper edge; empty bins are
    left out. Groups in ``by`` share the edges. ``within`` limits what is binned;
    ``centre`` adds mean and median of all values, binned or not.

    Values are counted before they are binned, so the second pass (over the value
    counts, whose exchange the two passes share) is as small as the number of
    distinct values.
    """
    counts = value_counts(df, value, by)
    binnable = F.col("value").between(*within) if within else F.lit(True)
    kept = F.when(binnable, F.col("value")).cast("double")
    measures = [F.min(kept).alias("low"), F.max(kept).alias("high"),
                (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean_value")]
    if centre:
        measures.append(F.percentile("value", F.lit(0.5), F.col("n")).alias("median_value"))
    stats = counts.agg(F.struct(*measures).alias("stats")).scalar()

    placed = counts.where(binnable).withColumn("stats", stats).select(
        *by, "value", "n", F.col("stats.low").alias("low"),
        ((F.col("stats.high") - F.col("stats.low")) / bins).alias("width"),
        *([F.col("stats.mean_value"), F.col("stats.median_value")] if centre else []))
    index = F.when(F.col("width") > 0, F.least(
        F.floor((F.col("value") - F.col("low")) / F.col("width")), F.lit(bins - 1))).otherwise(0)
    extra = ["mean_value", "median_value"] if centre else []
    return (placed.withColumn("bin", index.cast("int"))
            .groupBy(*by, "bin", "low", "width", *extra).agg(F.sum("n").alias("n"))
            .select(*by, "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
                    (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
                    "n", *extra))


def quantiles(df: DataFrame, value: Column, probabilities: Sequence[float],
              by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Quantiles ``q`` and ``n_values`` per group, for values of which there may be many.

    A sketch per group, merged from those of the tasks, bounds each quantile by two values. A
    second aggregate counts what lies below and between them: that shows whether the bounds
    hold, whatever the sketch did, and what lies between is few enough to find the exact
    ranks in it. Where more lies between, a further sketch narrows the interval first. No
    values are sorted or shuffled but the few between bounds, once each, with their counts.

    Between two ranks the quantile is interpolated. Groups without a value are left out, NULL
    is a group. ``exact=False`` takes the sketch's own answer, a value whose rank is off by at
    most 1 / ACCURACY of the group's rows, in one aggregate.
    """
    keys = list(by) or [ALL]
    values = df.withColumn(ALL, F.lit(0)).select(*keys, value.alias("value")).where(
        F.col("value").isNotNull())
    if not exact:
        return values.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_values"), F.percentile_approx(
                "value", list(probabilities), ACCURACY).cast("array<double>").alias("q")).drop(ALL)
    values = stored(values)
    margin = 2 / ACCURACY
    ends = [end for p in probabilities for end in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"), F.min("value").alias("least"),
        F.max("value").alias("most"), F.percentile_approx("value", ends, ACCURACY).alias("ends"))
    intervals = stored(sketch.select(*keys, "n_values", "least", "most", F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.col("ends")[2 * i].alias("low"),
                 F.col("ends")[2 * i + 1].alias("high")) for i, p in enumerate(probabilities)]))))
    while True:
        met = _in_intervals(values, intervals, keys)
        measured = stored(null_safe_join(intervals, met.groupBy(*keys, "i").agg(
            F.count_if(F.col("value") < F.col("low")).alias("below"),
            F.count_if(F.col("value") >= F.col("low")).alias("inside")), [*keys, "i"]))
        place = (F.col("n_values") - 1) * F.col("p")
        first, last = F.floor(place), F.ceil(place)
        missed = (first < F.col("below")) | (last >= F.col("below") + F.col("inside"))
        wide = (F.col("inside") > MOST_INSIDE) & (F.col("low") < F.col("high"))
        state = measured.agg(F.bool_or(missed).alias("missed"), F.bool_or(wide).alias("wide")).first()
        if not state["missed"] and not state["wide"]:
            break
        # Bounds that do not hold are given up; wide ones are narrowed by a sketch of their own.
        cuts = _in_intervals(values, measured.where(wide & ~missed), keys).where(
            "value >= low").groupBy(*keys, "i").agg(F.percentile_approx(
                "value", [c / CUTS for c in range(CUTS + 1)], ACCURACY).alias("cuts"))
        known = null_safe_join(measured, cuts, [*keys, "i"])
        down = F.floor((first - F.col("below")) / F.col("inside") * CUTS) - 1
        up = F.ceil((last + 1 - F.col("below")) / F.col("inside") * CUTS) + 1
        low = F.get("cuts", F.greatest(down, F.lit(0)).cast("int"))
        high = F.get("cuts", F.least(up, F.lit(CUTS)).cast("int"))
        moved = known.select(
            *keys, "n_values", "least", "most", "i", "p", F.when(missed, F.col("least")).otherwise(
                F.coalesce(low, "low")).alias("low"), F.when(missed, F.col("most")).otherwise(
                F.coalesce(high, "high")).alias("high"))
        same = (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))
        moved = stored(null_safe_join(moved, measured.select(
            *keys, "i", F.col("low").alias("_low"), F.col("high").alias("_high")), [*keys, "i"]))
        intervals = moved.drop("_low", "_high")
        if moved.where(~same).isEmpty():
            break  # a value that more rows share than a sketch tells apart

    between = met.where("value >= low").groupBy(*keys, "i", "value").agg(
        F.count(F.lit(1)).alias("n")).groupBy(*keys, "i").agg(
            F.sort_array(F.collect_list(F.struct("value", "n"))).alias("inner"))
    found = null_safe_join(measured, between, [*keys, "i"])

    def at(rank: Column) -> Column:
        """The value of a rank, from the counted values between the bounds."""
        return F.aggregate(
            F.col("inner"), F.struct(F.col("below").alias("seen"), F.col("least").alias("value")),
            lambda acc, x: F.struct(
                (acc["seen"] + x["n"]).alias("seen"),
                F.when(acc["seen"] <= rank, x["value"]).otherwise(acc["value"]).alias("value")),
            lambda acc: acc["value"])

    share = place - first
    quantile = F.when(share == 0, at(first).cast("double")).otherwise(
        at(first) * (last - place) + at(last) * share)
    return found.select(*keys, "n_values", "i", quantile.alias("quantile")).groupBy(
        *keys, "n_values").agg(F.transform(F.sort_array(F.collect_list(
            F.struct("i", "quantile"))), lambda x: x["quantile"]).alias("q")).drop(ALL)


def _in_intervals(values: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every value up to the upper end of an interval of its group, once per such interval."""
    parts = intervals.groupBy(*keys).agg(
        F.collect_list(F.struct("i", "low", "high")).alias("parts"))
    return null_safe_join(values, parts, keys, "inner").select(
        *keys, "value", F.inline("parts")).where("value <= high")


def linear_trend(df: DataFrame, x: str, y: str, ends: bool = False) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` over complete pairs.

    ``residual_se``, ``mean_x``, ``sxx`` and ``n`` give the standard error of the
    line at any point. ``ends`` adds the least and the greatest ``x``.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.agg(
        F.regr_count(ys, xs).alias("n"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_r2(ys, xs).alias("r2"),
        F.regr_avgx(ys, xs).alias("mean_x"),
        F.regr_sxx(ys, xs).alias("sxx"),
        F.regr_syy(ys, xs).alias("syy"),
        F.regr_sxy(ys, xs).alias("sxy"),
        *([F.min(F.when(ys.isNotNull(), xs)).alias("low"),
           F.max(F.when(ys.isNotNull(), xs)).alias("high")] if ends else []))
    left_over = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    error = F.when(F.col("n") > 2, F.sqrt(left_over / (F.col("n") - 2)))
    return fit.withColumn("residual_se", error).drop("syy", "sxy")


def t_quantile(freedom: Column, level: float) -> Column:
    """How many standard errors of ``freedom`` degrees hold the share ``level`` in the middle.

    From SERIES_FROM degrees on by the expansion in powers of 1 / freedom, whose error is then
    below 1e-9. Below that the share within an angle is a finite sum, and the angle is found by
    halving. NULL below one degree.
    """
    z = NormalDist().inv_cdf((1 + level) / 2)
    terms = ((z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96,
             (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
             (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160)
    many = sum((term / F.pow(freedom, F.lit(i)) for i, term in enumerate(terms, 1)), F.lit(z))
    odd = freedom % 2 == 1

    def share(angle: Column) -> Column:
        square = F.cos(angle) * F.cos(angle)
        steps = F.when(odd, (freedom - 3) / 2).otherwise(freedom / 2 - 1).cast("int")
        # Each term of the sum is the one before it times a ratio and the squared cosine.
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

        def add(acc: Column, k: Column) -> Column:
            ratio = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
            term = acc["term"] * ratio * square
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        counted = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(
            F.array().cast("array<int>"))
        total = F.aggregate(counted, start, add, lambda acc: acc["sum"])
        bare = F.when(freedom == 1, 0.0).otherwise(F.sin(angle) * F.cos(angle) * total)
        return F.when(odd, (angle + bare) * 2 / math.pi).otherwise(F.sin(angle) * total)

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        inside = share(middle) < level
        return F.struct(F.when(inside, middle).otherwise(acc["low"]).alias("low"),
                        F.when(inside, acc["high"]).otherwise(middle).alias("high"))

    ends = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high"))
    few = F.sqrt(freedom) * F.tan(F.aggregate(
        F.sequence(F.lit(1), F.lit(HALVINGS)), ends, halve, lambda acc: acc["low"]))
    return F.when(freedom >= SERIES_FROM, many).when(freedom >= 1, few)


def trend_band(df: DataFrame, x: str, y: str, points: int = 80,
               level: float = 0.95) -> DataFrame:
    """The least-squares line at ``points`` places between the ends of ``x``, with its band.

    ``lower`` and ``upper`` bound the line, not the values, with confidence ``level``. One row
    per place, from one aggregate row; without a spread in ``x`` there are no rows, and with
    fewer than three pairs the band is NULL.
    """
    fit = linear_trend(df, x, y, ends=True)
    freedom = F.col("n") - 2
    at = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (points - 1)
    placed = fit.where("sxx > 0").withColumn("t", t_quantile(freedom, level)).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", at)
    error = F.col("residual_se") * F.sqrt(
        1 / F.col("n") + F.pow(F.col("x") - F.col("mean_x"), F.lit(2)) / F.col("sxx"))
    line = F.col("intercept") + F.col("slope") * F.col("x")
    return placed.select("point", "x", line.alias("fit"), (line - F.col("t") * error).alias("lower"),
                         (line + F.col("t") * error).alias("upper"))


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 box lengths, and outliers per group.

    The groups are a handful of labels; the values are counted per group and read twice.
    """
    counts = value_counts(df, F.col(value), [group])
    box = quantiles(df, F.col(value), [0.25, 0.5, 0.75], [group]).select(
        group, "n_values", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (null_safe_join(counts, box, [group])
            .groupBy(group, "n_values", "q1", "median", "q3")
            .agg(F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
                 F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
                 F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers")))
