from __future__ import annotations

import random

import pytest
from conftest import rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from querytrail.operators import joins, ordered, plotdata, ranking, repeats


def test_null_keys_match(frame):
    left = frame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = frame([(None, 10), ("a", 20)], "k string, y int")
    assert rows_of(joins.null_safe_join(left, right, ["k"])) == [
        ("a", 2, 20), ("b", 3, None), (None, 1, 10)]
    assert rows_of(joins.null_safe_join(left, right, ["k"], "left_anti")) == [("b", 3)]
    assert rows_of(joins.null_safe_join(left, right, ["k"], "left_semi")) == [
        ("a", 2), (None, 1)]


def test_fan_out_left_join_is_a_left_join(frame):
    left = frame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "k string, x int")
    right = frame([(None, 10), ("a", 20), ("a", 21), ("z", 30)], "k string, y int")
    assert rows_of(joins.fan_out_left_join(left, right, ["k"])) == rows_of(
        joins.null_safe_join(left, right, ["k"]))


def test_fan_out_left_join_of_a_hot_key(spark):
    """A third of both sides has one key; the skew setting must not change rows."""
    left = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
                                   .alias("k"), F.col("id").alias("x"))
    right = spark.range(1200).select(F.when(F.col("id") % 3 == 0, -1)
                                     .otherwise(F.col("id") % 300).alias("k"),
                                     F.col("id").alias("y"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256b"}
    expected = 300 * 400 + sum(4 if k < 300 and k % 3 else 1 for k in range(900) if k % 3)
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = joins.fan_out_left_join(left, right, ["k"], hot_rows=100)
        counts = joined.agg(F.count(F.lit(1)), F.count("y"), F.count_distinct("x")).first()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert counts[0] == expected
    assert counts[2] == 900


def test_hot_keys_are_exact(spark, frame, monkeypatch):
    """Also where many small keys fill a bucket, and for a NULL key."""
    hot = frame([(None, 5), ("a", 9), ("b", 4), ("c", 1)], "k string, n int")
    small = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 200).alias("k"))
    rows = hot.select("k", F.explode(F.sequence(F.lit(1), "n"))).select("k").unionByName(small)
    for buckets in (1, 7, 1 << 16):
        monkeypatch.setattr(joins, "BUCKETS", buckets)
        assert rows_of(joins.hot_keys(rows, ["k"], 4), "k", "rows") == [("a", 9), (None, 5)]
        assert joins.hot_keys(rows, ["k"], 9) is None
    assert joins.hot_keys(rows.limit(0), ["k"], 0) is None


def test_keys_are_counted_in_full_buckets_only(spark, monkeypatch):
    """Without a full bucket no table but the buckets' is written, so no key is counted."""
    written = []
    monkeypatch.setattr(joins, "stored", lambda df: written.append(df.columns) or df)
    assert joins.hot_keys(spark.range(5000), ["id"], 100) is None
    assert written == [["_bucket"]]


def test_keys_are_never_null_and_tell_values_apart(frame):
    rows = [(None, None), ("", None), (None, ""), ("a", "b"), ("a:1", "b"), ("a", "1:b"),
            ("-", None), ("1:a", None)]
    keys = [r[0] for r in frame(rows, "x string, y string").select(
        joins.key_of("x", "y")).collect()]
    assert None not in keys and len(set(keys)) == len(rows)


def test_quantiles_by_rank(frame, spark):
    rows = [("a", float(i)) for i in (5, 1, 3, 3, 2)] + [("b", 1.5), ("c", None), (None, 2.0)]
    df = frame(rows, "g string, v double")
    got = {r["g"]: (r["n_values"], list(r["q"])) for r in
           plotdata.quantiles(df, F.col("v"), [0.25, 0.5, 1.0], ["g"]).collect()}
    assert got == {"a": (5, [2.0, 3.0, 5.0]), "b": (1, [1.5] * 3), None: (1, [2.0] * 3)}
    assert plotdata.quantiles(df.where("false"), F.col("v"), [0.5]).count() == 0


def test_quantiles_of_a_million_distinct_values(spark):
    n = 1_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n / 3.0).alias("v"))
    exact = plotdata.quantiles(df, F.col("v"), [0.1, 0.5, 0.75]).first()
    assert exact["n_values"] == n
    assert list(exact["q"]) == pytest.approx([(n - 1) * p / 3.0 for p in (0.1, 0.5, 0.75)])


@pytest.fixture(scope="module")
def steps(frame):
    """One group with most of the rows, a NULL group, ties and missing counters."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = rng.choice(["hot"] * 6 + [None, "a", "b", "c"])
        counter = rng.choice([None, 1, 1, 1, 2, 3, rng.randrange(500)])
        rows.append((key, counter, i, rng.choice([None, "x", "y", str(i)]), float(i % 17)))
    return frame(rows, "k string, counter int, row_id long, text string, v double").repartition(5)


def test_with_previous_hot_groups(steps):
    new = {"text_before": "text", "v_before": "v"}
    plain = ordered.with_previous(steps, ["k"], ["counter", "row_id"], new)
    cut = ordered.with_previous(steps, ["k"], ["counter", "row_id"], new, max_group_rows=200)
    assert cut.columns == plain.columns
    assert rows_of(cut) == rows_of(plain)


def test_with_position_hot_groups(steps):
    plain = ordered.with_position(steps, ["k"], ["counter", "row_id"], "place")
    cut = ordered.with_position(steps, ["k"], ["counter", "row_id"], "place", max_group_rows=150)
    assert rows_of(cut) == rows_of(plain)
    window = Window.partitionBy("k").orderBy(F.asc_nulls_last("counter"), "row_id")
    expected = steps.withColumn("place", F.row_number().over(window).cast("long"))
    assert rows_of(plain) == rows_of(expected)


def test_hot_groups_are_cut_evenly(steps):
    ordinary, cut = ordered._split_hot(steps, ["k"], ["counter", "row_id"], 200, None, None)
    assert ordinary.count() + cut.count() == 3000
    largest = cut.groupBy("k", "_part").count().agg(F.max("count")).first()[0]
    assert largest <= 400


def test_known_bound_skips_the_count(steps):
    ready = ordered.with_position(steps, ["k"], ["counter", "row_id"], "place",
                                  rows_at_most=3000)
    assert rows_of(ready) == rows_of(
        ordered.with_position(steps, ["k"], ["counter", "row_id"], "place"))


def window_form(df, columns):
    """Row filter by its definition: one window per column."""
    ranked = df
    for c in columns:
        ranked = ranked.withColumn(f"r_{c}", F.row_number().over(
            Window.partitionBy(c).orderBy("row_id")))
    some = F.greatest(*[F.col(f"r_{c}") for c in columns]) > 1
    return ranked.where(some).select(*df.columns)


def test_keep_repeating_rows(frame):
    df = frame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, "c", None), (5, "d", None),
                (6, "e", "q")], "row_id long, c1 string, c2 string")
    for anchor in (None, "c1", "c2"):
        kept = repeats.keep_repeating_rows(df, anchor=anchor)
        assert [r[0] for r in rows_of(kept)] == [3, 5]


def test_keep_repeating_rows_any_anchor(frame):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, rng.randrange(60)]), rng.choice("abc") + str(i // 9),
             rng.randrange(40), None) for i in range(120)]
    df = frame(rows, "row_id long, a int, b string, c int, d string").repartition(4)
    by_definition = rows_of(window_form(df, ["a", "b", "c"]))
    short = df.drop("d")
    for anchor in ("a", "b", "c"):
        assert rows_of(repeats.keep_repeating_rows(short, anchor=anchor)) == rows_of(
            window_form(short, ["a", "b", "c"]))
    assert by_definition
    assert len(rows_of(repeats.keep_repeating_rows(df, anchor="d"))) >= len(by_definition)


def test_keep_repeating_rows_without_broadcast(frame, monkeypatch):
    rows = [(i, i % 7, str(i % 50)) for i in range(100)]
    df = frame(rows, "row_id long, a int, b string")
    expected = rows_of(repeats.keep_repeating_rows(df, anchor="a"))
    monkeypatch.setattr(repeats, "stored", lambda side: side)
    assert rows_of(repeats.keep_repeating_rows(df, anchor="b")) == expected


def test_one_column(frame):
    df = frame([(1, "a"), (2, "a"), (3, None), (4, None)], "row_id long, c string")
    assert [r[0] for r in rows_of(repeats.keep_repeating_rows(df))] == [2, 4]


def test_without_exact_copies(frame):
    df = frame([(1, "a", None), (2, "a", None), (3, "a", "b")], "row_id long, x string, y string")
    assert [r[0] for r in rows_of(repeats.without_exact_copies(df))] == [1, 3]


def test_top_with_ties(frame):
    df = frame([("a", 5), ("b", 5), ("c", 4)], "s string, n int")
    assert rows_of(ranking.top_with_ties(df, "n", 1)) == [("a", 5), ("b", 5)]
    assert len(rows_of(ranking.top_with_ties(df, "n", 30))) == 3


def test_histogram_edges(frame):
    df = frame([(float(x),) for x in (0, 1, 2, 3, 4, 10)] + [(None,)], "x double")
    got = rows_of(plotdata.histogram(df, F.col("x"), 5, centre=True))
    assert [(r[0], r[3]) for r in got] == [(0, 2), (1, 2), (2, 1), (4, 1)]
    assert got[0][1:3] == (0.0, 2.0)
    assert got[0][4:] == pytest.approx((20 / 6, 2.5))


def test_histogram_of_one_value(frame):
    got = rows_of(plotdata.histogram(frame([(3,), (3,)], "x int"), F.col("x"), 10))
    assert got == [(0, 3.0, 3.0, 2)]


def test_histogram_within_and_groups(frame):
    df = frame([("a", 1), ("a", 2), ("b", 3), ("b", 100)], "g string, x int")
    got = rows_of(plotdata.histogram(df, F.col("x"), 2, by=["g"], within=(1, 50), centre=True))
    assert [(r[0], r[1], r[4]) for r in got] == [("a", 0, 1), ("a", 1, 1), ("b", 1, 1)]
    assert {r[5] for r in got} == {26.5}


def test_histogram_without_values(frame):
    assert rows_of(plotdata.histogram(frame([(None,)], "x int"), F.col("x"), 4)) == []


def test_linear_trend(frame):
    df = frame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5), (4.0, None)], "x double, y double")
    fit = plotdata.linear_trend(df, "x", "y").first()
    assert fit["n"] == 3
    assert fit["slope"] == pytest.approx(2.25)
    assert fit["intercept"] == pytest.approx(-1 / 3)
    assert fit["residual_se"] == pytest.approx(0.204124, abs=1e-6)


def test_box_statistics(frame):
    df = frame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", None), ("b", 5.0)],
               "g string, v double")
    box = {r["g"]: r for r in plotdata.box_statistics(df, "g", "v").collect()}
    assert (box["a"]["q1"], box["a"]["median"], box["a"]["q3"]) == (2.0, 3.0, 4.0)
    assert (box["a"]["lower_whisker"], box["a"]["upper_whisker"], box["a"]["n_outliers"]) == (
        1.0, 4.0, 1)
    assert box["b"]["n_values"] == 1


# Two-sided 95 and 99 % points of Student's t as printed in tables.
T_TABLE = [(1, 0.95, 12.706205), (2, 0.95, 4.302653), (3, 0.95, 3.182446), (4, 0.95, 2.776445),
           (5, 0.95, 2.570582), (10, 0.95, 2.228139), (29, 0.95, 2.045230), (30, 0.95, 2.042272),
           (60, 0.95, 2.000298), (119, 0.95, 1.980100), (120, 0.95, 1.979930),
           (1000, 0.95, 1.962339), (1, 0.99, 63.656741), (7, 0.99, 3.499483), (120, 0.99, 2.617421)]


def test_t_quantile_equals_the_tables(frame):
    for level in (0.95, 0.99):
        rows = [(v, t) for v, share, t in T_TABLE if share == level]
        for r in frame(rows, "v long, t double").select(
                "t", plotdata.t_quantile(F.col("v"), level).alias("got")).collect():
            assert r.got == pytest.approx(r.t, abs=1e-6)
    assert frame([(0,)], "v long").select(plotdata.t_quantile(F.col("v"), 0.95)).first()[0] is None


def test_series_and_halving_agree_where_they_meet(spark, monkeypatch):
    df = spark.range(110, 131).select(F.col("id").alias("v"))
    series = [plotdata.SERIES_FROM, 1000]
    got = []
    for limit in (100, 1000):
        monkeypatch.setattr(plotdata, "SERIES_FROM", limit)
        got.append([r[0] for r in df.select(plotdata.t_quantile(F.col("v"), 0.95)).collect()])
    assert series[0] == 120 and got[0] == pytest.approx(got[1], abs=1e-8)


def test_trend_band(frame):
    """Against the formula on a small sample: speed and stopping-like pairs."""
    pairs = [(4.0, 2.0), (7.0, 22.0), (8.0, 16.0), (9.0, 10.0), (10.0, 26.0), (11.0, 17.0)]
    df = frame([*pairs, (99.0, None), (None, 5.0)], "x double, y double")
    rows = plotdata.trend_band(df, "x", "y", points=8).collect()
    n, mx, my = 6, sum(x for x, _ in pairs) / 6, sum(y for _, y in pairs) / 6
    sxx = sum((x - mx) ** 2 for x, _ in pairs)
    slope = sum((x - mx) * (y - my) for x, y in pairs) / sxx
    se = (sum((y - my - slope * (x - mx)) ** 2 for x, y in pairs) / (n - 2)) ** 0.5
    assert [r.x for r in rows] == pytest.approx([4.0 + i for i in range(8)])
    for r in rows:
        fit = my + slope * (r.x - mx)
        half = 2.7764451 * se * (1 / n + (r.x - mx) ** 2 / sxx) ** 0.5
        assert (r.fit, r.lower, r.upper) == pytest.approx((fit, fit - half, fit + half), abs=1e-5)
    assert plotdata.trend_band(frame([(1.0, 2.0)] * 3, "x double, y double"), "x", "y").count() == 0
    two = plotdata.trend_band(frame([(1.0, 2.0), (2.0, 3.0)], "x double, y double"), "x", "y").first()
    assert two.fit == pytest.approx(2.0) and two.lower is None
