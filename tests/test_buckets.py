"""Session logs as bucketed tables: same results, no exchange of the log."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from querytrail import run
from querytrail.operators.joins import SESSION_KEY
from querytrail.plans import effect, sessions
from querytrail.sources import adapters, buckets, logs

from conftest import rows_of

STILL = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
RESPONSES = "JOB_ID string, TIMESTAMP string, RESPONSE_TYPE string"
SECTORS = "JOB_ID string, INDUSTRY_SECTOR_NAME string, row_id long"


@pytest.fixture(scope="module")
def log(frame):
    rows = [(k, None if k % 17 == 0 else f"s{k % 41}", str(k // 41), str(1_600_000_000 + 5 * k),
             None if k % 23 == 0 else f"Word{k % 7} AND other{k % 3}") for k in range(2000)]
    return frame(rows, "row_id long, JOB_ID string, QUERY_COUNTER string, TIMESTAMP string, QUERY string")


@pytest.fixture(scope="module")
def bucketed(spark, log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("buckets") / "it's a log")
    buckets.write(log, path)
    return buckets.load(spark, path)


@pytest.fixture(scope="module")
def others(frame):
    responses = frame([(f"s{k}", str(1_600_000_000 + 997 * k), str(k % 2)) for k in range(30)]
                      + [(None, "1600000500", "1")], RESPONSES)
    return responses, frame([(f"s{k % 20}", f"sector {k % 3}", k) for k in range(40)], SECTORS)


def shuffled_scans(spark, df):
    """Bucketed scans of a plan, and those of them that lie under an exchange."""
    before = {k: spark.conf.get(k, None) for k in STILL}
    try:
        for key, value in STILL.items():
            spark.conf.set(key, value)
        plan = df()._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    above, scans, moved = [], 0, 0
    for line in plan.splitlines():
        depth = re.search(r"[A-Za-z*]", line).start() if line.strip() else 0
        above = [(d, n) for d, n in above if d < depth]
        if re.search(r"FileScan parquet \S*querytrail_", line):  # the table, not what is stored from it
            scans += 1
            moved += "Bucketed: true" not in line or any(n.startswith("Exchange") for _, n in above)
        above.append((depth, line[depth:]))
    return scans, moved


def test_rows_come_back(log, bucketed):
    assert rows_of(bucketed.drop(SESSION_KEY), *log.columns) == rows_of(log)


@pytest.mark.parametrize("build", [
    lambda log, *_: sessions.session_summary(log),
    lambda log, *_: sessions.unique_tokens_per_session(log).drop(SESSION_KEY),
    lambda log, *others: effect.query_reformulation(log, *others),
    lambda log, *others: effect.session_effectiveness(log, *others)])
def test_same_results_without_an_exchange_of_the_log(spark, log, bucketed, others, build):
    plain, found = build(log, *others), build(bucketed, *others)
    assert found.columns == plain.columns
    assert rows_of(found) == rows_of(plain) != []
    scans, moved = shuffled_scans(spark, lambda: build(bucketed, *others))
    assert scans and not moved


@pytest.mark.parametrize("build", [
    sessions.session_profile, lambda log: effect.valid_sessions(effect.session_times(log))])
def test_first_aggregates_do_not_move_the_log(spark, bucketed, build):
    scans, moved = shuffled_scans(spark, lambda: build(bucketed))
    assert scans == 1 and not moved


def test_a_log_with_a_hot_session_stays_plain(spark, log, others, tmp_path):
    path = str(tmp_path / "hot")
    buckets.write(log, path, max_group_rows=100)  # the session without a name has 118 rows
    found = buckets.load(spark, path)
    assert found.columns == log.columns and not os.path.exists(f"{path}/{buckets.SPEC}")
    assert rows_of(effect.session_effectiveness(found, *others, 100)) == rows_of(
        effect.session_effectiveness(log, *others))


def test_empty_log(spark, log, others, tmp_path):
    path = str(tmp_path / "empty")
    buckets.write(log.where("false"), path)
    found = buckets.load(spark, path)
    assert found.count() == sessions.session_summary(found).count() == 0
    assert effect.session_effectiveness(found, *others).count() == 0


def test_a_rewritten_table_is_read_anew(spark, log, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    buckets.write(log, old)
    assert buckets.load(spark, old).count() == log.count()
    buckets.write(log.limit(5).withColumn("more", F.lit(1)), new)
    os.rename(old, str(tmp_path / "away"))
    os.rename(new, old)
    assert buckets.load(spark, old).count() == 5 and "more" in buckets.load(spark, old).columns


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_studies_read_what_the_cleaning_left(spark, tmp_path, monkeypatch):
    raw, cleaned, out = (str(tmp_path / n) for n in ("raw", "cleaned", "out"))
    t = adapters.Tables(spark, "/root/testdata/sf0.001")
    logs.export({"queries": adapters.query_log(t).orderBy("row_id").drop("row_id")}, raw)
    written = run.run(spark, "clean", raw, cleaned)
    assert f"{cleaned}/queries_clean.buckets" in written
    seen = []
    load = buckets.load
    monkeypatch.setattr(buckets, "load", lambda *a: seen.append(load(*a)) or seen[-1])
    run.run(spark, "behaviour", cleaned, out)
    assert len(seen) == 1 and SESSION_KEY in seen[0].columns
    summary = logs.load_log(spark, f"{out}/session_summary.csv")
    plain = sessions.session_summary(logs.load_parquet(spark, f"{cleaned}/queries_clean.parquet"))
    assert sorted(c.lower() for c in plain.columns) == sorted(c.lower() for c in summary.columns)
    assert summary.count() == plain.count() > 0
