from __future__ import annotations

import os

from conftest import rows_of

import pytest

from querytrail import session as S
from querytrail.plans import clean
from querytrail.plans.registry import QUERIES
from querytrail.session import sized_for, stored
from querytrail.sources import adapters, logs


def write(path, text):
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return str(path)


def test_load_log(spark, tmp_path):
    path = write(tmp_path / "log.csv", '"",JOB_ID,My Query\n"1", a ,"x ""y"", z"\n"2",NA,""\n'
                                       '"3",b, \n')
    log = logs.load_log(spark, path)
    assert log.columns == ["job_id", "my_query"]
    assert rows_of(log) == [("a", 'x "y", z'), ("b", None), (None, None)]
    raw = logs.load_log(spark, path, snake=False, blank_as_null=False, row_id=True)
    assert raw.columns == ["JOB_ID", "My Query", "row_id"]
    assert [(r[0], r[1]) for r in raw.orderBy("row_id").collect()] == [
        ("a", 'x "y", z'), (None, ""), ("b", "")]
    some = logs.load_log(spark, path, blank_as_null=["My Query"])
    assert rows_of(some) == [("a", 'x "y", z'), ("b", None), (None, None)]


def test_line_breaks_in_quoted_cells(spark, tmp_path):
    path = write(tmp_path / "log.csv", 'JOB_ID,M,C,T,QUERY\nj1,m,1,100,"java\nsenior"\nj2,m,1,5,x\n')
    assert rows_of(logs.load_log(spark, path, snake=False, row_id=True)) == [
        ("j1", "m", "1", "100", "java\nsenior", 0), ("j2", "m", "1", "5", "x", 1)]


def test_malformed_rows_are_refused_or_kept(spark, tmp_path):
    path = write(tmp_path / "bad.csv", "a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        logs.load_log(spark, path).collect()
    assert rows_of(logs.load_log(spark, path, malformed="keep")) == [
        ("1", "2"), ("3", None), ("4", "5")]
    with pytest.raises(ValueError, match="refuse or keep"):
        logs.load_log(spark, path, malformed="other")


def test_row_id_follows_file_names_and_places(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    write(folder / "a.csv", "v\n" + "".join(f"a{i:05d}\n" for i in range(20)))
    write(folder / "b.csv", "v\n" + "".join(f"b{i:05d}\n" for i in range(9000)))
    write(folder / "c.csv", "v\n" + "".join(f"c{i:05d}\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        for multi_line in (True, False):
            log = logs.load_log(spark, str(folder), row_id=True, multi_line=multi_line)
            rows = log.orderBy("row_id").collect()
            assert [r["row_id"] for r in rows] == list(range(9320))
            assert [r["v"] for r in rows] == sorted(r["v"] for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_id_does_not_depend_on_the_number_of_tasks(spark, tmp_path):
    rows = "".join(f"{i % 7},{i},{i},{i % 3}\n" for i in range(1, 4000))
    path = write(tmp_path / "responses.csv", "JOB_ID,CV_ID,TIMESTAMP,RESPONSE_TYPE\n" + rows)

    def cleaned(before, after):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
        spark.conf.set("spark.sql.files.minPartitionNum", before)
        built = clean.clean_response_log(logs.load_log(spark, path, snake=False, row_id=True,
                                                       multi_line=False))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", after)
        spark.conf.set("spark.sql.files.minPartitionNum", after)
        return rows_of(built)

    try:
        first = cleaned("2", "5")
        assert first == cleaned("7", "1")
        assert len(first) == 3999 - 3  # the rows in which every value is new
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_row_id_survives_a_filter(spark, tmp_path):
    path = write(tmp_path / "n.csv", "v\n" + "\n".join(str(i) for i in range(50)) + "\n")
    log = logs.load_log(spark, path, row_id=True)
    ids = {r["v"]: r["row_id"] for r in log.collect()}
    assert all(ids[r["v"]] == r["row_id"] for r in log.where("v > '30'").collect())


def test_write_csv_round_trip(spark, frame, tmp_path):
    df = frame([("a", None, 1), ('q "uote", x', "", 2)], "x string, y string, n int")
    path = str(tmp_path / "out")
    logs.write_csv(df, path)
    assert rows_of(logs.load_log(spark, path)) == [("a", None, "1"), ('q "uote", x', None, "2")]
    part = next(f for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    with open(os.path.join(path, part), encoding="utf-8") as written:
        assert written.readline().strip() == "x,y,n"


def test_write_parquet_keeps_types(spark, frame, tmp_path):
    df = frame([(1, 2.5, None)], "a int, b double, c string")
    path = str(tmp_path / "typed")
    logs.write_parquet(df, path)
    assert logs.load_parquet(spark, path).schema == df.schema


def test_manifest(frame):
    one, none = frame([(1,)], "a int"), frame([], "a int")
    assert rows_of(logs.manifest({"one": one, "none": none})) == [("none", 0), ("one", 1)]


def test_stored_tables_go_to_the_shared_folder_and_are_dropped(spark, frame):
    table = stored(frame([(1,)], "a int"))
    folder = S.own_folder(spark)
    assert table.count() == 1
    assert all(folder.replace("file:", "") in f for f in table.inputFiles())
    other = folder + "-other"
    table.write.parquet(f"{other}/t")
    S.drop_folder(spark, other)
    assert not os.path.exists(other.replace("file:", ""))


class Cluster:
    """What shared_folder asks of a session whose master is a cluster."""

    def __init__(self, folder):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = self
        self.master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_folder(Cluster(None))
    assert S.shared_folder(Cluster("hdfs://x/y")) == "hdfs://x/y"


def test_sized_for():
    assert sized_for(0)["spark.sql.shuffle.partitions"] == "200"
    assert sized_for(100 * 1024 ** 4)["spark.sql.shuffle.partitions"] == str(8 * 102400)


def test_documents_without_an_event_are_not_in_the_log(spark, frame, tmp_path):
    texts = [(0, "some words"), (1, "2021-01-01"), (2, "never visited"), (3, ""), (4, None)]
    frame([(i, text, len(text or "")) for i, text in texts],
          "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    frame([(0, 7), (1, 8)], "event_id long, user_id long").selectExpr(
        "*", "timestamp_ntz'2024-01-02 03:04:05' as ts").write.parquet(f"{tmp_path}/events.parquet")
    log = adapters.query_log(adapters.Tables(spark, str(tmp_path)))
    assert rows_of(log, "row_id", "QUERY") == [
        (0, "some and words"), (1, None), (1_000_000, "2021-01-01")]
    types = QUERIES["log_column_types"](spark, str(tmp_path))
    assert {r.column_name: (r.column_type, r.n_values) for r in types.collect()} == {
        "row_id": ("integer", 3), "JOB_ID": ("text", 1), "MESSAGE_ID": ("integer", 3),
        "QUERY_COUNTER": ("integer", 3), "TIMESTAMP": ("integer", 3),
        "TIMESTAMP_FORMATTED": ("datetime", 3), "QUERY": ("text", 2), "HOUR": ("double", 3),
        "DAY": ("date", 3), "EVEN": ("logical", 3), "CODE": ("text", 3)}
