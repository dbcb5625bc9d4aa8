"""Result folders: replaced whole, resumed, and never half seen. Types observed on reading."""

from __future__ import annotations

import os

import pytest
from conftest import rows_of
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from querytrail import run
from querytrail.sources import logs, typing
from querytrail.sources.results import ResultFolder


def table(spark, n, kind):
    return spark.range(n).select(F.col("id"), F.lit(kind).alias("kind"))


def seen(spark, folder, name):
    return {r.kind for r in logs.load_log(spark, ResultFolder(spark, folder).path(name)).collect()}


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "out")


def test_a_second_run_replaces_the_first(spark, folder):
    names = ("a", "b")
    paths = logs.export({n: table(spark, 5, "old") for n in names}, folder, ["a"])
    assert paths == [f"{folder}/a.parquet", f"{folder}/a.csv", f"{folder}/b.csv"]
    logs.export({"other": table(spark, 2, "kept")}, folder, study="other")
    logs.export({n: table(spark, 3, "new") for n in names}, folder, ["a"])
    for name in names:
        assert seen(spark, folder, f"{name}.csv") == {"new"}
        assert logs.load_log(spark, f"{folder}/{name}.csv").count() == 3
    assert spark.read.parquet(f"{folder}/a.parquet").count() == 3
    result = ResultFolder(spark, folder)
    assert result.rows("tables") == {"a.parquet": 3, "a.csv": 3, "b.csv": 3}
    assert result.rows("other") == {"other.csv": 2} and result.rows("unknown") == {}
    assert sorted(n for n in os.listdir(folder) if n[0] not in "._") == [
        "a.csv", "a.parquet", "b.csv", "other.csv"]
    assert os.listdir(f"{folder}/_staging") == [] and os.listdir(f"{folder}/_replaced") == []


def test_an_empty_table_is_a_table(spark, folder):
    logs.export({"a": table(spark, 4, "x")}, folder)
    logs.export({"a": table(spark, 4, "x").where("false")}, folder)
    assert logs.load_log(spark, f"{folder}/a.csv").count() == 0
    assert ResultFolder(spark, folder).rows("tables") == {"a.csv": 0}


class Killed(Exception):
    pass


def breaking(at):
    """A writer that works ``at`` times and then dies half-way."""
    left = [at]

    def write(df, path):
        if not left[0]:
            df.limit(1).write.csv(path)
            raise Killed
        left[0] -= 1
        logs.write_csv(df, path)

    return write


def test_a_killed_run_leaves_the_old_result_and_is_resumed(spark, folder):
    names = ("a.csv", "b.csv", "c.csv")
    result = ResultFolder(spark, folder)
    result.save("s", {n: (table(spark, 5, "old"), logs.write_csv) for n in names}, "input 1")
    write = breaking(2)
    with pytest.raises(Killed):
        result.save("s", {n: (table(spark, 7, "new"), write) for n in names}, "input 2")
    assert all(seen(spark, folder, n) == {"old"} for n in names)
    assert result.rows("s") == dict.fromkeys(names, 5)

    # The same input: the two finished tables are taken, only the third is written.
    again = []

    def counted(df, path):
        again.append(os.path.basename(path))
        logs.write_csv(df, path)

    result.save("s", {n: (table(spark, 7, "resumed"), counted) for n in names}, "input 2")
    assert again == ["c.csv"]
    assert [seen(spark, folder, n) for n in names] == [{"new"}, {"new"}, {"resumed"}]
    assert result.rows("s") == dict.fromkeys(names, 7)


@pytest.mark.parametrize("inputs", ["input 3", ""])
def test_other_input_starts_anew(spark, folder, inputs):
    result = ResultFolder(spark, folder)
    with pytest.raises(Killed):
        result.save("s", {n: (table(spark, 7, "stale"), breaking(1) if n == "b.csv" else logs.write_csv)
                          for n in ("a.csv", "b.csv", "c.csv")} | {
                              "d.csv": (table(spark, 1, "stale"), breaking(0))}, "input 2")
    result.save("s", {n: (table(spark, 2, "new"), logs.write_csv) for n in ("a.csv", "b.csv")}, inputs)
    assert seen(spark, folder, "a.csv") == seen(spark, folder, "b.csv") == {"new"}
    assert not os.path.exists(f"{folder}/c.csv")


@pytest.mark.parametrize("moves", range(5))
def test_readers_see_all_new_after_a_broken_swap(spark, folder, moves, monkeypatch):
    names = ("a.csv", "b.csv")
    ResultFolder(spark, folder).save("s", {n: (table(spark, 2, "old"), logs.write_csv) for n in names})
    broken = ResultFolder(spark, folder)
    rename, left = broken.files.rename, [moves]

    def limited(old, new):
        if "/_commit/" in new or old.endswith(".part"):
            return rename(old, new)
        if not left[0]:
            raise Killed
        left[0] -= 1
        return rename(old, new)

    monkeypatch.setattr(broken.files, "rename", limited)
    tables = {n: (table(spark, 3, "new"), logs.write_csv) for n in names}
    if moves < 4:
        with pytest.raises(Killed):
            broken.save("s", tables)
    else:
        broken.save("s", tables)
    assert [seen(spark, folder, n) for n in names] == [{"new"}, {"new"}]
    assert ResultFolder(spark, folder).rows("s") == dict.fromkeys(names, 3)
    ResultFolder(spark, folder).recover()
    assert [logs.load_log(spark, f"{folder}/{n}").count() for n in names] == [3, 3]
    assert os.listdir(f"{folder}/_commit") == []


def test_a_study_runs_twice(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)

    def give(rows):
        with open(f"{source}/skills.csv", "w", encoding="utf-8") as out:
            out.write("job_id,skill\n" + "".join(f"{i},Skill {i % 3}\n" for i in range(rows)))

    give(9)
    first = run.run(spark, "clean", source, target)
    give(4)
    assert run.run(spark, "clean", source, target) == first
    assert spark.read.parquet(f"{target}/skills_clean.parquet").count() == 4
    assert ResultFolder(spark, target).rows("clean")["skills_clean.csv"] == 4


# --- column types ------------------------------------------------------------------------

CELLS = {
    "flag": (["TRUE", "F", "NA", "true"], "boolean"), "whole": (["1", "-20", "+3", "0"], "bigint"),
    "big": (["9223372036854775807", "1", "2", "NA"], "bigint"),
    "huge": (["9223372036854775808", "1", "2", "3"], "double"),
    "decimal": (["1", "2.5", "1e3", ".5"], "double"), "code": (["0123", "12", "4", "5"], "string"),
    "day": (["2021-02-28", "2020-2-29", "2021/03/01", "NA"], "date"),
    "no_day": (["2021-02-28", "2021-02-30", "2021-03-01", "NA"], "string"),
    "time": (["2021-02-28", "2021-02-28 10:11:12", "2021-02-28T10:11:12Z", "NA"], "timestamp"),
    "mixed": (["TRUE", "1", "2", "3"], "string"), "text": (["a", "1", "2", "NA"], "string"),
    "nothing": (["NA", "", "NA", ""], "boolean"), "infinite": (["1e999", "1", "2", "3"], "string"),
}


def test_types_are_the_narrowest_that_all_values_fit(spark, tmp_path):
    path = tmp_path / "cells.csv"
    columns = list(CELLS)
    rows = zip(*[CELLS[c][0] for c in columns], strict=True)
    path.write_text("\n".join([",".join(columns), *map(",".join, rows)]) + "\n")
    log = logs.load_log(spark, str(path), infer=True, row_id=True)
    assert dict(log.dtypes) == {c: kind for c, (_, kind) in CELLS.items()} | {"row_id": "bigint"}
    first = log.orderBy("row_id").first()
    assert (first.flag, first.whole, first.decimal, first.code, str(first.day)) == (
        True, 1, 1.0, "0123", "2021-02-28")
    assert [r.flag for r in log.orderBy("row_id").collect()] == [True, False, None, True]
    assert rows_of(log.where("row_id = 2"), "time")[0][0].hour == 10
    untyped = logs.load_log(spark, str(path))
    assert {kind for _, kind in untyped.dtypes} == {"string"}


def test_types_of_an_empty_file_and_of_parts(spark, tmp_path):
    (tmp_path / "none.csv").write_text("a,b\n")
    none = logs.load_log(spark, str(tmp_path / "none.csv"), infer=True)
    assert none.dtypes == [("a", "boolean"), ("b", "boolean")] and none.count() == 0
    parts = tmp_path / "parts"
    parts.mkdir()
    for i, cell in enumerate(["1", "2.5", "7"]):  # one part alone would be of whole numbers
        (parts / f"{i}.csv").write_text(f"v\n{cell}\n")
    assert rows_of(logs.load_log(spark, str(parts), infer=True)) == [(1.0,), (2.5,), (7.0,)]


def test_reading_with_types_takes_one_job_more_than_the_header(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("a,b\n1,x\n2,y\n")
    spark.sparkContext.setJobGroup("typed-read", "")
    try:
        logs.load_log(spark, str(path), infer=True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("typed-read")
    assert len(jobs) == 2  # the header, and the writing that observes the types


def test_joining_bits_in_any_order_gives_the_same_type():
    masks = [0b00010 | 0b00100, 0b00100, 0b11000, 0b10000, 0b00001]
    for a in masks:
        for b in masks:
            assert typing.type_of(a & b) == typing.type_of(b & a)
            assert typing.type_of(a & a) == typing.type_of(a)
    assert typing.type_of(None) == "logical" and typing.type_of(0) == "text"


def test_cells_are_tested_by_code_that_is_compiled_and_with_few_patterns(spark, tmp_path, monkeypatch):
    path = tmp_path / "wide.csv"
    names = [f"c{i}" for i in range(12)]
    path.write_text(",".join(names) + "\n" + ",".join(["2021-02-28"] * 12) + "\n")
    limit, write, seen = "spark.sql.codegen.hugeMethodLimit", DataFrameWriter.parquet, []

    def noted(writer, *args, **options):
        plan = writer._df._jdf.queryExecution().optimizedPlan().toString()
        seen.append((int(spark.conf.get(limit)), plan.count("RLIKE") / len(names)))
        return write(writer, *args, **options)

    before = spark.conf.get(limit)
    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    log = logs.load_log(spark, str(path), infer=True)
    assert seen == [(8000, 2)] and spark.conf.get(limit) == before
    assert {kind for _, kind in log.dtypes} == {"date"}

    def broken(writer, *args, **options):
        raise OSError

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        logs.load_log(spark, str(path), infer=True)
    assert spark.conf.get(limit) == before


WHOLE, NUMBER, DAY, TIME = 0b00110, 0b00100, 0b11000, 0b10000
ODD_CELLS = {
    "0": WHOLE, "-0": WHOLE, "+7": WHOLE, "12\n": WHOLE, "-9223372036854775808": WHOLE,
    "-9223372036854775809": NUMBER, "1e5": NUMBER, "1E+5": NUMBER, "5.": NUMBER, "-.5": NUMBER,
    "1.5e-3": NUMBER, "1234e-5": NUMBER, "1e999": 0, "00": 0, "-01": 0, "1e": 0, ".": 0, "+": 0,
    "1d": 0, "NaN": 0, "0x1F": 0, "\u0663": 0, "": 0, " 1": 0, "T": 1, "false": 1, "False": 0,
    "3118-20240117": 0, "2021-2-3": DAY, "2021/02-03": DAY, "2021-02-28\r\n": DAY, "2021-02-30": 0,
    "20210228": WHOLE, "2021-1-1 1:1:1": TIME, "2021/1/1T1:1:1.5Z": TIME, "2021-1-1 25:1:1": 0,
    "2021-1-1 1:1:1 ": 0, "2021-1-1 1:1": 0, "2021-1-1T1:1:1+02:00": TIME, "x": 0, None: None,
}


def test_types_of_odd_cells(spark):
    df = spark.createDataFrame([(text,) for text in ODD_CELLS], "v string")
    found = df.select("v", typing.bits(F.col("v")).alias("bits")).collect()
    assert {r.v: r.bits for r in found} == ODD_CELLS


def test_a_packed_log_is_read_as_a_plain_one(spark, tmp_path):
    rows = [("a\nb", "1", None), ('"x", y', "2.5", "2021-01-01"), ("", "3", "2021-1-2")]
    df = spark.createDataFrame(rows * 200, "text string, number string, day string").coalesce(1)
    logs.write_csv(df, str(tmp_path / "plain"))
    logs.write_csv(df, str(tmp_path / "packed"), "lz4")
    plain, packed = (logs.load_log(spark, str(tmp_path / name), infer=True, row_id=True)
                     for name in ("plain", "packed"))
    assert packed.dtypes == plain.dtypes and rows_of(packed) == rows_of(plain)
    assert packed.count() == 600 and packed.schema["day"].dataType.simpleString() == "date"
    size = {name: sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))
            for name in ("plain", "packed")}
    assert size["packed"] < size["plain"] / 5
