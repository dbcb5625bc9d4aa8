from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with columns of names that operators use themselves."""
    def build(rows, extra=True):
        rows = [(*r, *[None] * (4 - len(r))) for r in rows]
        frame = spark.createDataFrame(
            [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows],
            DOCUMENTS)
        if extra:
            for name in ("shard", "slot", "spans", "topic", "score", "key", "digest", "words"):
                frame = frame.selectExpr("*", f"'x' as `{name}`")
        return frame

    return build


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A function that writes tables to a new folder and names it."""
    def write(**tables):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, frame in tables.items():
            frame.write.parquet(f"{path}/{name}.parquet")
        return path

    return write


SMALL = "/root/testdata/sf0.001"
