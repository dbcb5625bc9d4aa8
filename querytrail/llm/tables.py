"""Reading the tables and mapping texts through Python in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows that go to Python at once, and characters that are worked on at once.
BATCH_ROWS = 500
CHUNK_CHARS = 1_000_000
TEXT = "__text"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder; the session hands rows to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(texts: Sequence[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts with about ``most`` characters each."""
    begin, chars = 0, 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > most:
            yield begin, i
            begin, chars = i, 0
        chars += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def map_texts(docs: DataFrame, work: Callable[[list[str]], dict[str, Sequence]],
              added: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, untouched, and those that ``work`` gives for lists of texts.

    ``added`` is the DDL of the new columns. A NULL text counts as empty. No shuffle.
    """
    rows = docs.select(*[col(c) for c in keep], F.coalesce(col(text), F.lit("")).alias(TEXT))
    kept = [f for f in rows.schema.fields if f.name != TEXT]
    schema = T.StructType([*kept, *T._parse_datatype_string(added).fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for begin, end in chunks(texts):
                found = work(texts[begin:end])
                old = [c.slice(begin, end - begin) for c in batch.columns[:len(kept)]]
                new = [pa.array(found[f.name], type=f.type) for f in list(kinds)[len(kept):]]
                yield pa.RecordBatch.from_arrays([*old, *new], names=kinds.names)

    return rows.mapInArrow(run, schema)


def least_hashed(rows: DataFrame, hash: str, most: int) -> tuple[int, DataFrame]:
    """The number of rows, and the ``most`` rows of the least hash (all, if fewer).

    For narrow rows with distinct hashes. A threshold on the hash, set from the number of
    rows, leaves about twice as many as are wanted before the exact cut, however many tasks
    there are, so nothing that grows with the input reaches one task.
    """
    n = rows.count()
    place = F.pmod(F.xxhash64(F.col(hash)), F.lit(1 << 53)) / float(1 << 53)
    # Twice the expectation and more: fewer than wanted are left with a chance below 1e-20.
    near = rows.where(place < 2.0 * (most + 100) / n) if n > 2 * (most + 100) else rows
    return n, near.orderBy(place, hash).limit(most)
