"""Operator 5: contiguous shards of equal size from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .tables import col, partitions, read

SHARDS = 40
ROW_OVERHEAD = 16
SIZE, SALT, PART, BEFORE, RANK = "__size", "__salt", "__part", "__before", "__rank"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and rows that lie before each row in its own partition."""
    part = TaskContext.get().partitionId()
    size_before = rows_before = 0
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(SIZE)).to_numpy(zero_copy_only=False)
        ends = size_before + np.cumsum(sizes, dtype=np.int64)
        n = len(sizes)
        added = [pa.array(np.full(n, part, np.int64)), pa.array(ends - sizes),
                 pa.array(np.arange(rows_before, rows_before + n, dtype=np.int64))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *added], names=[*batch.schema.names, PART, BEFORE, RANK])
        if n:
            size_before, rows_before = int(ends[-1]), rows_before + n


def prefix_sum_shards(df: DataFrame, size: Column, order_by: Sequence[str],
                      n_shards: int = SHARDS) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    The rows are range-partitioned and sorted by ``order_by`` and each partition sums its own
    sizes. One total per partition gives every partition's offset, so a row's global prefix
    sum is known without a global sort in one task. A row whose prefix sum is s of S bytes
    goes to shard ``s * n_shards div S``: shards are contiguous in the order and differ by
    less than two rows' sizes.

    NULL sorts first; a NULL size counts as 0. Rows that tie in every sorting column are told
    apart by a salt, so a value held by a third of all rows is spread over many partitions.
    A row larger than a shard's share may leave the next shards empty. If all sizes are 0, all
    rows go to shard 0. An empty frame gives no rows. Columns of ``df`` named ``shard`` or
    ``slot`` are replaced; all others are kept.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    sized = df.select(*[col(c) for c in kept], F.coalesce(size, F.lit(0)).cast("long").alias(SIZE),
                      F.monotonically_increasing_id().alias(SALT))
    order = [*[col(c) for c in order_by], F.col(SALT)]
    ranged = (sized.repartitionByRange(partitions(spark), *order)
              .sortWithinPartitions(*order).drop(SALT))
    schema = T.StructType([*ranged.schema.fields, *[
        T.StructField(c, T.LongType()) for c in (PART, BEFORE, RANK)]])
    numbered = stored(ranged.mapInArrow(_numbered, schema))

    # One row per partition from here on.
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = numbered.groupBy(PART).agg(
        F.sum(SIZE).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = totals.select(
        PART, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("__bytes_off"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("__rows_off"),
        F.greatest(F.sum("bytes").over(Window.partitionBy()), F.lit(1)).alias("__total"))
    # A row of size 0 after the last byte would start at the total itself.
    shard = f"cast(least((__bytes_off + {BEFORE}) * {n_shards} div __total, {n_shards - 1}) as int)"
    placed = numbered.join(F.broadcast(offsets), PART).select(
        *[col(c) for c in kept], F.expr(shard).alias("shard"),
        (F.col("__rows_off") + F.col(RANK)).alias(RANK))
    firsts = placed.groupBy("shard").agg(F.min(RANK).alias("__first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        *[col(c) for c in kept], "shard", (F.col(RANK) - F.col("__first")).alias("slot"))


def text_bytes(text: Column) -> Column:
    """Size of a document: UTF-8 bytes (NULL has none) and the row's overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def op5_prefix_sum_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, contiguous by doc_id, size and checksum.

    The text itself is not moved, only its size and checksum (0 for NULL).
    """
    text = F.col("text")
    narrow = stored(read(spark, folder, "documents").select(
        "doc_id", text_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")))
    dealt = prefix_sum_shards(narrow, F.col("size"), ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                        "slot", F.lit(None).cast("int").alias("grown_shard"))
