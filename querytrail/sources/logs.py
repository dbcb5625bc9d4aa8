"""Reading CSV logs and writing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_names, without_index_columns
from ..functions.text import MISSING_MARK
from ..session import stored
from . import results, typing

ROW_ID = "row_id"


_FILE, _BLOCK, _AT = "_file", "_block", "_at"


def load_log(spark: SparkSession, path: str, snake: bool = True, trim: bool = True,
             blank_as_null: bool | Sequence[str] = True, row_id: bool = False,
             multi_line: bool = True, malformed: str = "refuse",
             infer: bool = False) -> DataFrame:
    """A CSV with a header row as a frame of text columns.

    ``NA`` is NULL. Blank cells are NULL too, in all columns, in none, or in those
    listed in ``blank_as_null`` (such as the columns of numbers); elsewhere they
    are empty text. Unnamed index columns go.

    Line breaks in quoted cells are part of the cell. A file that may have some cannot be
    split and is read by one task, so give many files of moderate size and hand the table on
    as Parquet; ``multi_line=False`` is for files known to have none. A row with too few or
    too many cells is an error (``malformed="refuse"``); ``"keep"`` fills up or cuts off.

    ``row_id`` numbers the rows by file name and place in the file, from 0 without gaps. The
    table is then written once, so the numbers hold however often and wherever it is read.

    ``infer`` gives each column the narrowest type that all its values fit (see ``typing``).
    The types are observed while the cells are written, so the file is read and parsed once.
    """
    if malformed not in ("refuse", "keep"):
        raise ValueError(f"malformed={malformed!r}: refuse or keep")
    reader = spark.read.options(
        header=True, multiLine=multi_line, escape='"', emptyValue="", columnPruning=False,
        mode="FAILFAST" if malformed == "refuse" else "PERMISSIVE",
        ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in reader.csv(path).columns])
    scanned = reader.schema(schema).csv(path)
    if row_id:
        scanned = scanned.select(
            "*", F.col("_metadata.file_path").alias(_FILE),
            F.col("_metadata.file_block_start").alias(_BLOCK),
            F.monotonically_increasing_id().alias(_AT))
    places = [_FILE, _BLOCK, _AT] if row_id else []
    named = without_index_columns(scanned)
    columns = [c for c in named.columns if c not in places]
    if isinstance(blank_as_null, bool):
        blank_as_null = columns if blank_as_null else ()

    def cell(name: str) -> Column:
        # The reader gives NULL for an unquoted blank, so NULL means blank here.
        text = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        missing = [MISSING_MARK, ""] if name in blank_as_null else [MISSING_MARK]
        return F.when(~text.isin(missing), text).alias(name)

    cells = named.select(*[cell(name) for name in columns], *places)
    if infer:
        cells = typing.typed(cells, columns)
    if row_id:
        cells = _numbered(cells)
    return clean_names(cells) if snake else cells


def _numbered(scanned: DataFrame) -> DataFrame:
    """Row numbers from the place of each row in its block and the rows of earlier blocks.

    However a file was split, its rows stand in one run per block. One row per block is summed
    up in a window, so nothing is sorted.
    """
    written = stored(scanned)
    blocks = written.groupBy(_FILE, _BLOCK).agg(
        F.min(_AT).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy(_FILE, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(blocks.select(_FILE, _BLOCK, (F.coalesce(
        F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")))
    return written.join(offsets, [_FILE, _BLOCK]).withColumn(
        ROW_ID, F.col(_AT) + F.col("_shift")).drop(_FILE, _BLOCK, _AT, "_shift")


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV part files with a header; NULL is written as ``NA``, no row names.

    ``load_log`` reads compressed files as it reads plain ones.
    """
    (df.write.option("header", True).option("nullValue", MISSING_MARK)
     .option("emptyValue", "").option("escape", '"').option("compression", compression).csv(path))


def write_parquet(df: DataFrame, path: str) -> None:
    """The typed copy of a table."""
    df.write.parquet(path)


def export(tables: Mapping[str, DataFrame], folder: str, typed: Sequence[str] = (),
           study: str = "tables", inputs: str = "",
           bucketed: Mapping[str, results.Write] | None = None) -> list[str]:
    """Write every table as ``<name>.csv``, those in ``typed`` as ``<name>.parquet`` too.

    Earlier versions are replaced, all at once and only when every table is written; see
    ``results``. A typed table is computed once: its CSV is made from the Parquet copy.
    """
    if not tables:
        return []
    spark = next(iter(tables.values())).sparkSession
    return results.ResultFolder(spark, folder).save(
        study, results.plan(tables, typed, write_csv, write_parquet, bucketed), inputs)


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
              .select(F.lit(name).alias("table_name"), "n_rows")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
