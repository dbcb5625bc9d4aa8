"""Session logs as bucketed tables: whoever groups or joins by session reads them unshuffled.

A bucket holds whole sessions, so every study after the one that writes the table saves the
exchange of the log. A bucket is read by one task. A log with a hot session is therefore
written plain, without the key, and the studies shuffle it and split that session as ever.

Beside the rows lies a small file that says how they are bucketed. The folder may be moved;
``load`` registers it in the catalog of the session that reads it.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import SESSION_KEY, hot_keys, key_of
from ..operators.ordered import MAX_GROUP_ROWS
from .results import Files

SPEC = "_buckets"


def write(log: DataFrame, path: str, max_group_rows: int = MAX_GROUP_ROWS,
          counted: DataFrame | None = None) -> None:
    """Write a log bucketed and sorted by session, as many buckets as shuffle partitions.

    JOB_ID becomes text. Rows without a session are a session of their own. Rows per session
    are counted first, in ``counted`` if that has the same JOB_IDs and is cheaper to read.
    """
    spark = log.sparkSession
    log = log.withColumn("JOB_ID", F.col("JOB_ID").cast("string"))
    if hot_keys(log if counted is None else counted, ["JOB_ID"], max_group_rows) is not None:
        log.write.parquet(path)
        return
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = log.withColumn(SESSION_KEY, key_of("JOB_ID")).repartition(n, SESSION_KEY)
    name = f"querytrail_{uuid.uuid4().hex}"
    # The writer needs a table; only its files are kept.
    (rows.write.bucketBy(n, SESSION_KEY).sortBy(SESSION_KEY).option("path", path)
     .format("parquet").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")
    columns = [[f.name, f.dataType.simpleString()] for f in rows.schema.fields]
    Files(spark, path).write(f"{path}/{SPEC}", json.dumps(
        {"buckets": n, "columns": columns, "written": uuid.uuid4().hex}))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The log that ``write`` left at a path.

    Its name in the catalog follows from path and writing, so a replaced table gets another
    and two readers share one.
    """
    files = Files(spark, path)
    if not files.exists(f"{path}/{SPEC}"):
        return spark.read.parquet(path)
    text = files.read(f"{path}/{SPEC}")
    spec = json.loads(text)
    name = f"querytrail_{hashlib.sha256(f'{path} {text}'.encode()).hexdigest()[:32]}"
    columns = ", ".join(f"{_quoted(n)} {kind}" for n, kind in spec["columns"])
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY ({SESSION_KEY}) SORTED BY ({SESSION_KEY}) "
              f"INTO {spec['buckets']} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
