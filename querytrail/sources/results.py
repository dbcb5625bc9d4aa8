"""Result folders: the tables of a study are replaced all at once, and a broken run goes on.

A run writes its tables to ``_staging/<study>`` inside the folder, each followed by a small
file with its row count. When all are there, one rename makes the commit record
``_commit/<study>`` appear; that is the moment the result changes. Then each table takes the
place of the old one. Whoever comes next, a reader or a run, finishes a swap that broke off:
the record says what belongs in place, and moving it there twice does no harm.

A run that dies before its record leaves the old result as it was. The next run over the same
input takes the tables that were finished and writes the others; over other input it starts
anew. Only Hadoop file systems are used, so the folder may lie in any store Spark writes to;
the rename of one small file must be atomic there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STAGING, COMMIT, MANIFEST, REPLACED = "_staging", "_commit", "_manifest", "_replaced"
Write = Callable[[DataFrame, str], None]


class Files:
    """The few file operations needed, on whatever store a folder lies in."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._path(new).getParent())
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def write(self, name: str, text: str) -> None:
        """A small file that appears whole, in place of an earlier one."""
        out = self._fs.create(self._path(f"{name}.part"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(name)
        self.rename(f"{name}.part", name)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def signature(self, folder: str) -> str:
        """A digest of the names, sizes and times of all files that are data."""
        digest = hashlib.sha256()
        if self.exists(folder):
            found = self._fs.listFiles(self._path(folder), True)
            lines = []
            while found.hasNext():
                status = found.next()
                path = status.getPath().toString()
                if not any(part[:1] in "_." for part in path.split("/") if part):
                    lines.append(f"{path} {status.getLen()} {status.getModificationTime()}")
            digest.update("\n".join(sorted(lines)).encode())
        return digest.hexdigest()


class ResultFolder:
    """A folder of tables that studies replace and readers look up."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.files = Files(spark, self.folder)

    def _at(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def path(self, table: str) -> str:
        """Where the committed version of a table lies at this moment."""
        for study in self._committed():
            staged = self._at(STAGING, study, table)
            if table in self._record(study) and self.files.exists(staged):
                return staged
        return self._at(table)

    def rows(self, study: str) -> dict[str, int]:
        """Row counts of the tables a study last committed."""
        name = self._at(MANIFEST, study)
        if study in self._committed():
            return self._record(study)
        return json.loads(self.files.read(name)) if self.files.exists(name) else {}

    def _committed(self) -> list[str]:
        return [n for n in self.files.names(self._at(COMMIT)) if not n.endswith(".part")]

    def _record(self, study: str) -> dict[str, int]:
        return json.loads(self.files.read(self._at(COMMIT, study)))

    def recover(self) -> None:
        """Finish every swap whose record is there."""
        for study in self._committed():
            self._swap(study)

    def _swap(self, study: str) -> None:
        record = self._record(study)
        for table in record:
            staged, final = self._at(STAGING, study, table), self._at(table)
            if not self.files.exists(staged):
                continue  # moved already
            if self.files.exists(final):
                old = self._at(REPLACED, study, table)
                self.files.delete(old)
                self.files.rename(final, old)
            self.files.rename(staged, final)
        self.files.write(self._at(MANIFEST, study), json.dumps(record))
        self.files.delete(self._at(COMMIT, study))
        self.files.delete(self._at(STAGING, study))
        self.files.delete(self._at(REPLACED, study))

    def save(self, study: str, tables: Mapping[str, tuple[DataFrame | str, Write]],
             inputs: str = "") -> list[str]:
        """Replace the tables of a study and return their paths.

        A table is a frame, or the name of an earlier table of the run that is read again, and
        the function that writes it. ``inputs`` tells whether a broken run had the same input;
        an empty text never matches, so nothing is taken from such a run. Tables of the folder
        that are not named stay as they are.
        """
        self.recover()
        mark = self._at(STAGING, study, "_inputs")
        if not (inputs and self.files.exists(mark) and self.files.read(mark) == inputs):
            self.files.delete(self._at(STAGING, study))
            self.files.write(mark, inputs)
        record = {}
        for table, (source, write) in tables.items():
            staged = self._at(STAGING, study, table)
            done = self._at(STAGING, study, f"_rows-{table}")
            if not self.files.exists(done):
                self.files.delete(staged)
                frame = self.spark.read.parquet(self._at(STAGING, study, source)) if isinstance(
                    source, str) else source
                self.files.write(done, str(_written(frame, staged, write)))
            record[table] = int(self.files.read(done))
        self.files.write(self._at(COMMIT, study), json.dumps(record))
        self._swap(study)
        return [self._at(table) for table in tables]


def _written(frame: DataFrame, path: str, write: Write) -> int:
    """Write a frame and return its number of rows, counted on the way."""
    seen = Observation()
    write(frame.observe(seen, F.count(F.lit(1)).alias("rows")), path)
    return seen.get.get("rows", 0)


def plan(tables: Mapping[str, DataFrame], typed: Sequence[str], csv: Write, parquet: Write,
         bucketed: Mapping[str, Write] | None = None
         ) -> dict[str, tuple[DataFrame | str, Write]]:
    """Every table as CSV, those in ``typed`` as Parquet too, computed once.

    ``bucketed`` names typed tables that are also written as ``<name>.buckets``, and how.
    """
    found: dict[str, tuple[DataFrame | str, Write]] = {}
    for name, table in tables.items():
        if name in typed:
            found[f"{name}.parquet"] = table, parquet
            found[f"{name}.csv"] = f"{name}.parquet", csv
            if bucketed and name in bucketed:
                found[f"{name}.buckets"] = f"{name}.parquet", bucketed[name]
        else:
            found[f"{name}.csv"] = table, csv
    return found
