"""Stored feed tables that later runs use again while their sources are unchanged.

A folder holds the tables, each under a name of its own, and a manifest with one
row per stored table: its name, the signature of what it was made from, where it
is and the counts that came with it.  The row is written after the table, so a
run that dies leaves no row and its table is never read.  The newest row of a
name counts.  When a table is replaced, all but the newest ``keep`` ones of its
name are removed, so a job that still reads the one before ends undisturbed.

A file counts as unchanged while its path, size and time of change are.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Raised when a stored table's content changes for the same sources and settings.
FORMAT = 1
_MANIFEST = "name string, signature string, path string, counts map<string,bigint>, stored timestamp"


class TableStore:
    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        if keep < 1:
            raise ValueError("keep must be at least 1")
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def signature(self, paths: list[str], settings: dict) -> str:
        """A digest of the files below ``paths`` (path, size, time of change)
        and of ``settings``.  Spark lists the files and reduces them to one row of
        sums; no content is read."""
        found = []
        for path in sorted(paths):
            files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                     .select("path", "length", "modificationTime"))
            one = lambda salt: F.xxhash64(F.lit(salt), "path", "length", "modificationTime")
            found.append([path, *map(str, files.agg(
                F.count(F.lit(1)), F.sum("length"), F.sum(one(1).cast("decimal(38,0)")), F.bit_xor(one(2))).first())])
        text = json.dumps([FORMAT, found, settings], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    def _rows(self, name: str) -> list[Row]:
        """Manifest rows of a name, newest first."""
        path = f"{self.folder}/manifest"
        if not self._exists(path):
            return []
        return (self.spark.read.schema(_MANIFEST).parquet(path).where(F.col("name") == name)
                .orderBy(F.desc("stored"), F.desc("path")).collect())     # one row per stored table

    def find(self, name: str, signature: str) -> Row | None:
        """The newest table of a name, if it has this signature."""
        rows = self._rows(name)
        found = rows[0] if rows and rows[0]["signature"] == signature else None
        return found if found and self._exists(found["path"]) else None

    def add(self, name: str, signature: str, write: Callable[[str], dict[str, int]]) -> str:
        """``write`` stores the table at the path it is given and returns the
        counts to keep with it."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        counts = write(path)
        row = self.spark.createDataFrame([(name, signature, path, counts)], "name string, signature string, path string, counts map<string,bigint>")
        row.withColumn("stored", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        for old in self._rows(name)[self.keep:]:
            self._remove(old["path"])
        return path

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _file_system(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(context._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, files = self._file_system(path)
        return files.exists(at)

    def _remove(self, path: str) -> None:
        """Remove a table of this store; a path outside it is never touched."""
        if path.startswith(f"{self.folder}/") and ".." not in path:
            at, files = self._file_system(path)
            files.delete(at, True)
