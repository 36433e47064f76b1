"""Progress of a run that survives a lost driver.

A run deals its open items to buckets and commits each bucket's responses before the next
one is asked, in a folder named after the run next to the log:

    <log>/_progress/<run>/bucket-<number>-<attempt>/      the responses, then a marker

A folder counts only with its marker, which is written after the job that filled it. A
run that resumes takes the answers of marked folders first, drops those that reached the
log meanwhile, and asks only for the rest; failed calls are asked for again. When the log
has the responses, the run's folder is marked as logged; the next run of that name
removes it.

Readers of the log skip the folder, as its name starts with an underscore.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runlog import _fs, pending

MARK = "_COMMITTED"
LOGGED = "_LOGGED"


class Progress:
    def __init__(self, spark: SparkSession, log_path: str, run_id: str | None, schema: T.StructType):
        self.spark, self.schema = spark, schema
        self.path = f"{log_path.rstrip('/')}/_progress/{quote(run_id or 'run', safe='')}"
        self.fs, self._path = _fs(spark, self.path)
        if self.fs.exists(self._path(f"{self.path}/{LOGGED}")):
            self.clear()
        self.earlier = self._folders()  # of a run that did not end
        self.own: list[str] = []

    def _folders(self) -> list[str]:
        found = self.fs.globStatus(self._path(f"{self.path}/bucket-*/{MARK}")) or []
        return sorted(st.getPath().getParent().toString() for st in found)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _touch(self, path: str) -> None:
        self.fs.create(self._path(path), True).close()

    def answered(self, log: DataFrame | None = None) -> DataFrame | None:
        """Answers committed before this run that the log does not hold, None without any."""
        if not self.earlier:
            return None
        rows = self._read(self.earlier).where(F.col("error").isNull())
        return rows if log is None else pending(rows, log)

    def commit(self, rows: DataFrame, number: int) -> None:
        """Write a bucket's responses; they count from here on."""
        folder = f"{self.path}/bucket-{number:05d}-{uuid.uuid4().hex[:8]}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.option(
            "compression", "zstd").parquet(folder)
        self._touch(f"{folder}/{MARK}")
        self.own.append(folder)

    def rows(self) -> DataFrame:
        """The responses of this run's buckets."""
        return self._read(self.own)

    def finish(self) -> None:
        """The log has everything: what is here will not be taken for answers again."""
        self._touch(f"{self.path}/{LOGGED}")

    def clear(self) -> None:
        self.fs.delete(self._path(self.path), True)
