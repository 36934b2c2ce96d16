"""SNK4, STR4: a table that jobs append to and that a crash neither loses from nor doubles in.

A batch is staged as Parquet files in a folder of its own, named by the batch and the attempt; what makes it
part of the table is its commit record, a file of the batch's name that says which folder. Records
are written aside and renamed into place, which file systems with an atomic rename do for one writer only.
Readers follow records alone, so files of an attempt that died before its commit are never read, and
a batch that is appended again after its commit is left as it was."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _record(self, batch: str):
        return self._path(f"{self.path}/commits/{batch}")

    def folders(self) -> list[str]:
        """The folders of all committed batches."""
        if not self._fs.exists(self._path(f"{self.path}/commits")):
            return []
        return sorted(f"{self.path}/data/{r[0]}" for r in self.spark.read.text(f"{self.path}/commits").collect())  # one per batch

    def append(self, df: DataFrame, batch: str, before_commit=None) -> bool:
        """Append ``df`` as ``batch``, a name of letters, digits and '.=-' that starts with a letter; False,
        and nothing done, if that batch is committed. ``before_commit`` is called between the files and
        the record (tests raise there)."""
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9.=-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self._fs.exists(self._record(batch)):
            return False
        attempt = f"{batch}+{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{attempt}")
        if before_commit:
            before_commit()
        aside = self._path(f"{self.path}/commits/.{attempt}")
        out = self._fs.create(aside, False)
        out.write(attempt.encode())
        out.close()
        if not self._fs.exists(self._record(batch)) and self._fs.rename(aside, self._record(batch)):
            return True
        self._fs.delete(aside, False)
        return False

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def sweep(self) -> int:
        """Delete the folders that no record names, while no writer is at work; how many there were."""
        kept, gone = set(self.folders()), 0
        if self._fs.exists(self._path(f"{self.path}/data")):
            for f in self._fs.listStatus(self._path(f"{self.path}/data")):
                if f"{self.path}/data/{f.getPath().getName()}" not in kept:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        return gone
