"""A log of commits: numbered files that are created once and never changed."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ATTEMPTS = 1000


def read_or_empty(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    """What lies under ``path``, or no rows if nothing was written there yet."""
    try:
        return spark.read.schema(ddl).format(fmt).load(path)
    except Exception as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], ddl)


class CommitLog:
    """Commits in one order that all writers agree on.

    A writer takes the number after the last one it sees. The file of that number is put
    in place under the condition that there is none yet; if another writer was faster,
    the next number is tried. Numbers have no gaps and no two commits share one. The
    content is complete before the file appears.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def entries(self) -> DataFrame:
        """``(seq, commit, kind, n, before)``; ``before`` is the sum of ``n`` of earlier ones."""
        rows = read_or_empty(self.spark, self.folder, "commit string, kind string, n bigint", "json")
        if rows.inputFiles():
            rows = rows.withColumn("seq", F.regexp_extract(
                F.col("_metadata.file_name"), "([0-9]+)", 1).cast("bigint"))
        else:
            rows = rows.withColumn("seq", F.lit(0).cast("bigint"))
        earlier = Window.partitionBy().orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        # a small row for each commit
        return rows.select("seq", "commit", "kind", "n", F.coalesce(
            F.sum("n").over(earlier), F.lit(0).cast("bigint")).alias("before"))

    def append(self, commit: str, kind: str, n: int) -> int:
        """Add a commit that counts ``n`` ledger entries; gives its number."""
        body = json.dumps({"commit": commit, "kind": kind, "n": n})
        for _ in range(ATTEMPTS):
            seq = (self.entries().agg(F.max("seq")).first()[0] or 0) + 1
            if self._put(f"{seq:020d}.json", body):
                return seq
        raise RuntimeError(f"no free number in {self.folder}")

    def _local(self, path: str) -> str | None:
        parts = urlparse(path)
        if parts.scheme not in ("", "file"):
            return None
        return unquote(parts.path) if parts.scheme else path

    def _put(self, name: str, body: str) -> bool:
        """Create the file with its content, unless it exists already."""
        local = self._local(self.folder)
        if local is not None:
            os.makedirs(local, exist_ok=True)
            draft = f"{local}/_{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as out:
                out.write(body)
            try:
                os.link(draft, f"{local}/{name}")  # fails if the name is taken
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        jvm = self.spark.sparkContext._jvm
        fs, folder = self._file_system(self.folder)
        fs.mkdirs(folder)
        draft = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:  # without OVERWRITE it fails if the name is taken
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(folder, name),
                           self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as err:
            if "FileAlreadyExists" not in str(err):
                raise
            fs.delete(draft, False)
            return False
        return True

    def _file_system(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def delete(self, path: str) -> bool:
        fs, where = self._file_system(path)
        return bool(fs.delete(where, True))
