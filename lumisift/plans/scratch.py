"""Intermediate tables in the folder that the driver and all executors share.

A multi-pass operator cuts its lineage by writing a table and reading it again: the files outlive a lost
executor, unlike a local checkpoint, and every later pass sees the same rows. The folder is the one named by
``spark.checkpoint.dir``; only where that is unset in a local session (tests) a folder of our own is chosen.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings of a write: shuffle files end with it, and Python tasks get small batches, as rows may hold long texts.
_DURING_WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lumisift.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumisift-")
        spark.conf.set("lumisift.scratch.dir", found)
    return found.rstrip("/")


@contextmanager
def _write_settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _DURING_WRITES}
    for k, v in _DURING_WRITES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_roots: list[str] = []  # of this application, in the order of their making


@contextmanager
def released(spark: SparkSession):
    """Deletes, at its end, all scratch folders that operators made inside: results must have been written by then.

    Tables that a lazy result still reads can't be deleted by the operator that made them, so their owner is whoever
    writes the result.
    """
    begin = len(_roots)
    try:
        yield
    finally:
        for root in _roots[begin:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _roots[begin:]


class Scratch:
    """Tables of one operator run; ``drop`` deletes one that no later step reads, ``released`` all of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lumisift/{name}-{uuid.uuid4().hex}"
        self.count, self.paths = 0, []
        _roots.append(self.root)

    def table(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and return it as read back."""
        self.count += 1
        path = f"{self.root}/{self.count:02d}-{name}"
        with _write_settings(self.spark):
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lumisift_path = path
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables returned by ``table``."""
        for t in tables:
            self._delete(t._lumisift_path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete all tables of this run but these, which the result still reads."""
        kept = {t._lumisift_path for t in tables}
        for path in [p for p in self.paths if p not in kept]:
            self._delete(path)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths.remove(where)
