"""Intermediate tables that outlive the executors that wrote them.

Iterative and multi-pass operators read their input several times. They write
it once to the shared folder named by ``spark.checkpoint.dir`` and read it
back: the lineage ends there, the file sizes give the optimizer true
statistics, and a lost executor costs only its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="seston-"))
    return context.getCheckpointDir()


_written: list[Staged] = []


class Staged:
    """A written table: ``df`` reads it, ``drop()`` removes the files."""

    def __init__(self, df: DataFrame):
        self._spark = df.sparkSession
        self.path = f"{shared_folder(self._spark)}/stage-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _written.append(self)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _written.remove(self)
        jvm = self._spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self._spark._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)


def drop_all() -> None:
    """Remove every table this process has staged and not dropped. Results that
    read them can no longer be used."""
    for table in list(_written):
        table.drop()


def stage(df: DataFrame) -> DataFrame:
    """Run ``df`` once, keep the rows in the shared folder, read them back."""
    return Staged(df).df
