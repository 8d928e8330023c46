"""Intermediate tables in the folder that the cluster shares.

Iterative operators cut their lineage by writing Parquet below the folder named in
``spark.checkpoint.dir``; lost executors then cost a task, never a whole chain of stages.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a new local folder in local mode (tests); a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one run of an operator. ``result`` keeps one table and drops the others; a write that fails drops them all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _keep.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return self._written(df, f"{self.path}/{self.n:02d}-{name}")

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        try:
            df.write.parquet(path)
        except BaseException:
            self.clear()
            raise
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
                _delete(self.spark, f)

    def clear(self) -> None:
        """Delete all tables of this run."""
        _delete(self.spark, self.path)

    def result(self, df: DataFrame) -> DataFrame:
        out = self._written(df, f"{self.path}-result")
        _delete(self.spark, self.path)
        return out


_keep: list[Scratch] = []


@atexit.register
def _clean() -> None:
    for s in _keep:
        try:
            _delete(s.spark, s.path)
            _delete(s.spark, f"{s.path}-result")
        except Exception:  # the session has ended already
            return
