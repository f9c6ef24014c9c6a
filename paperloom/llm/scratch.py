"""Intermediate tables in the shared checkpoint folder.

A table that is written and read again has a short plan of its own, real sizes for the optimizer's
join choices, and survives the loss of an executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from paperloom.session import ensure_checkpoint_dir


class Scratch:
    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.base = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
        self.paths: dict[str, str] = {}
        self.count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of ``df`` from a new table; an older one of the same name is deleted once the new
        one, which may read it, is there."""
        self.count += 1
        path = f"{self.base}/{name}-{self.count}"
        df.write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete all tables, once nothing reads them any more."""
        self.paths.clear()
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
