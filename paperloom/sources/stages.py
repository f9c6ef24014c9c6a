"""Tables between the steps of an iterative operator, in the shared checkpoint folder.

A step is written once and read again: its plan stays short, the optimizer sees real sizes, and a lost
executor costs at most the step at work. The number of rows comes with the writing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


class Stages:
    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.base = f"{spark.sparkContext.getCheckpointDir()}/stages-{uuid.uuid4()}"
        self.count = 0

    def write(self, df: DataFrame, counted: Column | None = None) -> tuple[DataFrame, int, str]:
        """The table read again, its number of rows, or of those ``counted``, and its path; one job."""
        self.count += 1
        path, seen = f"{self.base}/{self.count}", Observation()
        rows = F.count(F.lit(1)) if counted is None else F.count_if(counted)
        df.observe(seen, rows.alias("rows")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["rows"], path

    def read(self, schema, paths: list[str]) -> DataFrame:
        """Several tables of one schema as one."""
        return self.spark.read.schema(schema).parquet(*paths)

    def remove(self) -> None:
        """Delete all tables, once nothing reads them any more."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
