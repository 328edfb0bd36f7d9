"""Iterations whose state is a table written once a step, so that no step computes the ones before it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.sources.shared import shared_folder


class Supersteps:
    """Tables of one iteration in the folder that all executors share. A lost executor costs a re-read of the files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, shared_folder(spark, name), 0

    def table(self, df: DataFrame) -> DataFrame:
        """Writes df and returns the table as read back."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
