"""Tables of one folder of Parquet files, read lazily by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """`Tables(spark, folder).orders` reads folder/orders.parquet; nothing is read until an action. kept: what one query has written for its own later steps."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
