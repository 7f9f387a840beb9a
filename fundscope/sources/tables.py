"""Readers for the parquet tables in a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One table; the scan is lazy, so later filters/projections are pushed into it."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


class Catalog:
    """Lazy accessor ``Catalog(spark, dir).orders`` over the driver tables."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = spark
        self.data_dir = data_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return read_table(self.spark, self.data_dir, name)
        raise AttributeError(name)
