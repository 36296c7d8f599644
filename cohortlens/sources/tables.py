"""Parquet tables of a data folder (``<dir>/<name>.parquet``).

Reads are lazy: Catalyst prunes columns and pushes filters into the
parquet scan, so a table that a plan does not touch is never read (S6).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from cohortlens.functions.exprs import nan_to_null

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, data_dir: str, name: str, *, nan_as_null: bool = True) -> DataFrame:
    path = os.path.join(data_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    return nan_to_null(df) if nan_as_null else df


class Tables:
    """Attribute access to the tables of one folder: ``Tables(spark, d).orders``."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = spark
        self.data_dir = data_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.data_dir, name)
        raise AttributeError(name)
