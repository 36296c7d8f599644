"""Shared helpers of the text operators.

Intermediate results that are read more than once are written as Parquet
into the shared folder named by ``spark.checkpoint.dir``: executors can be
lost at any time and a reread never recomputes a Python stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

#: what separates words: [\x20\x09-\x0D]
WORD_GAP = "\\x20\\x09-\\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def numbered(df: DataFrame, name: str = "__cl_row") -> DataFrame:
    """Add a row number unique in ``df`` (stable only once the result is staged)."""
    return df.withColumn(name, F.monotonically_increasing_id())
