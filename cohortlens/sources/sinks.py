"""Writers (S9, S10, S11, S12, S14, S15, S16).

Overwrite semantics replace the source's delete-then-write; the
consolidated table is partitioned by (split, synthesizer) with dynamic
partition overwrite, so rewriting one synthesizer leaves the others and
a reader of one slice prunes to its folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.roles import TableRoles


def write_table(df: DataFrame, path: str) -> None:
    """Full / train / test / synthetic table as parquet."""
    df.write.mode("overwrite").parquet(path)


def write_consolidated(parts: dict, path: str) -> None:
    """S10 + S15: {(split, synthesizer): DataFrame} -> one partitioned table;
    mismatched columns become NULL (U2)."""
    out = None
    for (split, synth), df in parts.items():
        tagged = df.withColumn("split", F.lit(split)).withColumn("synthesizer", F.lit(synth))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    spark = out.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        out.write.mode("overwrite").partitionBy("split", "synthesizer").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def read_slice(spark: SparkSession, path: str, split: str, synthesizer: str) -> DataFrame:
    """One slice; the filter prunes partitions at planning time."""
    return spark.read.parquet(path).where((F.col("split") == split) & (F.col("synthesizer") == synthesizer))


def write_json_document(spark: SparkSession, obj: dict, path: str) -> None:
    """A result document (a few kilobytes of scalars) as one JSON file."""
    spark.createDataFrame([(json.dumps(obj, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_roles(spark: SparkSession, roles: TableRoles, path: str) -> None:
    """The table's column roles next to the table."""
    spark.createDataFrame([(roles.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_roles(spark: SparkSession, path: str) -> TableRoles:
    return TableRoles.from_json(spark.read.text(path).first()["value"])
