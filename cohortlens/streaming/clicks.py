"""Incremental click-log aggregation with Structured Streaming.

Two queries read the new files.  One adds up clicks and records per key; it
needs no state.  The other lists the sites and days of every click as (key,
kind, value) and lets each triple pass only the first time: that is the whole
state, one small row per triple in RocksDB, on disk and spread over the tasks by
the triple, so neither a key with most of the log nor a long site catalogue
grows any single value.  Counting what passes gives the exact distinct counts.

Each batch writes *deltas*: numbers to be added, for the keys that it met, in a
folder per batch under the session's shared checkpoint directory (a replayed
batch replaces its folder).  The table is the sum of all deltas.  When more than
``MOST_DELTAS`` folders have gathered they are folded into one *base* folder,
which holds everything up to its batch; a base counts once it is complete, so a
crash in between leaves the old folders in force.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.exprs import nan_to_null, safe_div
from cohortlens.session import ensure_checkpoint_dir

MOST_DELTAS = 16
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


def click_deltas(clicks: DataFrame, keys: list[str]) -> DataFrame:
    """What the clicks add to the totals of their keys."""
    return clicks.groupBy(*keys).agg(
        F.sum(F.col("sum_click").cast("decimal(28,9)")).cast("decimal(38,9)").alias("clicks"), F.count(F.lit(1)).alias("records"))


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, value) of sites and days, each once for the life of the stream."""
    listed = F.array(F.struct(F.lit("site").alias("kind"), F.col("id_site").cast("string").alias("value")),
                     F.struct(F.lit("day").alias("kind"), F.col("date").cast("string").alias("value")))
    return stream.select(*keys, F.inline(listed)).where(F.col("value").isNotNull()).dropDuplicates([*keys, "kind", "value"])


def value_deltas(seen: DataFrame, keys: list[str]) -> DataFrame:
    return seen.groupBy(*keys).agg(F.count_if(F.col("kind") == "site").alias("sites"), F.count_if(F.col("kind") == "day").alias("days"))


class Deltas:
    """Numbers per key, written batch by batch and read as their sums."""

    def __init__(self, spark: SparkSession, path: str, keys: T.StructType, numbers: dict):
        self.spark, self.path, self.keys, self.numbers = spark, path, keys.names, numbers
        fields = [*keys.fields, *(T.StructField(n, t) for n, t in numbers.items())]
        self.schema = T.StructType([*fields, T.StructField("level", T.StringType()), T.StructField("epoch", T.LongType())])
        if not self._epochs("base"):
            self.write(spark.createDataFrame([], T.StructType(fields)), -1, "base")

    def write(self, rows: DataFrame, epoch: int, level: str = "delta") -> None:
        rows.write.mode("overwrite").parquet(os.path.join(self.path, f"level={level}", f"epoch={epoch}"))

    def _folder(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *parts))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _epochs(self, level: str) -> list[int]:
        """Batches whose folder is complete (names only, nothing is read)."""
        folder, fs = self._folder(f"level={level}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix("epoch=")) for n in names if fs.exists(self._folder(f"level={level}", n, "_SUCCESS")[0]))

    def _parts(self) -> tuple[int, list[int]]:
        """The newest base and the deltas after it."""
        base = self._epochs("base")[-1]
        return base, [e for e in self._epochs("delta") if e > base]

    def read(self) -> DataFrame:
        """The sums of all that is written; folders that a base replaced are not read."""
        base, deltas = self._parts()
        df = self.spark.read.schema(self.schema).parquet(self.path)
        live = ((F.col("level") == "base") & (F.col("epoch") == base)) | ((F.col("level") == "delta") & F.col("epoch").isin(deltas))
        return df.where(live).groupBy(*self.keys).agg(*[F.sum(n).cast(t).alias(n) for n, t in self.numbers.items()])

    def compact(self, most: int) -> None:
        """Fold the deltas into a new base when there are more than ``most``, and remove what it replaces."""
        base, deltas = self._parts()
        if len(deltas) <= most:
            return
        self.write(self.read(), deltas[-1], "base")
        for level, epoch in [("base", base), *(("delta", e) for e in deltas)]:
            folder, fs = self._folder(f"level={level}", f"epoch={epoch}")
            fs.delete(folder, True)


def finish(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys, "total_vle_clicks", "n_vle_records", "n_vle_sites", "n_vle_days",
        safe_div(F.col("total_vle_clicks"), F.col("n_vle_records")).alias("mean_vle_clicks"),
        safe_div(F.col("total_vle_clicks"), F.col("n_vle_days")).alias("clicks_per_active_day"),
    )


def run_incremental(spark: SparkSession, stream: DataFrame, keys: list[str], *, out_dir: str | None = None,
                    checkpoint: str | None = None, most_deltas: int = MOST_DELTAS, progress: list | None = None) -> DataFrame:
    """Fold everything available now into the deltas and return the table.

    Called again with the same ``out_dir`` and ``checkpoint``, only new files
    are read and only the keys in them are written.  ``progress`` receives
    the progress reports of the batches."""
    base = ensure_checkpoint_dir(spark)
    run = uuid.uuid4().hex
    out_dir = out_dir or os.path.join(base, f"clicks-out-{run}")
    checkpoint = checkpoint or os.path.join(base, f"clicks-ckpt-{run}")
    key_fields = T.StructType([stream.schema[k] for k in keys])
    totals = Deltas(spark, os.path.join(out_dir, "totals"), key_fields, {"clicks": T.DecimalType(38, 9), "records": T.LongType()})
    values = Deltas(spark, os.path.join(out_dir, "values"), key_fields, {"sites": T.LongType(), "days": T.LongType()})
    before = spark.conf.get(PROVIDER_CONF)
    spark.conf.set(PROVIDER_CONF, STATE_PROVIDER)
    try:
        for name, rows, sink, fold in (("totals", stream, totals, click_deltas), ("values", first_seen(stream, keys), values, value_deltas)):
            q = (rows.writeStream.outputMode("append").foreachBatch(lambda batch, epoch, sink=sink, fold=fold: sink.write(fold(batch, keys), epoch))
                 .option("checkpointLocation", os.path.join(checkpoint, name)).trigger(availableNow=True).start())
            q.awaitTermination()
            if progress is not None:
                progress += [(name, p) for p in q.recentProgress]
    finally:
        spark.conf.set(PROVIDER_CONF, before)
    for sink in (totals, values):
        sink.compact(most_deltas)
    table = totals.read().join(values.read(), keys, "left").select(
        *keys, F.col("clicks").cast("double").alias("total_vle_clicks"), F.col("records").alias("n_vle_records"),
        F.coalesce("sites", F.lit(0)).alias("n_vle_sites"), F.coalesce("days", F.lit(0)).alias("n_vle_days"))
    return finish(table, keys)


def standin_click_stream(spark: SparkSession, data_dir: str) -> DataFrame:
    """The events table as a file stream (site = event_type, day = date(ts)); one file or a folder of part files."""
    path = os.path.join(data_dir, "events.parquet")
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    files = table.inputFiles()
    if len(files) == 1 and files[0].endswith("/events.parquet"):
        ev = reader.option("pathGlobFilter", "events.parquet").parquet(data_dir)
    else:
        ev = reader.parquet(path)
    return nan_to_null(ev).select(F.col("user_id").alias("id_student"), F.col("event_type").alias("id_site"),
                                  F.to_date("ts").alias("date"), F.col("value").alias("sum_click"))
