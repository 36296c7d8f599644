"""Long metrics table ``(dataset, synthesizer, seed, metric, value)``.

Evaluation runs append to it; roll-ups read it.  ``standin_metrics``
derives one from the events table so the roll-ups run on data that grows
with the input: synthesizer = event type, seed = weekday of the event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the stand-in: metric names and the "high value" cut.
STANDIN_METRICS = ["mean_value", "n_events", "mean_k", "high_value_mean"]
HIGH_VALUE = 300.0


def standin_metrics(t) -> DataFrame:
    e = t.events
    k = F.get_json_object("props", "$.k").cast("double")
    wide = e.groupBy(F.col("event_type").alias("synthesizer"), (F.dayofweek("ts") - 1).alias("seed")).agg(
        F.avg("value").alias("mean_value"),
        F.count(F.lit(1)).cast("double").alias("n_events"),
        F.avg(k).alias("mean_k"),
        F.avg(F.when(F.col("value") > HIGH_VALUE, F.col("value"))).alias("high_value_mean"),
    )
    return wide.unpivot(["synthesizer", "seed"], STANDIN_METRICS, "metric", "value").select(
        F.lit("events").alias("dataset"), "synthesizer", "seed", "metric", "value")


def expected_grid(metrics: DataFrame, n_seeds: int, metric_names: list[str]) -> DataFrame:
    """Every (dataset, synthesizer) seen x seeds 0..n-1 x expected metrics."""
    spark = metrics.sparkSession
    seeds = spark.range(n_seeds).select(F.col("id").cast("int").alias("seed"))
    names = spark.createDataFrame([(m,) for m in metric_names], "metric string")
    pairs = metrics.select("dataset", "synthesizer").distinct()
    # Both broadcast sides are fixed-size lists (seeds, metric names).
    return pairs.join(F.broadcast(seeds), how="cross").join(F.broadcast(names), how="cross")
