"""Mixing sources to target weights by Poisson replication (operator 7).

A source with weight ``w`` of ``W`` gets the mean repetition rate
``w / W * budget / bytes(source)``.  Each document draws how often it occurs
by inverting the Poisson distribution of its source's rate at a uniform
number hashed from (seed, doc_id); the copies are then dealt out by a hash of
(seed, doc_id, copy), which shuffles the corpus globally.  Draws are pure
functions of their keys, so a retried task draws the same numbers.

A rate above ``PART_RATE`` is drawn as a sum of equal Poisson parts (which is
Poisson of the whole rate), so the tables of distribution values stay short
for any rate.

Defined results
    * null text has no bytes; a source without bytes has rate 0 and leaves;
    * a null source is a source of its own; with explicit ``weights`` sources
      that are not named leave (``None`` names the null source);
    * rows that share a ``doc_id`` (null included) share their draw;
    * an empty table gives an empty result; extra columns are kept by
      ``mix_documents``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.hashing import h52, uniform
from cohortlens.llm.common import staged

SEED = 20
PART_RATE = 32.0
_STEPS = 160  # distribution values kept per part; beyond is less than 1e-40 at PART_RATE
_TOP = 1 - 1e-13


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: float | None = None) -> DataFrame:
    """source, bytes, rate and the distribution of one part (parts, cdf).

    ``weights``: target share of each source (any positive scale); None gives
    every source present the same share.  ``budget``: bytes of the mixture;
    None keeps the bytes of the weighted sources.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).alias("bytes"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, weight double")
        weighed = sizes.join(table, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    weighed = weighed.where("bytes > 0")
    total, scale = weighed.agg(F.sum("bytes"), F.sum("weight")).first()
    rate = F.col("weight") / F.lit(scale or 1.0) * F.lit(float(budget if budget is not None else total or 0)) / F.col("bytes")
    part = weighed.withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int")))
    part = part.withColumn("r", F.col("rate") / F.col("parts"))
    cdf = F.expr(
        f"""filter(aggregate(sequence(1, {_STEPS}), named_struct('p', exp(-r), 'c', exp(-r), 'a', array(exp(-r))),
              (s, k) -> named_struct('p', s.p * r / k, 'c', s.c + s.p * r / k, 'a', concat(s.a, array(s.c + s.p * r / k)))).a,
              c -> c <= {_TOP!r})"""
    )
    return part.select("source", "bytes", "rate", "parts", cdf.alias("cdf"))


def replicate(docs: DataFrame, weights=None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with __cl_rate, __cl_copies, __cl_copy (from 1) and __cl_order, in shuffled order."""
    rates = source_rates(docs, weights, budget).select(
        F.col("source").alias("__cl_source"), F.col("rate").alias("__cl_rate"), F.col("parts").alias("__cl_parts"),
        F.col("cdf").alias("__cl_cdf"),
    )
    # written, its size is known when the join is planned: a small table is broadcast and documents move once only
    rates = staged(rates, "source-rates")
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col("__cl_source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("__cl_parts")), lambda j: uniform(seed, F.col("doc_id"), j))
    count = F.aggregate(
        draws, F.lit(0), lambda n, u: n + F.size(F.filter("__cl_cdf", lambda c: c <= u))
    )
    copies = joined.withColumn("__cl_copies", count).where("__cl_copies > 0")
    copies = copies.withColumn("__cl_copy", F.explode(F.sequence(F.lit(1), F.col("__cl_copies"))))
    keyed = copies.withColumn("__cl_order", h52(seed, F.lit("order"), F.col("doc_id"), F.col("__cl_copy")))
    return keyed.drop("__cl_source", "__cl_parts", "__cl_cdf").repartition("__cl_order").sortWithinPartitions("__cl_order")


def mix_documents(docs: DataFrame, weights=None, budget: float | None = None, seed: int = SEED, draws: bool = False) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as drawn, shuffled; ``draws`` keeps the columns of ``replicate``."""
    kept = ["__cl_rate", "__cl_copies", "__cl_copy", "__cl_order"] if draws else []
    return replicate(docs, weights, budget, seed).select(*docs.columns, *kept)


def poisson_mixture(docs: DataFrame, weights=None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_bytes, rate, copies, copy, shuffle_key: one row per copy, measured on the mixed texts."""
    return mix_documents(docs.select("doc_id", "source", "text"), weights, budget, seed, draws=True).select(
        "doc_id",
        "source",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.round("__cl_rate", 6).alias("rate"),
        F.col("__cl_copies").alias("copies"),
        F.col("__cl_copy").alias("copy"),
        F.col("__cl_order").alias("shuffle_key"),
    )
