"""Statistical quality of a synthetic table against a real one.

Formulas follow the public definitions of the single-table quality
report: column shapes (KS complement for numbers, TV complement for
categories) and column pair trends (correlation similarity for number
pairs, contingency similarity when a category is involved; numbers are
cut into 10 equal-width bins of the real range).  Overall = mean of the
two property scores.

All columns are handled in one pass each: the tables are unpivoted to
(column, value) and grouped by column, so work grows with rows x columns
and the shuffles carry only per-value counts.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import safe_div
from cohortlens.operators.dist import ks_statistic
from cohortlens.operators.gram import correlations
from cohortlens.roles import FeatureSpec

N_BINS = 10


def _long_numeric(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "value")


def _long_categorical(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "value")


def ks_complement(real: DataFrame, syn: DataFrame, cols) -> DataFrame:
    """(column_name, metric, score) with score = 1 - KS statistic."""
    ks = ks_statistic(_long_numeric(real, cols), _long_numeric(syn, cols), "value", group_cols=("column_name",))
    return ks.select("column_name", F.lit("KSComplement").alias("metric"), (F.lit(1.0) - F.col("ks")).alias("score"))


def tv_complement(real: DataFrame, syn: DataFrame, cols) -> DataFrame:
    """1 - half the L1 distance of category frequencies (NULL is a category)."""
    both = _long_categorical(real, cols).withColumn("_r", F.lit(1)).unionByName(
        _long_categorical(syn, cols).withColumn("_r", F.lit(0)))
    freq = both.groupBy("column_name", "value").agg(F.sum("_r").alias("na"), F.sum(F.lit(1) - F.col("_r")).alias("nb"))
    tot = freq.groupBy("column_name").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    j = freq.join(tot, "column_name")
    diff = F.abs(safe_div(F.col("na"), F.col("ta")) - safe_div(F.col("nb"), F.col("tb")))
    return j.groupBy("column_name").agg((F.lit(1.0) - F.lit(0.5) * F.sum(diff)).alias("score")).select(
        "column_name", F.lit("TVComplement").alias("metric"), "score")


def correlation_similarity(real: DataFrame, syn: DataFrame, cols) -> DataFrame:
    """1 - |r_real - r_syn| / 2 for every numeric pair (one pass per side)."""
    cols = list(cols)
    ra, rb = correlations(real, cols), correlations(syn, cols)
    rows = []
    for i, j in itertools.combinations(range(len(cols)), 2):
        score = 1.0 - abs(ra[i, j] - rb[i, j]) / 2.0
        rows.append((cols[i], cols[j], "CorrelationSimilarity", None if math.isnan(score) else float(score)))
    return real.sparkSession.createDataFrame(rows, "column_1 string, column_2 string, metric string, score double")


def _binned(df: DataFrame, spec: FeatureSpec, bounds: dict) -> DataFrame:
    sel = [F.col(c).cast("string").alias(c) for c in spec.categorical_cols]
    for c in spec.numeric_cols:
        lo, hi = bounds[c]
        x = F.col(c).cast("double")
        if lo is None or hi is None or hi == lo:
            b = F.when(x.isNull(), F.lit(None)).otherwise(F.lit(0))
        else:
            raw = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(N_BINS))
            b = F.least(F.greatest(raw, F.lit(0)), F.lit(N_BINS - 1))
        sel.append(b.cast("string").alias(c))
    return df.select(*sel)


def contingency_pairs(spec: FeatureSpec) -> list[tuple[str, str]]:
    cols = list(spec.numeric_cols) + list(spec.categorical_cols)
    cats = set(spec.categorical_cols)
    return [(a, b) for a, b in itertools.combinations(cols, 2) if a in cats or b in cats]


def contingency_similarity(real: DataFrame, syn: DataFrame, spec: FeatureSpec) -> DataFrame:
    """E5: 1 - TV distance of the joint frequency table of each pair that
    involves a category."""
    pairs = contingency_pairs(spec)
    if not pairs:
        return real.sparkSession.createDataFrame([], "column_1 string, column_2 string, metric string, score double")
    if spec.numeric_cols:
        mm = real.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in spec.numeric_cols],
                      *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in spec.numeric_cols]).first()
        bounds = {c: (mm[f"lo_{c}"], mm[f"hi_{c}"]) for c in spec.numeric_cols}
    else:
        bounds = {}
    arr = F.array(*[F.struct(F.lit(i).alias("p"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)])

    def joint(df, side):
        return _binned(df, spec, bounds).select(F.explode(arr).alias("t")).select("t.p", "t.x", "t.y", F.lit(side).alias("_r"))

    both = joint(real, 1).unionByName(joint(syn, 0))
    freq = both.groupBy("p", "x", "y").agg(F.sum("_r").alias("na"), F.sum(F.lit(1) - F.col("_r")).alias("nb"))
    tot = freq.groupBy("p").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    diff = F.abs(safe_div(F.col("na"), F.col("ta")) - safe_div(F.col("nb"), F.col("tb")))
    res = freq.join(tot, "p").groupBy("p").agg((F.lit(1.0) - F.lit(0.5) * F.sum(diff)).alias("score"))
    names = real.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "p int, column_1 string, column_2 string")
    return res.join(F.broadcast(names), "p").select("column_1", "column_2", F.lit("ContingencySimilarity").alias("metric"), "score")


def column_shapes(real: DataFrame, syn: DataFrame, spec: FeatureSpec) -> DataFrame:
    parts = []
    if spec.numeric_cols:
        parts.append(ks_complement(real, syn, spec.numeric_cols))
    if spec.categorical_cols:
        parts.append(tv_complement(real, syn, spec.categorical_cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_pair_trends(real: DataFrame, syn: DataFrame, spec: FeatureSpec) -> DataFrame:
    return correlation_similarity(real, syn, spec.numeric_cols).unionByName(contingency_similarity(real, syn, spec))


def quality_report(real: DataFrame, syn: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row: overall_score, column_shapes, column_pair_trends.
    NaN/NULL scores (constant columns) are left out of the means."""
    shapes = column_shapes(real, syn, spec).agg(F.avg(F.nanvl("score", F.lit(None))).alias("column_shapes"))
    trends = column_pair_trends(real, syn, spec).agg(F.avg(F.nanvl("score", F.lit(None))).alias("column_pair_trends"))
    s, t = shapes.scalar(), trends.scalar()
    return real.sparkSession.range(1).select(
        ((s + t) / F.lit(2.0)).alias("overall_score"), s.alias("column_shapes"), t.alias("column_pair_trends"))
