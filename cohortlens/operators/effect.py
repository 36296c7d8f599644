"""Effect sizes between a real and a synthetic column.

All numeric columns are unpivoted to (column, value) and summarised in a
single aggregate per side: n, mean, sample variance.  Cliff's delta uses
cumulative counts over sorted values (``dist.cliff_counts``), never the
n1 x n2 pairs.  NaN is NULL at the source and dropped, as the library drops NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import cliff_label, cohens_label
from cohortlens.operators.dist import cliff_counts


def _long(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value").where(F.col("value").isNotNull())


def pooled_sd(n1: Column, n2: Column, v1: Column, v2: Column) -> Column:
    return F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))


def cohens_d_from_means(m1: Column, m2: Column, s1: Column, s2: Column, n1: Column, n2: Column) -> Column:
    """D from summary statistics; NULL when both sds (or the pooled sd) are 0."""
    sp = pooled_sd(n1, n2, s1 * s1, s2 * s2)
    return F.when((s1 == 0) & (s2 == 0), F.lit(None)).otherwise((m1 - m2) / F.nullif(sp, F.lit(0.0)))


def moments(real: DataFrame, syn: DataFrame, cols) -> DataFrame:
    r = _long(real, cols).groupBy("feature").agg(
        F.count("value").alias("n1"), F.avg("value").alias("mean1"), F.var_samp("value").alias("var1"))
    s = _long(syn, cols).groupBy("feature").agg(
        F.count("value").alias("n2"), F.avg("value").alias("mean2"), F.var_samp("value").alias("var2"))
    return r.join(s, "feature", "full")


def effect_size_summary(real: DataFrame, syn: DataFrame, cols) -> DataFrame:
    """X9 (with X1, X3, X5, X6, X7, X8): one row per numeric column.

    d: pooled Cohen's d (NULL if a side is empty or the sd is 0);
    glass_delta: sd of the real side; g: Hedges' g = J d, J = 1 - 3/(4 df - 1);
    delta: Cliff's delta = (#greater - #less) / (n1 n2).
    """
    m = moments(real, syn, cols)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    sp = pooled_sd(n1, n2, F.col("var1"), F.col("var2"))
    d = (F.col("mean1") - F.col("mean2")) / F.nullif(sp, F.lit(0.0))
    glass = (F.col("mean1") - F.col("mean2")) / F.nullif(F.sqrt("var1"), F.lit(0.0))
    df_ = n1 + n2 - 2
    g = d * (F.lit(1.0) - F.lit(3.0) / (F.lit(4.0) * df_ - F.lit(1.0)))
    cc = cliff_counts(_long(real, cols), _long(syn, cols), "value", group_cols=("feature",))
    delta = (F.col("n_greater") - F.col("n_less")) / (F.col("cn1") * F.col("cn2"))
    out = m.join(cc.withColumnRenamed("n1", "cn1").withColumnRenamed("n2", "cn2"), "feature", "left")
    return out.select(
        "feature",
        d.alias("cohens_d"), cohens_label(d).alias("d_interpretation"),
        g.alias("hedges_g"), glass.alias("glass_delta"),
        delta.alias("cliff_delta"), cliff_label(delta).alias("delta_interpretation"),
    )


def cohens_d_for_features(real: DataFrame, syn: DataFrame, feature_cols) -> DataFrame:
    """D and label per requested column; 'missing' / 'non-numeric' markers."""
    from pyspark.sql import types as T

    num = [c for c in feature_cols if c in real.columns and c in syn.columns
           and isinstance(real.schema[c].dataType, (T.NumericType, T.BooleanType))]
    spark = real.sparkSession
    res = effect_size_summary(real, syn, num).select("feature", "cohens_d", F.col("d_interpretation").alias("interpretation")) if num else None
    marks = []
    for c in feature_cols:
        if c not in real.columns or c not in syn.columns:
            marks.append((c, None, "missing"))
        elif c not in num:
            marks.append((c, None, "non-numeric"))
    extra = spark.createDataFrame(marks, "feature string, cohens_d double, interpretation string")
    return res.unionByName(extra) if res is not None else extra


def paired_cohens_d(diff: Column) -> Column:
    """E16 (aggregate): mean(diff) / sd(diff, ddof 1); 0 when the sd is 0."""
    sd = F.stddev_samp(diff)
    return F.when(sd == 0, F.lit(0.0)).otherwise(F.avg(diff) / sd)
