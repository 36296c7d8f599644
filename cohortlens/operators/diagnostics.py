"""Table diagnostics (A9-A12): leakage screen, class balance, target
summary, split sizes.  Each is one aggregate pass over the table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.gram import correlations
from cohortlens.roles import TableRoles, infer_feature_spec

LEAK_WARN = 0.8
LEAK_ERROR = 0.99


def leakage_screen(df: DataFrame, feature_cols, target_cols) -> DataFrame:
    """|Pearson r| of every numeric feature with each target (one pass), then per target the max, its feature
    (the first of equal ones) and the flags.  Incomplete pairs are ignored; constant columns don't count."""
    features, targets = list(feature_cols), list(target_cols)
    r = np.abs(correlations(df, features, targets))
    rows = []
    for j, t in enumerate(targets):
        known = [(float(r[i, j]), f) for i, f in enumerate(features) if f != t and not np.isnan(r[i, j])]
        if known:
            top = max(v for v, _ in known)
            rows.append((t, top, next(f for v, f in known if v == top), top > LEAK_WARN, top >= LEAK_ERROR))
    return df.sparkSession.createDataFrame(rows, "target string, max_abs_corr double, max_feature string, warn boolean, error boolean")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """A10: rows per class and the min/max balance ratio."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    ratio = counts.agg(F.min("n") / F.max("n")).scalar()
    return counts.select(F.col(target).cast("string").alias("class"), "n", ratio.alias("balance_ratio"))


def target_describe(df: DataFrame, target: str) -> DataFrame:
    """Min, max, mean, sample std of a numeric target."""
    x = F.col(target).cast("double")
    return df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))


def run_metadata(df: DataFrame, roles: TableRoles, split_col: str = "split") -> DataFrame:
    """Columns, features and targets of the table (its schema tells) beside the rows of each split."""
    columns = [c for c in df.columns if c != split_col]
    inputs = [c for c in columns if c not in (*roles.id_cols, *roles.target_cols)]
    spec = infer_feature_spec(df.select(*inputs))
    counts = {"n_columns": len(columns), "n_features": len(inputs), "n_numeric": len(spec.numeric_cols),
              "n_categorical": len(spec.categorical_cols), "n_targets": len(roles.target_cols)}
    return split_sizes(df, split_col).select("*", *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])
