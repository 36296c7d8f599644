"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` with a zero denominator giving NULL."""
    return num / F.nullif(den, F.lit(0))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are set; NULL when a side is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def label_from_text(c: Column, positives: list[str]) -> Column:
    """0/1 label: lower-cased text in ``positives``; NULL text is class 0."""
    return F.coalesce(F.lower(c).isin([p.lower() for p in positives]), F.lit(False)).cast("int")


def clip_lower(c: Column, lower: float) -> Column:
    """Lower clip that keeps NULL."""
    return F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(lower)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes SQL NULL once, at the source."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def log_loss(p1: Column, y: Column, eps: float = 1e-15) -> Column:
    """Per-row log loss of a probability for class 1, clipped at ``eps``."""
    p_true = F.when(y == 1, p1).otherwise(F.lit(1.0) - p1)
    return -F.log(F.least(F.greatest(p_true, F.lit(eps)), F.lit(1.0)))


def cohens_label(d: Column) -> Column:
    """Effect label for Cohen's d (E17, X3); NULL/NaN is 'undefined'."""
    a = F.abs(d)
    return (
        F.when(d.isNull() | F.isnan(d), F.lit("undefined"))
        .when(a < 0.2, F.lit("negligible"))
        .when(a < 0.5, F.lit("small"))
        .when(a < 0.8, F.lit("medium"))
        .otherwise(F.lit("large"))
    )


def cliff_label(delta: Column) -> Column:
    """Effect label for Cliff's delta."""
    a = F.abs(delta)
    return (
        F.when(delta.isNull() | F.isnan(delta), F.lit("undefined"))
        .when(a < 0.147, F.lit("negligible"))
        .when(a < 0.33, F.lit("small"))
        .when(a < 0.474, F.lit("medium"))
        .otherwise(F.lit("large"))
    )


def first_metric(*candidates: Column) -> Column:
    """First non-null candidate read as double."""
    return F.coalesce(*[F.try_cast_double(c) if hasattr(F, "try_cast_double") else c.try_cast("double") for c in candidates])


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; used where results are compared across engines."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
