"""Cumulative counts over sorted values without a global window.

``value_prefix`` reduces a column to its distinct values with per-value
weights (partial/final aggregate, so a value held by a third of the rows
is one row afterwards), cuts the value range into buckets at approximate
quantiles (only balance depends on them, never the result), takes a
running sum inside each bucket (one window per bucket) and adds the
bucket offsets, a table of at most ``buckets`` rows per group.

Everything that needs order statistics builds on it: KS distance, ROC
AUC by Mann-Whitney, mid-ranks for Spearman, Cliff's delta.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.exprs import safe_div


def _n_buckets(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return buckets
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def value_prefix(df: DataFrame, value_col: str, weights: dict, *, group_cols: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """One row per (groups, distinct value) with weight sums ``w`` and
    running sums ``cum_w`` (inclusive) in ascending value order per group.

    ``weights`` maps output name -> Column (e.g. indicator of a class).
    Rows with a NULL value are dropped.
    """
    g = list(group_cols)
    base = df.where(F.col(value_col).isNotNull()).select(*g, F.col(value_col).cast("double").alias("_v"), *[c.alias(n) for n, c in weights.items()])
    agg = base.groupBy(*g, "_v").agg(*[F.sum(n).alias(n) for n in weights])
    p = _n_buckets(df, buckets)
    if p > 1:
        probs = [i / p for i in range(1, p)]
        row = agg.agg(F.percentile_approx("_v", probs, 10000).alias("q")).first()
        qs = sorted(set(x for x in (row["q"] or []) if x is not None))
        splits = [float("-inf")] + qs + [float("inf")]
        if len(splits) > 2:
            agg = Bucketizer(splits=splits, inputCol="_v", outputCol="_b", handleInvalid="keep").transform(agg)
        else:
            agg = agg.withColumn("_b", F.lit(0.0))
    else:
        agg = agg.withColumn("_b", F.lit(0.0))

    tot = agg.groupBy(*g, "_b").agg(*[F.sum(n).alias(f"_t_{n}") for n in weights])
    wo = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # ``tot`` has at most buckets x groups rows: the window over it is tiny.
    offs = tot.select(*g, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(wo), F.lit(0)).alias(f"_o_{n}") for n in weights])
    wl = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = agg.select(*g, "_b", "_v", *weights, *[F.sum(n).over(wl).alias(f"_l_{n}") for n in weights])
    out = local.join(offs, [*g, "_b"], "inner")  # AQE broadcasts by measured size
    return out.select(
        *g, F.col("_v").alias("value"), *weights,
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in weights],
    )


def _attach(df: DataFrame, totals: DataFrame, group_cols: list[str]) -> DataFrame:
    """Add per-group totals: a join on the groups (AQE broadcasts by measured
    size), or scalar subqueries when there are no groups."""
    if group_cols:
        return df.join(totals, group_cols, "inner")
    return df.select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])


def ks_statistic(a: DataFrame, b: DataFrame, value_col: str, *, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Two-sample KS statistic per group: max |F_a - F_b| over pooled values."""
    g = list(group_cols)
    both = a.select(*g, value_col, F.lit(1).alias("_s")).unionByName(b.select(*g, value_col, F.lit(2).alias("_s")))
    pre = value_prefix(both, value_col, {"na": (F.col("_s") == 1).cast("long"), "nb": (F.col("_s") == 2).cast("long")}, group_cols=group_cols)
    tot = pre.groupBy(*g).agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"))
    j = _attach(pre, tot, g)
    # a side without values has no distribution: NULL
    d = F.abs(safe_div(F.col("cum_na"), F.col("n_a")) - safe_div(F.col("cum_nb"), F.col("n_b")))
    return j.groupBy(*g).agg(F.max(d).alias("ks"))


def auc_mann_whitney(scored: DataFrame, score_col: str, label_col: str, *, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """ROC AUC with ties counted 1/2 (Mann-Whitney U / (n_pos n_neg)).

    NULL when a group has only one class.
    """
    g = list(group_cols)
    pre = value_prefix(
        scored, score_col,
        {"pos": (F.col(label_col) == 1).cast("long"), "neg": (F.col(label_col) != 1).cast("long")},
        group_cols=group_cols,
    )
    u = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * F.lit(0.5))
    agg = pre.groupBy(*g).agg(F.sum(u).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.col("_u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))
    return agg.select(*g, auc.alias("auc"), F.greatest(auc, F.lit(1.0) - auc).alias("effective_auc"), "n_pos", "n_neg")


def mid_ranks(df: DataFrame, value_col: str, *, group_cols: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Average rank of every distinct value (ties share the mean rank).

    Returns (groups, value, rank); join back on the value to rank rows.
    """
    pre = value_prefix(df, value_col, {"c": F.lit(1).cast("long")}, group_cols=group_cols, buckets=buckets)
    return pre.select(*group_cols, "value", (F.col("cum_c") - F.col("c") + (F.col("c") + F.lit(1)) / F.lit(2.0)).alias("rank"))


def cliff_counts(a: DataFrame, b: DataFrame, value_col: str, *, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """#(x > y) and #(x < y) over all pairs x in a, y in b, from
    cumulative counts (no pair is ever formed)."""
    g = list(group_cols)
    both = a.select(*g, value_col, F.lit(1).alias("_s")).unionByName(b.select(*g, value_col, F.lit(2).alias("_s")))
    pre = value_prefix(both, value_col, {"na": (F.col("_s") == 1).cast("long"), "nb": (F.col("_s") == 2).cast("long")}, group_cols=group_cols)
    tot = pre.groupBy(*g).agg(F.sum("nb").alias("_nb"))
    j = _attach(pre, tot, g)
    greater = F.col("na") * (F.col("cum_nb") - F.col("nb"))
    less = F.col("na") * (F.col("_nb") - F.col("cum_nb"))
    return j.groupBy(*g).agg(
        F.sum(greater.cast("double")).alias("n_greater"),
        F.sum(less.cast("double")).alias("n_less"),
        F.sum("na").alias("n1"),
        F.sum("nb").alias("n2"),
    )


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], *, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles per group, interpolated linearly between order
    statistics (numpy's default): columns ``q0, q1, ...`` in the order of ``probs``.

    Ranks are looked up in the prefix sums of the distinct values, so only
    the rows that hold a wanted rank (two per group and probability) meet
    in the final aggregate; nothing else leaves its task.  NULL and NaN are
    no values; a group without values does not appear.
    """
    g = list(group_cols)
    x = df.select(*g, F.col(value_col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    pre = value_prefix(x, "_x", {"c": F.lit(1).cast("long")}, group_cols=group_cols)
    sizes = pre.groupBy(*g).agg(F.sum("c").alias("_n"))
    place = lambda p: p * (F.col("_n") - 1)
    both = F.flatten(F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.array(F.floor(place(p)), F.ceil(place(p)))))
    sizes = sizes.withColumn("_ranks", F.array_distinct(both))
    j = pre.join(sizes, g, "inner") if g else pre.select("*", *[sizes.select(c).scalar().alias(c) for c in ("_n", "_ranks")])
    here = F.filter("_ranks", lambda r: (F.col("cum_c") - F.col("c") <= r) & (r < F.col("cum_c")))
    found = j.select(*g, "_n", "value", F.explode(here).alias("_rank"))
    # two values per group and probability: a small map of order statistics
    at = found.groupBy(*g).agg(F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "value"))).alias("_at"))
    out = []
    for i, p in enumerate(probs):
        spot = place(F.lit(float(p)))
        low, high = F.element_at("_at", F.floor(spot)), F.element_at("_at", F.ceil(spot))
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(f"q{i}"))
    return at.select(*g, *out)


def exact_percentiles_multi(df: DataFrame, cols, probs: list[float]) -> dict:
    """``{column: quantiles}`` of many columns in one pass over the unpivoted
    columns; to the driver go columns x probabilities numbers.  A column
    without values has None throughout."""
    cols = list(cols)
    if not cols:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "_column", "_value")
    found = {r["_column"]: [r[f"q{i}"] for i in range(len(probs))] for r in exact_quantiles(long, "_value", probs, group_cols=("_column",)).collect()}
    return {c: found.get(c, [None] * len(probs)) for c in cols}


def exact_percentiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of one column."""
    return exact_percentiles_multi(df, [col], probs)[col]
