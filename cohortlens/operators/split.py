"""Seeded splits and exact-size samples.

A row (or group) is ranked by ``h52(seed, key)``; "the first n" are the
rows whose hash is at most the n-th smallest hash.  That threshold is
found without a global sort: a histogram of the hash range is aggregated
(about 65 536 counts reach the driver, shared by all classes), the bucket
holding the n-th value is kept and refined; once a bucket holds ``FEW`` values
at most, they are read.  Each round is one partial/final hash aggregate for all
classes together; the rows never leave their tasks.  Membership is then a
per-row comparison.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.hashing import h52

_BITS = 52
_STEP = 16
FEW = 1000


def kth_smallest_by(df: DataFrame, hcol: str, group: str, wants: dict) -> dict:
    """Per value of ``group``, the exact k-th smallest (1-based) of a non-negative 52-bit integer column.

    -1 for k <= 0 or a value without rows, the maximum for k >= count.
    """
    out = {c: -1 for c in wants}
    open_ = {c: (0, k) for c, k in wants.items() if k > 0}  # start of the class's bucket, rank inside it
    bits, step = _BITS, max(4, _STEP - (len(open_) - 1).bit_length()) if open_ else _STEP
    schema = T.StructType([T.StructField("_g", df.schema[group].dataType), T.StructField("_lo", T.LongType())])
    while open_:
        cells = df.sparkSession.createDataFrame([(c, lo) for c, (lo, _) in open_.items()], schema)  # a row per class
        rest = F.col(hcol) - F.col("_lo")
        inside = df.join(F.broadcast(cells), F.col(group).eqNullSafe(F.col("_g"))).where((rest >= 0) & (rest < F.lit(1 << bits)))
        shift = max(0, bits - step)
        counts: dict = {}
        for r in inside.groupBy("_g", F.shiftright(rest, shift).alias("_b")).count().collect():
            counts.setdefault(r["_g"], []).append((r["_b"], r["count"]))
        found, largest = {}, 0
        for c, (lo, need) in open_.items():
            if c not in counts:
                continue
            need = min(need, sum(n for _, n in counts[c]))
            for b, n in sorted(counts[c]):
                if need <= n:
                    break
                need -= n
            found[c], largest = (lo + (b << shift), need), max(largest, n)
        open_, bits = found, shift
        if bits == 0:
            return out | {c: lo for c, (lo, _) in open_.items()}
        if open_ and largest <= FEW:
            cells = df.sparkSession.createDataFrame([(c, lo) for c, (lo, _) in open_.items()], schema)
            inside = df.join(F.broadcast(cells), F.col(group).eqNullSafe(F.col("_g"))).where((rest >= 0) & (rest < F.lit(1 << bits)))
            values: dict = {}
            for r in inside.select("_g", F.col(hcol).alias("_h")).collect():  # FEW per class at most
                values.setdefault(r["_g"], []).append(r["_h"])
            return out | {c: sorted(values[c])[need - 1] for c, (_, need) in open_.items()}
    return out


def kth_smallest(df: DataFrame, hcol: str, k: int) -> int:
    """Exact k-th smallest of the whole column."""
    return kth_smallest_by(df.select(F.col(hcol), F.lit(0).alias("_all")), hcol, "_all", {0: k})[0]


def first_n_threshold(keys: DataFrame, key_expr: Column, seed: int, n: int) -> int:
    """Hash threshold such that exactly the ``n`` smallest-hash keys pass."""
    hashed = keys.select(h52(seed, key_expr).alias("_h")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return kth_smallest(hashed, "_h", n)
    finally:
        hashed.unpersist()


def n_test(test_size: float, n: int) -> int:
    """Test count of a shuffle split: ceil(test_size * n) in float arithmetic."""
    return int(math.ceil(test_size * n)) if test_size < 1 else int(test_size)


def group_split(df: DataFrame, group_col: str, *, test_size: float, seed: int) -> DataFrame:
    """Whole groups on one side; test = ceil(test_size * n_groups) groups.

    Adds column ``split`` in {train, test}.
    """
    groups = df.select(group_col).where(F.col(group_col).isNotNull()).distinct()
    n_groups = groups.count()
    k = n_test(test_size, n_groups)
    thr = first_n_threshold(groups, F.col(group_col), seed, k)
    return df.withColumn("split", F.when(h52(seed, F.col(group_col)) <= F.lit(thr), F.lit("test")).otherwise(F.lit("train")))


def _first_n(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """``df`` with ``_in``: the ``n`` rows with the smallest key hashes, exactly, also when keys repeat.

    Rows below the n-th hash are in; among the rows that share it, as many
    as are missing, by the hash of the whole row (rows equal in every column
    are interchangeable).
    """
    h = h52(seed, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    hashed = df.withColumn("_h", h)
    thr = kth_smallest(hashed, "_h", n)
    below = hashed.where(F.col("_h") < F.lit(thr)).count() if n > 0 else 0
    at = hashed.where(F.col("_h") == F.lit(thr)).count() if n > 0 else 0
    if below + at <= n:
        return hashed.withColumn("_in", F.col("_h") <= F.lit(thr)).drop("_h")
    # repeated keys at the threshold: rank only those rows
    whole = F.xxhash64(*[F.col(c) for c in df.columns])
    tied = hashed.where(F.col("_h") == F.lit(thr)).withColumn("_w", whole)
    nth = F.row_number().over(Window.partitionBy("_h").orderBy("_w"))
    tied = tied.withColumn("_in", nth <= F.lit(n - below)).drop("_w")
    rest = hashed.where(F.col("_h") != F.lit(thr)).withColumn("_in", F.col("_h") < F.lit(thr))
    return rest.unionByName(tied).drop("_h")


def sample_exact(df: DataFrame, key_cols: str | list[str], n: int, *, seed: int) -> DataFrame:
    """O2: exactly min(n, rows) rows, without replacement, seeded by the key columns."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    return _first_n(df, keys, n, seed).where("_in").drop("_in")


def subsample_at_most(df: DataFrame, key_cols: str | list[str], n: int, *, seed: int) -> DataFrame:
    """O3: the table itself when it has no more than ``n`` rows, else an exact sample."""
    return df if df.count() <= n else sample_exact(df, key_cols, n, seed=seed)


def _largest_remainder(total: int, sizes: dict) -> dict:
    """Allocate ``total`` over classes proportionally (floor + largest remainders)."""
    n = sum(sizes.values())
    raw = {c: total * s / n for c, s in sizes.items()}
    alloc = {c: int(math.floor(v)) for c, v in raw.items()}
    rest = total - sum(alloc.values())
    order = sorted(sizes, key=lambda c: (-(raw[c] - alloc[c]), str(c)))
    for c in order[:rest]:
        alloc[c] += 1
    return alloc


def stratified_split(df: DataFrame, key_col: str, strat_col: str, *, test_size: float, seed: int) -> DataFrame:
    """Random split keeping class shares; falls back to a plain split
    when a class has fewer than two rows (as the source does on error).

    The driver holds one count per class; a class column has few values."""
    sizes = {r[strat_col]: int(r["count"]) for r in df.groupBy(strat_col).count().collect()}
    n = sum(sizes.values())
    k = n_test(test_size, n)
    if min(sizes.values(), default=0) < 2:
        return random_split(df, key_col, test_size=test_size, seed=seed)
    alloc = _largest_remainder(k, sizes)
    hashed = df.select(F.col(strat_col).alias("_c"), h52(seed, F.col(key_col)).alias("_h")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        thresholds = kth_smallest_by(hashed, "_h", "_c", alloc)
    finally:
        hashed.unpersist()
    schema = T.StructType([T.StructField("_c", df.schema[strat_col].dataType), T.StructField("_t", T.LongType())])
    limits = F.broadcast(df.sparkSession.createDataFrame(list(thresholds.items()), schema))  # a row per class
    joined = df.join(limits, F.col(strat_col).eqNullSafe(F.col("_c")), "left")
    return joined.withColumn("split", F.when(h52(seed, F.col(key_col)) <= F.col("_t"), "test").otherwise("train")).drop("_c", "_t")


def random_split(df: DataFrame, key_col: str, *, test_size: float, seed: int) -> DataFrame:
    """O4 without strata: test = the ceil(test_size * n) smallest hashes."""
    n = df.count()
    thr = first_n_threshold(df.select(key_col), F.col(key_col), seed, n_test(test_size, n))
    return df.withColumn("split", F.when(h52(seed, F.col(key_col)) <= F.lit(thr), F.lit("test")).otherwise(F.lit("train")))


def split_dataset(df: DataFrame, roles, *, test_size: float, seed: int, stratify_col: str | None = None) -> DataFrame:
    """Group split when the roles name a group column, else random/stratified."""
    if roles.group_col:
        return group_split(df, roles.group_col, test_size=test_size, seed=seed)
    key = roles.id_cols[0]
    if stratify_col:
        return stratified_split(df, key, stratify_col, test_size=test_size, seed=seed)
    return random_split(df, key, test_size=test_size, seed=seed)
