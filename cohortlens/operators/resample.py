"""Bootstrap intervals and paired permutation tests.

Sign flips are cut from ``md5("seed:block:key")``, 128 bits per hash, computed
by Spark beside the row; numpy unpacks them inside the task.

Bootstrap replicates draw exactly n rows with replacement, as a hierarchical
multinomial split.  Rows lie in *cells* of about ``ROWS_PER_CELL`` rows: buckets
of the key's hash for a mean, ranges of the score for an AUC.  The n draws of a
replicate are divided down a binary tree over the cells; a node's draws go left
by a binomial with the share of its rows that lie left, seeded by (seed, level,
node), so both sides work out the same split without meeting.  Inside a cell
draw j of a replicate takes the row at floor(u n), u being 32 bits of a 64-bit
mix of (seed, cell, replicate, j), rows in the order of their keys (of score and
key for an AUC).

Draws depend on the rows' keys and numbers only: not on partitions or tasks, a
retried task draws the same, and SQL recomputes them.  Tasks return one partial
sum per (group, cell, replicate); only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.exprs import cohens_label
from cohortlens.functions.hashing import uniform

SIGNS_PER_HASH = 128
#: |replicate| counts as large as |observed| within this share (sums of equal terms differ by rounding only)
TIE_SHARE = 1e-9
ROW_CHUNK = 256
ROWS_PER_CELL = 50_000
#: score ranges of an AUC at most: the driver holds their borders, and one task the sketch they come from
MOST_RANGES = 4096
DRAWS_AT_ONCE = 2_000_000
GROUPS_PER_FLUSH = 512
# The increment and the two multipliers of the public splitmix64 generator.
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def digests(key: str, seed: int, blocks: int) -> Column:
    """16 * blocks bytes: md5("seed:block:key") of blocks 0, 1, ..."""
    each = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.md5(F.concat(F.lit(f"{seed}:"), b.cast("string"), F.lit(":"), F.col(key))))
    return F.unhex(F.array_join(each, ""))


def sign_matrix(hashes, n: int) -> np.ndarray:
    """rows x n of +1 / -1: the bits of the digests, highest first."""
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(len(hashes), -1)
    return np.unpackbits(raw, axis=1)[:, :n].astype(np.float64) * 2 - 1


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
    return z ^ (z >> np.uint64(31))


def stream_start(seed: int, cell: int) -> int:
    """Where the draws of a cell begin."""
    return int(_mix(np.array([(((seed & 0xFFFFFFFF) << 32) + cell + GOLDEN) % 2**64], np.uint64))[0])


def draws_per_replicate(path: list, n: int, n_boot: int, seed: int) -> np.ndarray:
    """Draws that reach a cell, per replicate.  ``path``: (level, node, rows, rows to the left, whether the cell lies
    left) of the tree's nodes from the root; ``n``: rows of the group."""
    draws = np.full(n_boot, n, np.int64)
    for level, node, rows, left, goes_left in path:
        to_left = np.random.default_rng([seed, level, node]).binomial(draws, left / rows)
        draws = to_left if goes_left else draws - to_left
    return draws


def picked_rows(draws: np.ndarray, rows: int, seed: int, cell: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first replicate, replicate of each draw from it, row of each draw) for blocks of replicates."""
    start, step = np.uint64(stream_start(seed, cell)), np.uint64(GOLDEN)
    size = max(1, DRAWS_AT_ONCE // max(1, int(draws.max(initial=0))))
    for a in range(0, len(draws), size):
        d = draws[a:a + size]
        rep = np.repeat(np.arange(len(d)), d)
        j = np.arange(len(rep)) - np.repeat(np.cumsum(d) - d, d)
        z = _mix(start + (((rep + a).astype(np.uint64) << np.uint64(40)) + j.astype(np.uint64)) * step)
        yield a, rep, (((z >> np.uint64(32)) * np.uint64(rows)) >> np.uint64(32)).astype(np.int64)


def _cell_paths(rows: DataFrame, g: list[str], cells: int) -> DataFrame:
    """Per (groups, cell): ``_total`` rows of the group and ``_path``, the nodes from the root to the cell."""
    depth = max(0, cells - 1).bit_length()
    own = rows.select(*[F.col(c).alias(c) for c in [*g, "_c"]])  # new columns: the rows meet their paths in a cogroup
    sizes = own.groupBy(*g, "_c").agg(F.count(F.lit(1)).alias("_rows"))
    level = sizes.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    level = level.withColumn("_node", F.expr(f"shiftright(_c, {depth} - _l)")).withColumn("_left", F.expr(f"shiftright(_c, {depth} - 1 - _l) % 2 = 0"))
    node = Window.partitionBy(*g, "_l", "_node")  # a node's cells: numbers, not rows
    level = level.select(*g, "_c", "_l", "_node", F.sum("_rows").over(node).alias("_of"),
                         F.sum(F.when(F.col("_left"), F.col("_rows")).otherwise(0)).over(node).alias("_to"), "_left")
    step = F.when(F.col("_l") < depth, F.struct("_l", "_node", "_of", "_to", "_left"))  # below the last split there is none
    return level.groupBy(*g, "_c").agg(F.max(F.when(F.col("_l") == 0, F.col("_of"))).alias("_total"), F.sort_array(F.collect_list(step)).alias("_path"))


def _resampled(rows: DataFrame, g: list[str], cells: int, n_boot: int, seed: int, names: list[str],
               kernel: Callable[[pd.DataFrame, np.ndarray, int], list[np.ndarray]]) -> DataFrame:
    """(groups, _c, rep, names...): what ``kernel`` makes of a cell's rows, its draws per replicate and its number."""
    kinds = "".join(f"{c} {t}, " for c, t in rows.select(*g, "_c").dtypes)

    def run(key, cell: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        steps = [(int(s["_l"]), int(s["_node"]), int(s["_of"]), int(s["_to"]), bool(s["_left"])) for s in path["_path"].iloc[0]]
        draws = draws_per_replicate(steps, int(path["_total"].iloc[0]), n_boot, seed)
        parts = kernel(cell, draws, int(key[-1]))
        return pd.DataFrame({**{c: [v] * n_boot for c, v in zip([*g, "_c"], key)}, "rep": np.arange(n_boot, dtype=np.int32), **dict(zip(names, parts))})

    doubles = ", ".join(f"{x} double" for x in names)
    met = rows.groupBy(*g, "_c").cogroup(_cell_paths(rows, g, cells).groupBy(*g, "_c"))
    return met.applyInPandas(run, f"{kinds}rep int, {doubles}")


def _folded(df: DataFrame, g: list[str], n: int, names: list[str], kernel: Callable[[pd.DataFrame], list[np.ndarray]]) -> DataFrame:
    """(groups, rep, names...): sums over all rows of what ``kernel`` gives per chunk of rows."""
    kinds = "".join(f"{c} {t}, " for c, t in df.select(*g).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[np.ndarray]] = {}

        def out():
            for key, parts in sums.items():
                yield pd.DataFrame({**{c: [v] * n for c, v in zip(g, key)}, "rep": np.arange(n, dtype=np.int32), **dict(zip(names, parts))})

        for batch in batches:
            for key, rows in batch.groupby(g, dropna=False, sort=False) if g else [((), batch)]:
                key = tuple(None if pd.isna(k) else k for k in key)
                parts = sums.setdefault(key, [np.zeros(n) for _ in names])
                for a in range(0, len(rows), ROW_CHUNK):
                    for total, part in zip(parts, kernel(rows.iloc[a : a + ROW_CHUNK])):
                        total += part
            if len(sums) > GROUPS_PER_FLUSH:
                yield from out()
                sums.clear()
        yield from out()

    doubles = ", ".join(f"{x} double" for x in names)
    return df.mapInPandas(run, f"{kinds}rep int, {doubles}").groupBy(*g, "rep").agg(*[F.sum(x).alias(x) for x in names])


def _interval(per_rep: DataFrame, g: list[str], col: str, alpha: float) -> DataFrame:
    return per_rep.where(F.col(col).isNotNull()).groupBy(*g).agg(
        F.avg(col).alias("mean"),
        F.percentile(col, alpha / 2).alias("ci_low"),
        F.percentile(col, 1 - alpha / 2).alias("ci_high"),
        F.count(F.lit(1)).cast("int").alias("n_bootstrap"),
    )


def _group_join(a: DataFrame, b: DataFrame, g: list[str]) -> DataFrame:
    if not g:
        return a.select("*", *[b.select(c).scalar().alias(c) for c in b.columns])
    other = b.select(*[F.col(c).alias(f"__{c}") for c in g], *[c for c in b.columns if c not in g])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in g]
    return a.join(other, same, "inner").drop(*[f"__{c}" for c in g])


def bootstrap_mean_ci(df: DataFrame, value_col: str, key_col: str, *, group_cols: tuple[str, ...] = (),
                      n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile bootstrap interval of a mean, per group.

    ``key_col`` must identify a row within its group.  A group of fewer than 50
    rows takes 500 replicates at most.  Returns (groups, mean, ci_low, ci_high,
    n_samples, n_bootstrap); quantiles interpolate linearly.
    """
    g = list(group_cols)
    base = df.select(*g, F.col(key_col).cast("string").alias("_k"), F.col(value_col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    sizes = base.groupBy(*g).agg(F.count(F.lit(1)).alias("n_samples"))
    largest = sizes.agg(F.max("n_samples")).first()[0] or 0
    cells = max(1, -(-largest // ROWS_PER_CELL))
    rows = base.withColumn("_c", F.floor(uniform("cell", F.col("_k")) * cells))

    def kernel(cell: pd.DataFrame, draws: np.ndarray, number: int):
        x = cell.sort_values("_k")["_x"].to_numpy()
        sums = np.zeros(n_boot)
        for a, rep, at in picked_rows(draws, len(x), seed, number):
            some = np.bincount(rep, weights=x[at])
            sums[a:a + len(some)] = some
        return [draws.astype(float), sums]

    per_cell = _resampled(rows, g, cells, n_boot, seed, ["_w", "_wx"], kernel)
    per_rep = per_cell.groupBy(*g, "rep").agg(F.sum("_w").alias("_w"), (F.sum("_wx") / F.sum("_w")).alias("_m"))
    per_rep = per_rep.where(F.col("rep") < F.when(F.col("_w") < 50, min(n_boot, 500)).otherwise(n_boot))
    return _group_join(_interval(per_rep, g, "_m", alpha), sizes, g).select(*g, "mean", "ci_low", "ci_high", "n_samples", "n_bootstrap")


def bootstrap_auc_ci(scored: DataFrame, score_col: str, label_col: str, key_col: str, *, group_cols: tuple[str, ...] = (),
                     n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Bootstrap interval of ROC AUC (ties count 1/2), per group.

    Scores are cut into ranges of about ``ROWS_PER_CELL`` rows; a score that
    fills a range by itself gets one of its own, which is dealt over cells by
    the key's hash.  Every cell gives (positive, negative, U) weights per
    replicate, and a running sum over ranges adds the pairs between them.
    Replicates with a single class are skipped.
    """
    g = list(group_cols)
    base = scored.select(*g, F.col(key_col).cast("string").alias("_k"), F.col(score_col).cast("double").alias("_s"),
                         (F.col(label_col) == 1).cast("int").alias("_y")).where(F.col("_s").isNotNull() & F.col("_y").isNotNull())
    n = base.count()
    parts = min(MOST_RANGES, -(-n // ROWS_PER_CELL))
    cuts = base.agg(F.percentile_approx("_s", [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("q")).first()["q"] or [] if parts > 1 else []
    hot = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    edges = sorted({*cuts, *(float(np.nextafter(v, np.inf)) for v in hot)})
    spread = 1
    if edges:
        splits = [float("-inf"), *edges, float("inf")]
        base = Bucketizer(splits=splits, inputCol="_s", outputCol="_b").transform(base).withColumn("_b", F.col("_b").cast("long"))
        alone = F.col("_b").isin([splits.index(v) for v in hot])
        if hot:
            fullest = base.where(alone).groupBy(*g, "_b").count().agg(F.max("count")).first()[0] or 1
            spread = -(-fullest // ROWS_PER_CELL)
        part = F.when(alone, F.floor(uniform("cell", F.col("_k")) * spread)).otherwise(0)
        rows = base.withColumn("_c", F.col("_b") * spread + part)
    else:
        rows = base.withColumn("_c", F.lit(0).cast("long"))

    def kernel(cell: pd.DataFrame, draws: np.ndarray, number: int):
        cell = cell.sort_values(["_s", "_k"])
        score, y = cell["_s"].to_numpy(), cell["_y"].to_numpy() == 1
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        pos, neg, u = np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot)
        for a, rep, at in picked_rows(draws, len(cell), seed, number):
            k = min(n_boot - a, int(rep[-1]) + 1 if len(rep) else 0)
            w = np.bincount(rep * len(cell) + at, minlength=k * len(cell)).reshape(k, len(cell)).astype(float)
            p, q = np.add.reduceat(w * y, starts, axis=1), np.add.reduceat(w * ~y, starts, axis=1)
            pos[a:a + k], neg[a:a + k] = p.sum(axis=1), q.sum(axis=1)
            u[a:a + k] = (p * (np.cumsum(q, axis=1) - q / 2)).sum(axis=1)
        return [pos, neg, u]

    cells = _resampled(rows, g, (len(edges) + 1) * spread, n_boot, seed, ["_p", "_n", "_u"], kernel)
    # cells of one score: their pairs are ties, counted here for all of them together
    ranges = cells.withColumn("_b", F.floor(F.col("_c") / spread)).groupBy(*g, "_b", "rep").agg(
        F.sum("_p").alias("_p"), F.sum("_n").alias("_n"),
        F.when(F.count(F.lit(1)) > 1, F.sum("_p") * F.sum("_n") / 2).otherwise(F.sum("_u")).alias("_u"))
    before = Window.partitionBy(*g, "rep").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = ranges.withColumn("_u", F.col("_u") + F.col("_p") * F.coalesce(F.sum("_n").over(before), F.lit(0.0)))
    per_rep = total.groupBy(*g, "rep").agg((F.sum("_u") / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0.0))).alias("_a"))
    return _interval(per_rep, g, "_a", alpha)


def paired_permutation_test(pairs: DataFrame, a_col: str, b_col: str, key_col: str, *, group_cols: tuple[str, ...] = (),
                            n_perm: int = 10000, seed: int = 0) -> DataFrame:
    """E15 + E16 + E17: sign-flip test of mean(a - b) per group.

    p = share of replicates with |sum(sign * d)| >= |sum(d)| (two-sided, can
    be 0; equal up to ``TIE_SHARE`` counts); Cohen's d of the paired
    differences (0 when their sd is 0).
    """
    g = list(group_cols)
    d = pairs.select(*g, F.col(key_col).cast("string").alias("_k"), (F.col(a_col) - F.col(b_col)).cast("double").alias("_d")).where(F.col("_d").isNotNull())
    sd = F.stddev_samp("_d")
    obs = d.groupBy(*g).agg(
        F.sum("_d").alias("_sum"), F.avg("_d").alias("mean_diff"), F.count(F.lit(1)).alias("n"),
        F.when(sd == 0, F.lit(0.0)).otherwise(F.avg("_d") / sd).alias("cohens_d"),
    )
    hashed = d.select(*g, "_d", digests("_k", seed, -(-n_perm // SIGNS_PER_HASH)).alias("_h"))
    flips = _folded(hashed, g, n_perm, ["_s"], lambda rows: [rows["_d"].to_numpy() @ sign_matrix(rows["_h"].tolist(), n_perm)])
    large = F.abs("_s") >= F.abs("_sum") * F.lit(1 - TIE_SHARE)
    p = _group_join(flips, obs.select(*g, "_sum"), g).groupBy(*g).agg(F.avg(large.cast("double")).alias("p_value"))
    return _group_join(obs, p, g).select(*g, "p_value", "mean_diff", "cohens_d", cohens_label(F.col("cohens_d")).alias("effect_interpretation"),
                                         "n", F.lit(n_perm).alias("n_permutations"))


def bonferroni(tests: DataFrame, alpha: float = 0.05, n_tests: int | None = None) -> DataFrame:
    """Corrected alpha = alpha / number of tests (of the table, or of the whole family), and a flag."""
    n = F.lit(n_tests).cast("bigint") if n_tests else tests.agg(F.count(F.lit(1))).scalar()
    a = F.lit(alpha) / n
    return tests.select("*", n.alias("n_tests"), a.alias("alpha_corrected"), (F.col("p_value") < a).alias("significant"))
