"""Result roll-ups and chart tables.

Input is the long metrics table ``(dataset, synthesizer, seed, metric,
value)``; loops over seeds, datasets and synthesizers of the source
become group keys, so every roll-up is a single aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import first_metric, safe_div
from cohortlens.operators.dist import exact_quantiles

# The per-seed metrics rolled up by the multi-seed summary.
SUMMARY_METRICS = [
    "tstr_cls_rf_auc", "tstr_cls_lr_auc", "tstr_cls_mean_auc", "tstr_cls_rf_auc_ci_low",
    "tstr_cls_rf_auc_ci_high", "tstr_reg_rf_mae", "tstr_reg_ridge_mae", "tstr_reg_mean_mae",
    "trtr_cls_rf_auc", "trtr_cls_lr_auc", "trtr_reg_rf_mae", "trtr_reg_ridge_mae",
    "c2st_effective_auc", "mia_worst_case_effective_auc", "timing_total_seconds",
    "shap_spearman_rho_cls", "shap_spearman_rho_reg", "shap_p_value_cls", "shap_p_value_reg",
]


def _valid(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("value").isNotNull() & ~F.isnan("value"))


def seed_rollup(metrics: DataFrame) -> DataFrame:
    """Mean, sample std (0 for a single seed), observed count."""
    return _valid(metrics).groupBy("dataset", "synthesizer", "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("n_observed"),
    )


def seeds_observed(metrics: DataFrame, seeds_requested: int) -> DataFrame:
    """Seeds requested vs observed per dataset."""
    return metrics.groupBy("dataset").agg(F.count_distinct("seed").alias("seeds_observed")).withColumn(
        "seeds_requested", F.lit(seeds_requested))


def missing_metrics(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (dataset, synthesizer, seed, metric) cells with
    no valid value (expected grid anti-joined with the observations)."""
    keys = ["dataset", "synthesizer", "seed", "metric"]
    return expected.select(*keys).join(_valid(metrics).select(*keys), keys, "left_anti")


def chart_rollup(metrics: DataFrame) -> DataFrame:
    """Mean and population std over seeds (what the charts draw)."""
    return _valid(metrics).groupBy("dataset", "synthesizer", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"))


def timing_summary(oplog: DataFrame) -> DataFrame:
    """Count, mean, median, min, max, total seconds and minutes per operation.

    The median comes from prefix sums, so an operation with most of the log
    is spread over tasks; the other columns combine before the shuffle."""
    s = F.col("seconds")
    base = oplog.groupBy("operation").agg(
        F.count(F.lit(1)).alias("count"), F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"),
        F.sum(s).alias("total"), (F.sum(s) / F.lit(60.0)).alias("total_minutes"))
    median = exact_quantiles(oplog, "seconds", [0.5], group_cols=("operation",)).withColumnRenamed("q0", "median")
    return base.join(median, "operation", "left").select("operation", "count", "mean", "median", "min", "max", "total", "total_minutes")


def privacy_score(eff_auc):
    """200 * (1 - effective AUC), 100 at chance, 0 at certainty."""
    return F.lit(200.0) * (F.lit(1.0) - eff_auc)


def utility_ratio(real_val, syn_val, lower_better: bool):
    """100 * min(1, ratio) of synthetic to real performance (NULL on a zero divisor)."""
    r = safe_div(real_val, syn_val) if lower_better else safe_div(syn_val, real_val)
    return F.lit(100.0) * F.least(F.lit(1.0), r)


def clamped_chance_score(eff_auc):
    """Effective AUC to 0..100, never below 0 (ideal 0.5 gives 100)."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - (eff_auc - F.lit(0.5)) / F.lit(0.5)) * F.lit(100.0)


def clamped_utility_score(syn_val, real_val, lower_better: bool = False):
    """Share of the real baseline, 100 at most; 100 when the divisor is not positive."""
    num, den = (real_val, syn_val) if lower_better else (syn_val, real_val)
    return F.when(den > 0, F.least(F.lit(100.0), safe_div(num, den) * F.lit(100.0))).otherwise(F.lit(100.0))


def wide_means(metrics: DataFrame, names: list[str], keys: tuple[str, ...] = ("dataset", "synthesizer")) -> DataFrame:
    """Seed means with one column per metric (pivot on a known list)."""
    return _valid(metrics).groupBy(*keys).pivot("metric", names).agg(F.avg("value"))


#: metrics of the performance matrices and comparison tables
SCORE_METRICS = [
    "sdmetrics_overall_score", "c2st_effective_auc", "mia_worst_case_effective_auc", "tstr_cls_rf_auc", "trtr_cls_rf_auc",
    "tstr_reg_rf_mae", "trtr_reg_rf_mae", "tstr_reg_ridge_mae", "trtr_reg_ridge_mae",
]


def score_matrices(metrics: DataFrame) -> DataFrame:
    """E23, both variants: scores per synthesizer from seed means.

    ``*_score`` is the run report (E21: unclamped, raw AUC, ridge MAE);
    ``*_clamped`` the chart form (E22: clamped, relative to the real baseline, forest MAE)."""
    w = wide_means(metrics, SCORE_METRICS)
    c = {m: F.col(m) for m in SCORE_METRICS}
    return w.select(
        "dataset", "synthesizer", (c["sdmetrics_overall_score"] * 100).alias("quality"),
        privacy_score(c["c2st_effective_auc"]).alias("realism_score"),
        privacy_score(c["mia_worst_case_effective_auc"]).alias("privacy_score"),
        (c["tstr_cls_rf_auc"] * 100).alias("cls_score"),
        utility_ratio(c["trtr_reg_ridge_mae"], c["tstr_reg_ridge_mae"], True).alias("reg_score"),
        clamped_chance_score(c["c2st_effective_auc"]).alias("realism_clamped"),
        clamped_chance_score(c["mia_worst_case_effective_auc"]).alias("privacy_clamped"),
        clamped_utility_score(c["tstr_cls_rf_auc"], c["trtr_cls_rf_auc"]).alias("cls_clamped"),
        clamped_utility_score(c["tstr_reg_rf_mae"], c["trtr_reg_rf_mae"], True).alias("reg_clamped"),
    )


def model_comparison(records: DataFrame) -> DataFrame:
    """Quality, realism and privacy x 100 per synthesizer.

    ``records``: dataset, synthesizer and the raw metric texts; the first key
    that holds a number wins (P19), and nothing found counts as 0."""
    def pick(*names):
        have = [F.col(n) for n in names if n in records.columns]
        return F.coalesce(first_metric(*have), F.lit(0.0)) * F.lit(100.0) if have else F.lit(0.0)

    return records.select(
        "dataset", "synthesizer", pick("overall_score").alias("quality"),
        pick("effective_auc_mean", "effective_auc", "auc_mean", "auc").alias("realism"),
        pick("worst_case_effective_auc", "mia_effective_auc").alias("privacy"),
    )


def attacker_table(runs: DataFrame) -> DataFrame:
    """Mean and population std of each attacker's effective AUC over seeds.

    ``runs``: dataset, synthesizer, seed, attackers (map name -> effective AUC)."""
    return runs.select("dataset", "synthesizer", "seed", F.explode("attackers").alias("attacker", "value")).groupBy(
        "dataset", "synthesizer", "attacker").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"))


def utility_table(metrics: DataFrame, real_metric: str, synthetic_metric: str) -> DataFrame:
    """The real baseline (all synthesizers' runs pooled) against each synthesizer, with population std over seeds."""
    v = _valid(metrics)
    real = v.where(F.col("metric") == real_metric).groupBy("dataset").agg(
        F.lit("Real").alias("model"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"))
    syn = v.where(F.col("metric") == synthetic_metric).groupBy("dataset", F.col("synthesizer").alias("model")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"))
    both = real.unionByName(syn)
    return both.select("dataset", F.lit(synthetic_metric).alias("metric"), "model", "mean", "std_pop")


def performance_matrix(rollup: DataFrame, metrics: list[str]) -> DataFrame:
    """Synthesizer x metric matrix of means (pivot on a known list)."""
    return rollup.where(F.col("metric").isin(metrics)).groupBy("dataset", "synthesizer").pivot("metric", metrics).agg(F.first("mean"))


def write_summary_csv(rollup: DataFrame, path: str) -> None:
    """Summary CSV, numbers rounded to 6 decimals."""
    out = rollup.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rollup.dtypes])
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
