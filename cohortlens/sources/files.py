"""Readers for raw exports and result documents.

CSV is read with an explicit schema (never inferred); file discovery goes
through Spark's file index (recursive lookup, glob filter), so the driver
only ever sees file names and sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from cohortlens.functions.exprs import nan_to_null

# Characters that differ between ISO-8859-15 and ISO-8859-1,
# as (latin-1 reading, intended character), in code-point order.
LATIN9_FIXES = [("¤", "€"), ("¦", "Š"), ("¨", "š"), ("´", "Ž"),
                ("¸", "ž"), ("¼", "Œ"), ("½", "œ"), ("¾", "Ÿ")]

# Files and columns of the source format.
EXPORT_SCHEMAS = {
    "studentinfo": "code_module string, code_presentation string, id_student long, gender string, region string, "
                   "highest_education string, imd_band string, age_band string, num_of_prev_attempts int, "
                   "studied_credits int, disability string, final_result string",
    "studentregistration": "code_module string, code_presentation string, id_student long, date_registration int, date_unregistration int",
    "studentvle": "code_module string, code_presentation string, id_student long, id_site long, date int, sum_click int",
    "studentassessment": "id_assessment long, id_student long, date_submitted int, is_banked int, score double",
    "assessments": "code_module string, code_presentation string, id_assessment long, assessment_type string, date int, weight double",
}


#: export columns that some releases lack and no feature needs
EXPORT_OPTIONAL = ("num_of_prev_attempts", "studied_credits", "date_submitted", "is_banked", "assessment_type", "date")


def _case_glob(stem: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in stem)


def _csv_files(spark: SparkSession, raw_dir: str, pattern: str = "*.csv") -> DataFrame:
    """path and length of the CSV files under a folder, at any depth (no content is read)."""
    try:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
                .load(raw_dir).select("path", "length"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no folder {raw_dir}") from e
        raise


def find_csv(spark: SparkSession, raw_dir: str, stem: str) -> str:
    """The one CSV whose stem is ``stem`` (any case, any depth), or else the
    one whose stem holds it.  None, or several, is an error that names them."""
    for pattern in (f"{_case_glob(stem)}.csv", f"*{_case_glob(stem)}*.csv"):
        found = sorted(r["path"] for r in _csv_files(spark, raw_dir, pattern).select("path").collect())
        if len(found) > 1:
            raise ValueError(f"several files for {stem} under {raw_dir}: {found}")
        if found:
            return found[0]
    raise FileNotFoundError(f"no {stem}.csv under {raw_dir}")


def largest_csv(spark: SparkSession, raw_dir: str) -> str:
    """The largest CSV under a folder."""
    row = _csv_files(spark, raw_dir).orderBy(F.desc("length"), F.asc("path")).first()
    if row is None:
        raise FileNotFoundError(f"no CSV under {raw_dir}")
    return row["path"]


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, *, latin9: bool = False,
             optional: tuple[str, ...] = ()) -> DataFrame:
    """S3 + S7: CSV scan by header names; with a schema its columns are taken by
    name in any order and cast (a text that does not fit is an error), other
    columns are never parsed.  ISO-8859-15 is read as ISO-8859-1 and the eight
    differing characters are translated back."""
    r = spark.read.option("header", True).option("inferSchema", False).option("mode", "FAILFAST")
    if latin9:
        r = r.option("encoding", "ISO-8859-1")
    df = r.csv(path)
    if latin9:
        src = "".join(a for a, _ in LATIN9_FIXES)
        dst = "".join(b for _, b in LATIN9_FIXES)
        df = df.select(*[F.translate(F.col(f"`{c}`"), src, dst).alias(c) for c in df.columns])
    if schema is None:
        return df
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    have = {c.strip().lower(): c for c in df.columns}
    missing = [f.name for f in want if f.name not in have and f.name not in optional]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return nan_to_null(df.select(*[F.col(f"`{have[f.name]}`").cast(f.dataType).alias(f.name) for f in want if f.name in have]))


def load_export(spark: SparkSession, raw_dir: str, skip: set[str] = frozenset()) -> dict[str, DataFrame]:
    """The learning-platform export as lazy DataFrames (skipping is free)."""
    return {name: read_csv(spark, find_csv(spark, raw_dir, name), schema, optional=EXPORT_OPTIONAL)
            for name, schema in EXPORT_SCHEMAS.items() if name not in skip}


# The layout of a result document.
_CI = "struct<ci_low: double, ci_high: double>"
_CLS = ["rf_auc", "lr_auc", "mean_auc", "trtr_rf_auc", "trtr_lr_auc"]
_REG = ["rf_mae", "ridge_mae", "mean_mae", "trtr_rf_mae", "trtr_ridge_mae"]
_RHO = ("struct<trtr_importance: map<string, double>, tstr_importance: map<string, double>, "
        "rank_correlation: struct<spearman_rho: double, p_value: double, n_features: bigint>>")
_TEST = ("struct<p_value: double, mean_diff: double, cohens_d: double, effect_interpretation: string, n: bigint, n_permutations: bigint, "
         "significant_bonferroni: boolean>")
RESULT_SCHEMA = (
    "dataset string, seed bigint, synthesizers map<string, struct<"
    "sdmetrics: struct<overall_score: double>, c2st: struct<effective_auc: double>, "
    "mia: struct<worst_case_effective_auc: double, attackers: map<string, struct<auc: double, effective_auc: double>>>, "
    "utility: struct<"
    f"classification: struct<{', '.join(f'{m}: double' for m in _CLS)}, rf_auc_ci: {_CI}, lr_auc_ci: {_CI}>, "
    f"regression: struct<{', '.join(f'{m}: double' for m in _REG)}, rf_mae_ci: {_CI}, ridge_mae_ci: {_CI}>>, "
    f"shap: struct<classification: {_RHO}, regression: {_RHO}>, "
    "timing: struct<fit_seconds: double, sample_seconds: double, total_seconds: double>>>, "
    f"pairwise_tests map<string, struct<classification: {_TEST}, regression: {_TEST}>>, "
    f"tstr_vs_trtr map<string, struct<classification_rf: {_TEST}, classification_lr: {_TEST}, regression_rf: {_TEST}, regression_ridge: {_TEST}>>, "
    "multiple_testing_correction struct<method: string, original_alpha: double, adjusted_alpha: double, n_tests: bigint>"
)

# Name in the long metrics table -> path in a result document.
METRIC_PATHS = {
    "sdmetrics_overall_score": "sdmetrics.overall_score",
    "c2st_effective_auc": "c2st.effective_auc",
    "mia_worst_case_effective_auc": "mia.worst_case_effective_auc",
    "tstr_cls_rf_auc": "utility.classification.rf_auc",
    "tstr_cls_lr_auc": "utility.classification.lr_auc",
    "tstr_cls_mean_auc": "utility.classification.mean_auc",
    "tstr_cls_rf_auc_ci_low": "utility.classification.rf_auc_ci.ci_low",
    "tstr_cls_rf_auc_ci_high": "utility.classification.rf_auc_ci.ci_high",
    "tstr_reg_rf_mae": "utility.regression.rf_mae",
    "tstr_reg_ridge_mae": "utility.regression.ridge_mae",
    "tstr_reg_mean_mae": "utility.regression.mean_mae",
    "trtr_cls_rf_auc": "utility.classification.trtr_rf_auc",
    "trtr_cls_lr_auc": "utility.classification.trtr_lr_auc",
    "trtr_reg_rf_mae": "utility.regression.trtr_rf_mae",
    "trtr_reg_ridge_mae": "utility.regression.trtr_ridge_mae",
    "timing_total_seconds": "timing.total_seconds",
    "shap_spearman_rho_cls": "shap.classification.rank_correlation.spearman_rho",
    "shap_spearman_rho_reg": "shap.regression.rank_correlation.spearman_rho",
    "shap_p_value_cls": "shap.classification.rank_correlation.p_value",
    "shap_p_value_reg": "shap.regression.rank_correlation.p_value",
}


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result documents over seeds/datasets with a pruned schema (heavy
    per-sample branches are never parsed); the file path rides along."""
    return (spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(pattern)
            .select("*", F.col("_metadata.file_path").alias("source_file")))


def results_to_metrics(results: DataFrame) -> DataFrame:
    """Result documents as the long metrics table; a metric that a document lacks is NULL (P20)."""
    syn = results.select("dataset", "seed", F.explode("synthesizers").alias("synthesizer", "r"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"r.{p}").alias("value")) for m, p in METRIC_PATHS.items()])
    return syn.select("dataset", "seed", "synthesizer", F.explode(cells).alias("c")).select("dataset", "seed", "synthesizer", "c.metric", "c.value")


def attacker_table(results: DataFrame) -> DataFrame:
    """Per-attacker AUCs of every run (explode of the attackers map)."""
    syn = results.select("dataset", "seed", F.explode("synthesizers").alias("synthesizer", "r"))
    return syn.select("dataset", "seed", "synthesizer", F.explode("r.mia.attackers").alias("attacker", "a")).select(
        "dataset", "seed", "synthesizer", "attacker", F.col("a.auc").alias("auc"), F.col("a.effective_auc").alias("effective_auc"))


def importance_table(results: DataFrame) -> DataFrame:
    """(dataset, seed, task, source, feature, importance) of every run: ``trtr`` once, and each synthesizer."""
    syn = results.select("dataset", "seed", F.explode("synthesizers").alias("synthesizer", "r"))
    cells = [F.struct(F.lit(t).alias("task"), s.alias("source"), F.col(f"r.shap.{t}.{f}").alias("imp"))
             for t in ("classification", "regression") for s, f in ((F.lit("trtr"), "trtr_importance"), (F.col("synthesizer"), "tstr_importance"))]
    long = syn.select("dataset", "seed", F.explode(F.array(*cells)).alias("c")).select("dataset", "seed", "c.task", "c.source", F.explode("c.imp").alias("feature", "importance"))
    return long.dropDuplicates(["dataset", "seed", "task", "source", "feature"])


def test_table(results: DataFrame) -> DataFrame:
    """(dataset, seed, family, name, part, p_value, ...) of every test of every run."""
    def family(col, parts):
        return results.select("dataset", "seed", F.lit(col).alias("family"), F.explode(col).alias("name", "t")).select(
            "dataset", "seed", "family", "name", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"t.{p}").alias("test")) for p in parts])).alias("c")).select(
            "dataset", "seed", "family", "name", "c.part", "c.test.*")

    both = family("pairwise_tests", ["classification", "regression"]).unionByName(
        family("tstr_vs_trtr", ["classification_rf", "classification_lr", "regression_rf", "regression_ridge"]))
    return both.where(F.col("p_value").isNotNull())
