"""Registered queries: name -> (Spark builder, reference SQL or None).

Every builder takes ``(spark, data_dir)`` and returns a DataFrame computed
from the whole provided tables.  Double columns are rounded to 6 digits in
the registered form only, so two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.exprs import round_doubles, safe_corr
from cohortlens.plans import oracle_sql as S
from cohortlens.plans.interaction_table import standin_interaction_table
from cohortlens.plans.student_table import standin_student_table
from cohortlens.operators import quality as Q
from cohortlens.operators import diagnostics as D
from cohortlens.operators import report as P
from cohortlens.operators import resample as R
from cohortlens.sources.sinks import read_slice, write_consolidated
from cohortlens.streaming.clicks import run_incremental, standin_click_stream
from cohortlens.functions.hashing import uniform
from cohortlens.operators.evaluate import c2st_effective_auc, importance_preservation, mia_worst_case, shap_values, tstr_utility
from cohortlens.operators.explain import parent_names, parent_values, pooled_top, read_shap, write_shap
from cohortlens.operators.knn import knn_distances
from cohortlens.operators.models import ForestParams
from cohortlens.operators.synth import GaussianCopula
from cohortlens.plans.interaction_table import coverage_diagnostic, standin_log
from cohortlens.plans.metrics_table import STANDIN_METRICS, expected_grid, standin_metrics
from cohortlens.plans.losses import baseline_losses, paired
from cohortlens.operators.dist import auc_mann_whitney, exact_quantiles
from cohortlens.operators.effect import effect_size_summary
from cohortlens.operators.ranks import spearman_rho
from cohortlens.operators.split import group_split
from cohortlens.roles import infer_feature_spec
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, data_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return fn(spark, data_dir)

        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        REGISTRY[name] = (wrapped, sql)
        return wrapped

    return deco


# ---------------------------------------------------------------- tables
@register("student_table", S.q_student_table())
def student_table(spark, d):
    """G1 on the stand-in tables (flagship)."""
    df, _ = standin_student_table(Tables(spark, d))
    return round_doubles(df)


@register("interaction_table", S.q_interaction_table())
def interaction_table(spark, d):
    """First-20 window features + median engagement label."""
    df, _ = standin_interaction_table(Tables(spark, d))
    return round_doubles(df)


@register("group_split", S.q_group_split())
def group_split_q(spark, d):
    """30 % of students to test, whole students per side, seed 0."""
    df, roles = standin_student_table(Tables(spark, d))
    out = group_split(df, roles.group_col, test_size=0.3, seed=0)
    return round_doubles(out.select("id_student", "split", "final_grade"))


# ---------------------------------------------------------------- helpers
def split_students(spark, d, seed: int = 0):
    """Student table with a ``split`` column (group split, 30 % test).

    The feature table is materialised once into the shared checkpoint
    folder: every later pass (split threshold, metrics, models) reads it
    instead of re-running the star join, and lineage is cut for retries."""
    df, roles = _students(spark, d)
    return group_split(df, roles.group_col, test_size=0.3, seed=seed), roles


def _students(spark, d):
    df, roles = standin_student_table(Tables(spark, d))
    return df.checkpoint(eager=True), roles


def _real_syn(spark, d):
    """Real/synthetic stand-in pair: train part vs test part of the split."""
    sts, roles = split_students(spark, d)
    spec = infer_feature_spec(sts, exclude=list(roles.id_cols) + ["split"])
    real = sts.where(F.col("split") == "train").drop("split")
    syn = sts.where(F.col("split") == "test").drop("split")
    return real, syn, spec, roles


# ---------------------------------------------------------------- quality
@register("ks_complement", S.q_ks_complement())
def ks_complement_q(spark, d):
    """E2 per numeric column, train vs test."""
    real, syn, spec, _ = _real_syn(spark, d)
    return round_doubles(Q.ks_complement(real, syn, spec.numeric_cols))


@register("tv_complement", S.q_tv_complement())
def tv_complement_q(spark, d):
    """E3 per categorical column."""
    real, syn, spec, _ = _real_syn(spark, d)
    return round_doubles(Q.tv_complement(real, syn, spec.categorical_cols))


@register("correlation_similarity", S.q_correlation_similarity())
def correlation_similarity_q(spark, d):
    """E4 per numeric pair."""
    real, syn, spec, _ = _real_syn(spark, d)
    return round_doubles(Q.correlation_similarity(real, syn, spec.numeric_cols))


@register("contingency_similarity", S.q_contingency_similarity())
def contingency_similarity_q(spark, d):
    """E5 per pair involving a category (numbers in 10 real-range bins)."""
    real, syn, spec, _ = _real_syn(spark, d)
    return round_doubles(Q.contingency_similarity(real, syn, spec))


@register("quality_report", S.q_quality_report())
def quality_report_q(spark, d):
    """Overall score = mean(column shapes, column pair trends)."""
    real, syn, spec, _ = _real_syn(spark, d)
    return round_doubles(Q.quality_report(real, syn, spec))


# ---------------------------------------------------------------- effects, ranks
@register("effect_size_summary", S.q_effect_size_summary())
def effect_size_summary_q(spark, d):
    """Cohen's d, Hedges' g, Glass's delta, Cliff's delta per column."""
    real, syn, spec, _ = _real_syn(spark, d)
    return round_doubles(effect_size_summary(real, syn, spec.numeric_cols))


@register("feature_auc", S.q_feature_auc())
def feature_auc_q(spark, d):
    """ROC AUC of each numeric feature as a dropout score (Mann-Whitney)."""
    st, roles = standin_student_table(Tables(spark, d))
    feats = [c for c in infer_feature_spec(st, exclude=list(roles.id_cols) + list(roles.target_cols)).numeric_cols]
    lng = st.select("dropout", *[F.col(c).cast("double").alias(c) for c in feats]).unpivot(["dropout"], feats, "feature", "value")
    return round_doubles(auc_mann_whitney(lng, "value", "dropout", group_cols=("feature",)))


@register("spearman_importance", S.q_spearman_importance())
def spearman_importance_q(spark, d):
    """Spearman rho between two importance maps (|corr| with the
    grade on train and on test)."""
    sts, roles = split_students(spark, d)
    feats = [c for c in infer_feature_spec(sts, exclude=list(roles.id_cols) + list(roles.target_cols) + ["split"]).numeric_cols]
    imp = sts.groupBy("split").agg(*[F.abs(safe_corr(F.col(c), F.col("final_grade"))).alias(c) for c in feats]).unpivot(["split"], feats, "feature", "importance")
    a = imp.where(F.col("split") == "train").select("feature", F.col("importance").alias("a"))
    b = imp.where(F.col("split") == "test").select("feature", F.col("importance").alias("b"))
    return round_doubles(spearman_rho(a, b, "feature", "a", "b").select("spearman_rho", "n_features"))


# ---------------------------------------------------------------- losses, resampling
def _losses(spark, d):
    """Read several times by every test, so it is written once to the shared checkpoint folder."""
    sts, _ = split_students(spark, d)
    return baseline_losses(sts, key="id_student", group_col="nation", reg_target="final_grade", cls_target="dropout").checkpoint(eager=True)


@register("baseline_losses", S.q_baseline_losses())
def baseline_losses_q(spark, d):
    """F6 loss table: per test row, two baseline predictors, two tasks."""
    return round_doubles(_losses(spark, d))


@register("paired_permutation", S.q_paired_permutation())
def paired_permutation_q(spark, d):
    """10 000 sign flips per task, global vs per-group predictor."""
    pr = paired(_losses(spark, d), "global", "group")
    return round_doubles(R.paired_permutation_test(pr, "loss_a", "loss_b", "row_id", group_cols=("task",), n_perm=10000, seed=0))


@register("bonferroni_tests", S.q_bonferroni_tests())
def bonferroni_tests_q(spark, d):
    """The permutation tests with alpha / n_tests."""
    pr = paired(_losses(spark, d), "global", "group")
    t = R.paired_permutation_test(pr, "loss_a", "loss_b", "row_id", group_cols=("task",), n_perm=10000, seed=0)
    return round_doubles(R.bonferroni(t, 0.05))


@register("bootstrap_loss_ci", S.q_bootstrap_loss_ci())
def bootstrap_loss_ci_q(spark, d):
    """1000-replicate bootstrap interval of the mean loss per task and model."""
    return round_doubles(R.bootstrap_mean_ci(_losses(spark, d), "loss", "row_id", group_cols=("task", "model"), n_boot=1000, seed=0))


@register("bootstrap_auc_ci", S.q_bootstrap_auc_ci())
def bootstrap_auc_ci_q(spark, d):
    """1000-replicate bootstrap interval of ROC AUC per classifier."""
    cls = _losses(spark, d).where(F.col("task") == "classification")
    return round_doubles(R.bootstrap_auc_ci(cls, "score", "label", "row_id", group_cols=("model",), n_boot=1000, seed=0))


@register("bootstrap_feature_auc_ci", S.q_bootstrap_feature_auc_ci())
def bootstrap_feature_auc_ci_q(spark, d):
    """E12 on a continuous score and on one with two values."""
    st, _ = standin_student_table(Tables(spark, d))
    sc = st.select("id_student", "dropout", "acctbal", "is_unregistered").unpivot(["id_student", "dropout"], ["acctbal", "is_unregistered"], "feature", "score")
    return round_doubles(R.bootstrap_auc_ci(sc, "score", "dropout", "id_student", group_cols=("feature",), n_boot=200, seed=1))


@register("exact_quantiles", S.q_exact_quantiles())
def exact_quantiles_q(spark, d):
    """Five exact quantiles of every numeric student column."""
    st, _ = standin_student_table(Tables(spark, d))
    cols = infer_feature_spec(st, exclude=["id_student"]).numeric_cols
    long = st.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column_name", "value")
    return round_doubles(exact_quantiles(long, "value", [0.0, 0.005, 0.5, 0.9, 1.0], group_cols=("column_name",)))


# ---------------------------------------------------------------- diagnostics
@register("leakage_screen", S.q_leakage_screen())
def leakage_screen_q(spark, d):
    """Max |corr| of any numeric column with each target, and flags."""
    st, roles = standin_student_table(Tables(spark, d))
    num = infer_feature_spec(st, exclude=list(roles.id_cols)).numeric_cols
    return round_doubles(D.leakage_screen(st, num, roles.target_cols))


@register("class_balance", S.q_class_balance())
def class_balance_q(spark, d):
    """A10: dropout class counts and balance ratio."""
    st, _ = standin_student_table(Tables(spark, d))
    return round_doubles(D.class_balance(st, "dropout"))


@register("target_describe", S.q_target_describe())
def target_describe_q(spark, d):
    """Final grade min/max/mean/std."""
    st, _ = standin_student_table(Tables(spark, d))
    return round_doubles(D.target_describe(st, "final_grade"))


@register("split_sizes", S.q_split_sizes())
def split_sizes_q(spark, d):
    """Rows per split side."""
    sts, _ = split_students(spark, d)
    return D.split_sizes(sts)


@register("coverage_diagnostic", S.q_coverage_diagnostic())
def coverage_diagnostic_q(spark, d):
    """Users with a full early window, label share, threshold."""
    return round_doubles(coverage_diagnostic(standin_log(Tables(spark, d))))


# ---------------------------------------------------------------- roll-ups
def _metrics(spark, d):
    return standin_metrics(Tables(spark, d))


@register("seed_rollup", S.q_seed_rollup())
def seed_rollup_q(spark, d):
    """Mean, sample std, observed count over seeds."""
    return round_doubles(P.seed_rollup(_metrics(spark, d)))


@register("chart_rollup", S.q_chart_rollup())
def chart_rollup_q(spark, d):
    """Mean and population std over seeds."""
    return round_doubles(P.chart_rollup(_metrics(spark, d)))


@register("seeds_observed", S.q_seeds_observed())
def seeds_observed_q(spark, d):
    """Seeds requested vs observed."""
    return P.seeds_observed(_metrics(spark, d), 7)


@register("missing_metrics", S.q_missing_metrics())
def missing_metrics_q(spark, d):
    """Expected metric cells that hold no valid value."""
    m = _metrics(spark, d)
    return P.missing_metrics(m, expected_grid(m, 7, STANDIN_METRICS))


@register("timing_summary", S.q_timing_summary())
def timing_summary_q(spark, d):
    """Per-operation timing summary over an operation log."""
    oplog = Tables(spark, d).events.select(F.col("event_type").alias("operation"), F.col("value").alias("seconds"))
    return round_doubles(P.timing_summary(oplog))


@register("performance_matrix", S.q_performance_matrix())
def performance_matrix_q(spark, d):
    """Synthesizer x metric matrix of seed means."""
    roll = P.seed_rollup(_metrics(spark, d))
    return round_doubles(P.performance_matrix(roll, STANDIN_METRICS))


# ---------------------------------------------------------------- neighbours, models
def embedding_roles(t):
    """embeddings split by hash bands into members / non-members / synthetic."""
    u = uniform(0, F.col("vec_id"))
    role = F.when(u < 1.0 / 3, "member").when(u < 2.0 / 3, "nonmember").otherwise("synthetic")
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("features_arr"), role.alias("role"))


@register("knn_distances", S.q_knn_distances())
def knn_distances_q(spark, d):
    """Distance to the nearest and mean of the 5 nearest synthetic rows."""
    e = embedding_roles(Tables(spark, d))
    q = e.where(F.col("role") != "synthetic")
    r = e.where(F.col("role") == "synthetic")
    dist = knn_distances(q, r, key="vec_id", k=5)
    return round_doubles(dist.join(q.select("vec_id", "role"), "vec_id").select("vec_id", "role", "d_min", "d_mean_k"))


# Forest settings of the registered model queries (recorded in their output).
QUERY_FOREST = ForestParams(num_trees=100, max_depth=10)


def _copula_sample(spark, d, seed: int = 0):
    sts, roles = split_students(spark, d, seed)
    tr = sts.where(F.col("split") == "train").drop("split")
    te = sts.where(F.col("split") == "test").drop("split")
    gc = GaussianCopula().fit(tr)
    syn = gc.sample(spark, tr.count(), seed=seed).checkpoint(eager=True)
    return tr, te, syn, roles


@register("copula_sample", None)
def copula_sample_q(spark, d):
    """Y1 + Y2: Gaussian copula fitted on the train part, as many rows sampled."""
    _, _, syn, _ = _copula_sample(spark, d)
    return syn


@register("c2st", None)
def c2st_q(spark, d):
    """Classifier two-sample test, real test part vs copula sample."""
    _, te, syn, roles = _copula_sample(spark, d)
    r = c2st_effective_auc(te, syn, roles, fp=QUERY_FOREST)
    return spark.createDataFrame([r]).select("effective_auc", "auc", "n_per_class", "num_trees", "max_depth")


@register("mia", None)
def mia_q(spark, d):
    """Membership inference from kNN distances, three attackers, worst case."""
    tr, te, syn, roles = _copula_sample(spark, d)
    r = mia_worst_case(tr, te, syn, roles, fp=QUERY_FOREST)
    rows = [(name, v["auc"], v["effective_auc"], r["worst_case_effective_auc"], r["n_members"]) for name, v in r["attackers"].items()]
    return spark.createDataFrame(rows, "attacker string, auc double, effective_auc double, worst_case_effective_auc double, n_members long")


@register("tstr_utility", None)
def tstr_utility_q(spark, d):
    """E13 + E14: TSTR and TRTR metrics (long form) for both tasks."""
    tr, te, syn, roles = _copula_sample(spark, d)
    m, _ = tstr_utility(tr, te, syn, roles, fp=QUERY_FOREST)
    rows = [(task, k, float(v) if v is not None else None) for task, kv in m.items() for k, v in kv.items()]
    return spark.createDataFrame(rows, "task string, metric string, value double")


# ---------------------------------------------------------------- streaming, sinks
@register("streaming_click_features", S.q_streaming_click_features())
def streaming_click_features_q(spark, d):
    """Click features per student from a file stream (availableNow)."""
    return round_doubles(run_incremental(spark, standin_click_stream(spark, d), ["id_student"]))


@register("consolidated_slice", S.q_consolidated_slice())
def consolidated_slice_q(spark, d):
    """S10 + S11: write train/test into the partitioned table, read one slice back."""
    import os
    import uuid

    sts, _ = split_students(spark, d)
    cols = ["id_student", "nation", "final_grade", "dropout"]
    path = os.path.join(ensure_checkpoint_dir(spark), f"consolidated-{uuid.uuid4().hex}")
    write_consolidated({("real_train", "real"): sts.where(F.col("split") == "train").select(*cols),
                        ("test", "real"): sts.where(F.col("split") == "test").select(*cols)}, path)
    return round_doubles(read_slice(spark, path, "test", "real").select(*cols, "split", "synthesizer"))


@register("importance_preservation", None)
def importance_preservation_q(spark, d):
    """M12 + A19 + M13: mean absolute SHAP values of TRTR and TSTR forests, Spearman rho and p per task."""
    tr, te, syn, roles = _copula_sample(spark, d)
    return importance_preservation(tr, te, {GaussianCopula.name: syn}, roles, fp=QUERY_FOREST)[0].drop("synthesizer")


def _explained(sts, roles, seed: int, task: str, fp: ForestParams, prep=None):
    """Real test rows explained by a forest of the real train part."""
    train, test = sts.where(F.col("split") == "train"), sts.where(F.col("split") == "test")
    feats = [c for c in sts.columns if c not in (*roles.id_cols, *roles.target_cols, "split")]
    target = roles.target_cols[0 if task == "classification" else 1]
    return shap_values(train, test, target, feats, infer_feature_spec(sts.select(*feats)), task,
                       train_key="id_student", test_key="id_student", seed=seed, fp=fp, prep=prep)


@register("shap_additivity", S.q_shap_additivity())
def shap_additivity_q(spark, d):
    """Base value + SHAP values - prediction of every test row, both tasks."""
    parts, prep = [], None
    sts, roles = split_students(spark, d)
    for task in ("classification", "regression"):
        values, prep = _explained(sts, roles, 0, task, QUERY_FOREST, prep)
        gap = F.col("base") + F.aggregate("shap", F.lit(0.0), lambda a, v: a + v) - F.col("prediction")
        parts.append(values.select(F.lit(task).alias("task"), F.col("row_id").cast("long").alias("id_student"), F.abs(F.round(gap, 6)).alias("gap")))
    return parts[0].unionByName(parts[1])


#: seeds and trees of the pooled value table; the reference's settings for it are few trees, many seeds
POOLED_RUNS, POOLED_FOREST = (0, 1, 2), ForestParams(shap_trees=30, max_depth=10)


def shap_store(spark, d, path: str, runs=POOLED_RUNS) -> None:
    """Values of every run's classifier on its test rows, appended to the store at ``path``."""
    students, roles = _students(spark, d)
    for run in runs:
        sts = group_split(students, roles.group_col, test_size=0.3, seed=run)
        values, prep = _explained(sts, roles, run, "classification", POOLED_FOREST)
        named = parent_values(values, prep.feature_names, prep.parents)
        write_shap(named, parent_names(prep.feature_names, prep.parents), path, key="row_id", run=run, regime="trtr", task="classification")


@register("shap_pooled_top", None)
def shap_pooled_top_q(spark, d):
    """The ten features with the largest mean absolute SHAP value, pooled over three runs read back from the store."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shap-{uuid.uuid4().hex}"
    shap_store(spark, d, path)
    return round_doubles(pooled_top(read_shap(spark, path, regime="trtr", task="classification", runs=list(POOLED_RUNS)), 10))


from cohortlens.plans import report_queries  # noqa: E402, F401  (registers its queries)
