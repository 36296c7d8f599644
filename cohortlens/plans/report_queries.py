"""Registered queries of the test grid, the report tables and the preparation steps.

Each has its DuckDB statement beside it.  The stand-in evaluation metrics
are aggregates of ``events`` per event type (synthesizer) and weekday
(seed); importance maps are shares of ``lineitem`` columns per return flag
(source) and line number (seed).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.exprs import clip_lower, round_doubles
from cohortlens.functions.hashing import sql_h52
from cohortlens.operators import report as P
from cohortlens.operators import resample as R
from cohortlens.operators.effect import cohens_d_for_features, cohens_d_from_means
from cohortlens.operators.prep import fit_prep
from cohortlens.operators.ranks import feature_sets, importance_comparison, mean_importance_over_runs, rollup_encoded, top_features
from cohortlens.operators.split import sample_exact, stratified_split
from cohortlens.operators.synth import clip_to_quantiles, fill_median_mode, text_ranks, recode, restore_domain, validate_output
from cohortlens.plans import oracle_sql as S
from cohortlens.plans.losses import SYNTHESIZERS, grid_losses, regime_pairs, synthesizer_pairs
from cohortlens.plans.registry import register, split_students
from cohortlens.roles import infer_feature_spec
from cohortlens.sources.tables import Tables

#: tests made: two tasks of every pair, and two tasks of two models of every synthesizer
FAMILY = len(SYNTHESIZERS) * (len(SYNTHESIZERS) - 1) // 2 * 2 + len(SYNTHESIZERS) * 2 * 2

# ------------------------------------------------------------- E18, E19 grids
_HALF = f"['syn_a', 'syn_b', 'syn_c'][{sql_h52('5', 'id_student')} % 3 + 1]"


def _grid_cte() -> str:
    models = "".join(
        f"""
seen_{m} AS (SELECT synthesizer, {m}, avg(final_grade) AS pr, avg(dropout) AS pc FROM gtr GROUP BY synthesizer, {m}),
pred_{m} AS (SELECT t.id_student AS row_id, w.synthesizer, '{m}' AS model, t.final_grade AS y, t.dropout AS c,
               coalesce(s.pr, w.gr) AS pr, coalesce(s.pc, w.gc) AS pc
        FROM (SELECT * FROM sts WHERE split = 'test') t CROSS JOIN whole w LEFT JOIN seen_{m} s ON s.synthesizer = w.synthesizer AND s.{m} = t.{m}),"""
        for m in ("nation", "region")
    )
    return f"""{S._with_split()},
gtr AS (SELECT *, unnest([{_HALF}, 'real']) AS synthesizer FROM sts WHERE split = 'train'),
whole AS (SELECT synthesizer, avg(final_grade) AS gr, avg(dropout) AS gc FROM gtr GROUP BY synthesizer),{models}
preds AS (SELECT * FROM pred_nation UNION ALL SELECT * FROM pred_region),
gl AS (SELECT row_id, 'regression' AS task, synthesizer, model, abs(y - pr) AS loss FROM preds
       UNION ALL SELECT row_id, 'classification', synthesizer, model, -ln(least(greatest(CASE WHEN c = 1 THEN pc ELSE 1 - pc END, 1e-15), 1.0)) FROM preds)"""


def _grid_tests(cte: str, pairs: str, groups: str) -> str:
    sql = (f"{cte}, prs AS ({pairs}), {S._tests_from('prs', groups)} SELECT *, CAST({FAMILY} AS BIGINT) AS n_tests, "
           f"0.05 / {FAMILY} AS alpha_corrected, p_value < 0.05 / {FAMILY} AS significant FROM tests")
    return S.rounded(sql, ["p_value", "mean_diff", "cohens_d", "alpha_corrected"])


def _grid(spark, d):
    sts, _ = split_students(spark, d)
    return grid_losses(sts, key="id_student", models=("nation", "region"), reg_target="final_grade", cls_target="dropout")


@register("pairwise_tests", _grid_tests(_grid_cte(), """
SELECT a.row_id, a.task, a.synthesizer AS first, b.synthesizer AS second, a.loss - b.loss AS d
FROM gl a JOIN gl b ON a.row_id = b.row_id AND a.task = b.task AND a.model = b.model AND a.synthesizer < b.synthesizer
WHERE a.model = 'nation' AND a.synthesizer <> 'real' AND b.synthesizer <> 'real'""", "task, first, second"))
def pairwise_tests_q(spark, d):
    """E18 + E20: every pair of synthesizers, both tasks, corrected over the family of 18."""
    pairs = synthesizer_pairs(_grid(spark, d).where(F.col("model") == "nation"))
    tests = R.paired_permutation_test(pairs, "loss_a", "loss_b", "row_id", group_cols=("task", "first", "second"), n_perm=10000)
    return round_doubles(R.bonferroni(tests, 0.05, FAMILY))


@register("utility_gap_tests", _grid_tests(_grid_cte(), """
SELECT a.row_id, a.task, a.model, a.synthesizer, a.loss - b.loss AS d
FROM gl a JOIN gl b ON a.row_id = b.row_id AND a.task = b.task AND a.model = b.model AND b.synthesizer = 'real'
WHERE a.synthesizer <> 'real'""", "task, model, synthesizer"))
def utility_gap_tests_q(spark, d):
    """E19 + E20: trained on synthetic against trained on real, per synthesizer, model and task."""
    pairs = regime_pairs(_grid(spark, d))
    tests = R.paired_permutation_test(pairs, "loss_a", "loss_b", "row_id", group_cols=("task", "model", "synthesizer"), n_perm=10000)
    return round_doubles(R.bonferroni(tests, 0.05, FAMILY))


# ------------------------------------------------------------- report tables
#: metric -> aggregate over a cell's events, the same text in both engines (k: hint count, v: value)
EVAL = {
    "sdmetrics_overall_score": "avg(CASE WHEN v < 50 THEN 1e0 ELSE 0e0 END)",
    "c2st_effective_auc": "0.5e0 + 0.5e0 * avg(CASE WHEN k >= 75 THEN 1e0 ELSE 0e0 END)",
    "mia_worst_case_effective_auc": "0.5e0 + 0.5e0 * avg(CASE WHEN k < 10 THEN 1e0 ELSE 0e0 END)",
    "tstr_cls_rf_auc": "0.5e0 + 0.5e0 * avg(CASE WHEN v < 80 THEN 1e0 ELSE 0e0 END)",
    "trtr_cls_rf_auc": "0.5e0 + 0.5e0 * avg(CASE WHEN v < 90 THEN 1e0 ELSE 0e0 END)",
    "tstr_reg_rf_mae": "avg(v)",
    "trtr_reg_rf_mae": "avg(CASE WHEN v < 100 THEN v ELSE 100e0 END)",
    "tstr_reg_ridge_mae": "avg(v) + 1",
    "trtr_reg_ridge_mae": "avg(CASE WHEN v < 120 THEN v ELSE 120e0 END)",
}
_EVENTS_SQL = "SELECT event_type AS synthesizer, CAST(dayofweek(ts) AS INTEGER) AS seed, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"
_EVAL_CTE = (
    f"e AS ({_EVENTS_SQL}), w AS (SELECT synthesizer, seed, " + ", ".join(f"{x} AS {m}" for m, x in EVAL.items()) + " FROM e GROUP BY synthesizer, seed), "
    "m AS (SELECT 'events' AS dataset, synthesizer, seed, metric, value FROM (UNPIVOT w ON " + ", ".join(EVAL) + " INTO NAME metric VALUE value))"
)


def _cells(spark, d):
    e = Tables(spark, d).events
    return e.select(F.col("event_type").alias("synthesizer"), (F.dayofweek("ts") - 1).alias("seed"), F.col("value").alias("v"),
                    F.get_json_object("props", "$.k").cast("double").alias("k"))


def _eval(spark, d):
    wide = _cells(spark, d).groupBy("synthesizer", "seed").agg(*[F.expr(x).cast("double").alias(m) for m, x in EVAL.items()])
    return wide.unpivot(["synthesizer", "seed"], list(EVAL), "metric", "value").select(F.lit("events").alias("dataset"), "synthesizer", "seed", "metric", "value")


_WIDE = "p AS (SELECT dataset, synthesizer, " + ", ".join(f"avg(value) FILTER (WHERE metric = '{m}') AS {m}" for m in EVAL) + " FROM m GROUP BY dataset, synthesizer)"


@register("score_matrices", S.rounded(f"""WITH {_EVAL_CTE}, {_WIDE}
SELECT dataset, synthesizer, sdmetrics_overall_score * 100 AS quality,
  200 * (1 - c2st_effective_auc) AS realism_score, 200 * (1 - mia_worst_case_effective_auc) AS privacy_score, tstr_cls_rf_auc * 100 AS cls_score,
  100 * least(1, trtr_reg_ridge_mae / nullif(tstr_reg_ridge_mae, 0)) AS reg_score,
  greatest(0, 1 - (c2st_effective_auc - 0.5) / 0.5) * 100 AS realism_clamped, greatest(0, 1 - (mia_worst_case_effective_auc - 0.5) / 0.5) * 100 AS privacy_clamped,
  CASE WHEN trtr_cls_rf_auc > 0 THEN least(100, tstr_cls_rf_auc / trtr_cls_rf_auc * 100) ELSE 100 END AS cls_clamped,
  CASE WHEN tstr_reg_rf_mae > 0 THEN least(100, trtr_reg_rf_mae / tstr_reg_rf_mae * 100) ELSE 100 END AS reg_clamped FROM p""",
    ["quality", "realism_score", "privacy_score", "cls_score", "reg_score", "realism_clamped", "privacy_clamped", "cls_clamped", "reg_clamped"]))
def score_matrices_q(spark, d):
    """Both score variants of the synthesizer matrix."""
    return round_doubles(P.score_matrices(_eval(spark, d)))


@register("utility_tables", S.rounded(f"""WITH {_EVAL_CTE},
t(real_metric, metric) AS (VALUES ('trtr_cls_rf_auc', 'tstr_cls_rf_auc'), ('trtr_reg_rf_mae', 'tstr_reg_rf_mae'), ('trtr_reg_ridge_mae', 'tstr_reg_ridge_mae'))
SELECT dataset, t.metric, 'Real' AS model, avg(value) AS mean, stddev_pop(value) AS std_pop FROM t JOIN m ON m.metric = t.real_metric GROUP BY ALL
UNION ALL SELECT dataset, t.metric, synthesizer, avg(value), stddev_pop(value) FROM t JOIN m ON m.metric = t.metric GROUP BY ALL""", ["mean", "std_pop"]))
def utility_tables_q(spark, d):
    """The real baseline against each synthesizer (forest AUC, forest and ridge MAE)."""
    m = _eval(spark, d)
    a, b, c = (P.utility_table(m, f"trtr_{x}", f"tstr_{x}") for x in ("cls_rf_auc", "reg_rf_mae", "reg_ridge_mae"))
    return round_doubles(a.unionByName(b).unionByName(c))


@register("model_comparison", S.rounded("""
WITH r AS (SELECT 'events' AS dataset, event_type AS synthesizer, CAST(avg(value) / 1000 AS VARCHAR) AS overall_score,
  CASE WHEN event_type = 'click' THEN 'n/a' ELSE CAST(0.5 + count(*) / (1.0 + 2 * (SELECT count(*) FROM events)) AS VARCHAR) END AS effective_auc_mean,
  '0.75' AS auc, CASE WHEN event_type = 'error' THEN NULL ELSE '0.625' END AS worst_case_effective_auc FROM events GROUP BY event_type)
SELECT dataset, synthesizer, coalesce(try_cast(overall_score AS DOUBLE), 0) * 100 AS quality,
  coalesce(try_cast(effective_auc_mean AS DOUBLE), try_cast(auc AS DOUBLE), 0) * 100 AS realism,
  coalesce(try_cast(worst_case_effective_auc AS DOUBLE), 0) * 100 AS privacy FROM r""", ["quality", "realism", "privacy"]))
def model_comparison_q(spark, d):
    """E24 + P19: quality, realism and privacy with fallback keys read from raw texts."""
    e = Tables(spark, d).events
    total = e.agg(F.count(F.lit(1))).scalar()
    r = e.groupBy(F.lit("events").alias("dataset"), F.col("event_type").alias("synthesizer")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    records = r.select(
        "dataset", "synthesizer", (F.col("v") / 1000).cast("string").alias("overall_score"),
        F.when(F.col("synthesizer") == "click", F.lit("n/a")).otherwise((F.lit(0.5) + F.col("n") / (F.lit(1.0) + 2 * total)).cast("string")).alias("effective_auc_mean"),
        F.lit("0.75").alias("auc"), F.when(F.col("synthesizer") != "error", F.lit("0.625")).alias("worst_case_effective_auc"))
    return round_doubles(P.model_comparison(records))


@register("attacker_breakdown", S.rounded(f"""WITH {_EVAL_CTE},
r AS (SELECT synthesizer, seed, 0.5 + 0.5 * avg(CASE WHEN k < 20 THEN 1.0 ELSE 0.0 END) AS logistic_regression,
  0.5 + 0.5 * avg(CASE WHEN k < 40 THEN 1.0 ELSE 0.0 END) AS random_forest, 0.5 + 0.5 * avg(CASE WHEN k < 60 THEN 1.0 ELSE 0.0 END) AS gradient_boosting FROM e GROUP BY synthesizer, seed)
SELECT 'events' AS dataset, synthesizer, attacker, avg(value) AS mean, stddev_pop(value) AS std_pop
FROM (UNPIVOT r ON logistic_regression, random_forest, gradient_boosting INTO NAME attacker VALUE value) GROUP BY ALL""", ["mean", "std_pop"]))
def attacker_breakdown_q(spark, d):
    """E25 + A15: the attackers map exploded and rolled up over seeds."""
    share = lambda x: F.lit(0.5) + F.lit(0.5) * F.avg(F.when(F.col("k") < x, 1.0).otherwise(0.0))
    runs = _cells(spark, d).groupBy(F.lit("events").alias("dataset"), "synthesizer", "seed").agg(
        F.create_map(F.lit("logistic_regression"), share(20), F.lit("random_forest"), share(40), F.lit("gradient_boosting"), share(60)).alias("attackers"))
    return round_doubles(P.attacker_table(runs))


@register("nested_lookup", """SELECT event_type, sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS k_total,
  sum(coalesce(CAST(json_extract_string(props, '$.deep.key') AS BIGINT), -1))::BIGINT AS missing_total FROM events GROUP BY event_type""")
def nested_lookup_q(spark, d):
    """P20: nested lookups with a default, summed."""
    look = lambda path, default: F.coalesce(F.get_json_object("props", path).cast("bigint"), F.lit(default))
    return Tables(spark, d).events.groupBy("event_type").agg(F.sum(look("$.k", 0)).alias("k_total"), F.sum(look("$.deep.key", -1)).alias("missing_total"))


# ------------------------------------------------------------- importances
_IMP_CTE = """i AS (SELECT l_returnflag AS source, l_linenumber AS seed, f AS feature, v AS importance FROM (
  SELECT l_returnflag, l_linenumber, unnest(['quantity', 'discount', 'tax', 'status_' || lower(l_linestatus)]) AS f,
         unnest([l_quantity / 50, l_discount, l_tax, 1.0]) AS x FROM lineitem) s, LATERAL (SELECT x AS v) z),
imp AS (SELECT source, seed, feature, sum(importance) AS importance FROM i WHERE NOT (feature = 'tax' AND seed > 5) GROUP BY source, seed, feature)"""


def _importances(spark, d):
    li = Tables(spark, d).lineitem
    parts = [("quantity", F.col("l_quantity") / 50), ("discount", F.col("l_discount")), ("tax", F.col("l_tax")),
             (F.concat(F.lit("status_"), F.lower("l_linestatus")), F.lit(1.0))]
    cells = F.array(*[F.struct((F.lit(n) if isinstance(n, str) else n).alias("feature"), x.cast("double").alias("x")) for n, x in parts])
    rows = li.select(F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("seed"), F.explode(cells).alias("c")).select("source", "seed", "c.*")
    return rows.where(~((F.col("feature") == "tax") & (F.col("seed") > 5))).groupBy("source", "seed", "feature").agg(F.sum("x").alias("importance"))


@register("importance_comparison", S.rounded(f"""WITH {_IMP_CTE},
runs AS (SELECT source, count(DISTINCT seed) AS n FROM imp GROUP BY source),
mm AS (SELECT feature, source, sum(importance) / any_value(n) AS v FROM imp JOIN runs USING (source) GROUP BY feature, source),
wide AS (SELECT feature, coalesce(max(v) FILTER (WHERE source = 'A'), 0) AS A, coalesce(max(v) FILTER (WHERE source = 'N'), 0) AS N,
         coalesce(max(v) FILTER (WHERE source = 'R'), 0) AS R FROM mm GROUP BY feature)
SELECT *, CAST(row_number() OVER (ORDER BY N DESC, feature) AS INTEGER) AS position FROM wide""", ["A", "N", "R"]))
def importance_comparison_q(spark, d):
    """E27 + A16 + J8: mean importances per source side by side, missing = 0, by the baseline's order."""
    return round_doubles(importance_comparison(_importances(spark, d), ["A", "N", "R"], "N"))


@register("top_importances", S.rounded(f"""WITH {_IMP_CTE},
enc AS (SELECT feature, sum(importance) / (SELECT count(*) FROM (SELECT DISTINCT source, seed FROM imp)) AS importance FROM imp GROUP BY feature),
par AS (SELECT CASE WHEN feature LIKE 'status_%' THEN 'status' ELSE feature END AS feature, sum(importance) AS importance FROM enc GROUP BY 1)
SELECT feature, importance FROM par ORDER BY importance DESC, feature LIMIT 3""", ["importance"]))
def top_importances_q(spark, d):
    """A16 + A19 + O7: means over all runs, encoded columns rolled up to their parent, the top three."""
    mean = mean_importance_over_runs(_importances(spark, d), ["source", "seed"]).withColumnRenamed("feature", "encoded")
    parents = mean.where(F.col("encoded").startswith("status_")).select("encoded", F.lit("status").alias("parent"))
    return round_doubles(top_features(rollup_encoded(mean, parents), 3))


@register("feature_sets", f"""WITH {_IMP_CTE}, a AS (SELECT DISTINCT feature FROM imp WHERE seed <= 2), b AS (SELECT DISTINCT feature FROM imp WHERE seed >= 6)
SELECT coalesce(a.feature, b.feature) AS feature, a.feature IS NOT NULL AND b.feature IS NOT NULL AS common FROM a FULL JOIN b ON a.feature = b.feature""")
def feature_sets_q(spark, d):
    """Union of two feature sets and which features both hold."""
    imp = _importances(spark, d)
    return feature_sets(imp.where("seed <= 2"), imp.where("seed >= 6"))


# ------------------------------------------------------------- effects
@register("effect_from_stats", S.rounded("""
WITH g AS (SELECT c_mktsegment AS segment, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY c_mktsegment),
b AS (SELECT * FROM g WHERE segment = 'BUILDING')
SELECT g.segment, (g.m - b.m) / nullif(sqrt(((g.n - 1) * g.s * g.s + (b.n - 1) * b.s * b.s) / (g.n + b.n - 2)), 0) AS cohens_d FROM g, b""", ["cohens_d"]))
def effect_from_stats_q(spark, d):
    """D of each segment's balance against BUILDING, from summary statistics alone."""
    g = Tables(spark, d).customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"))
    b = g.where("segment = 'BUILDING'")
    n, m, s = (b.select(c).scalar() for c in ("n", "m", "s"))
    return round_doubles(g.select("segment", cohens_d_from_means(F.col("m"), m, F.col("s"), s, F.col("n"), n).alias("cohens_d")))


@register("effect_for_features", S.rounded(f"""{S._with_split()},
x AS (SELECT split, CAST(acctbal AS DOUBLE) AS acctbal, CAST(n_vle_days AS DOUBLE) AS n_vle_days FROM sts),
l AS (SELECT split, feature, value FROM (UNPIVOT x ON acctbal, n_vle_days INTO NAME feature VALUE value)),
m AS (SELECT feature, avg(value) FILTER (WHERE split = 'train') AS m1, avg(value) FILTER (WHERE split = 'test') AS m2,
  var_samp(value) FILTER (WHERE split = 'train') AS v1, var_samp(value) FILTER (WHERE split = 'test') AS v2,
  count(*) FILTER (WHERE split = 'train') AS n1, count(*) FILTER (WHERE split = 'test') AS n2 FROM l GROUP BY feature),
e AS (SELECT feature, (m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0) AS cohens_d FROM m)
SELECT feature, cohens_d, CASE WHEN cohens_d IS NULL THEN 'undefined' WHEN abs(cohens_d) < 0.2 THEN 'negligible' WHEN abs(cohens_d) < 0.5 THEN 'small'
  WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END AS interpretation FROM e
UNION ALL SELECT 'nation', NULL, 'non-numeric' UNION ALL SELECT 'no_such_column', NULL, 'missing'""", ["cohens_d"]))
def effect_for_features_q(spark, d):
    """D per requested column, with markers for a text column and a missing one."""
    sts, _ = split_students(spark, d)
    parts = [sts.where(F.col("split") == s) for s in ("train", "test")]
    return round_doubles(cohens_d_for_features(*parts, ["acctbal", "n_vle_days", "nation", "no_such_column"]))


# ------------------------------------------------------------- samples
_ROW_HASH = sql_h52("4", "l_orderkey", "l_linenumber")


@register("sample_exact", f"""SELECT l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, row_number() OVER (ORDER BY {_ROW_HASH}) AS rn FROM lineitem) WHERE rn <= (SELECT count(*) // 5 FROM lineitem)""")
def sample_exact_q(spark, d):
    """O2: exactly a fifth of all line items by a seeded hash of the composite key."""
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sample_exact(li, ["l_orderkey", "l_linenumber"], li.count() // 5, seed=4)


@register("stratified_split", f"""WITH h AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql_h52('6', 'c_custkey')}) AS rn FROM customer),
n AS (SELECT c_mktsegment, count(*) AS n, (SELECT ceil(0.3 * count(*)) FROM customer) AS k, (SELECT count(*) FROM customer) AS t FROM customer GROUP BY c_mktsegment),
f AS (SELECT *, floor(k * n / t) AS lo, k * n / t - floor(k * n / t) AS rest FROM n),
a AS (SELECT *, lo + CASE WHEN row_number() OVER (ORDER BY rest DESC, c_mktsegment) <= k - sum(lo) OVER () THEN 1 ELSE 0 END AS take FROM f)
SELECT c_custkey, h.c_mktsegment, CASE WHEN rn <= take THEN 'test' ELSE 'train' END AS split FROM h JOIN a ON h.c_mktsegment = a.c_mktsegment""")
def stratified_split_q(spark, d):
    """30 % of the customers to test, segment shares kept (largest remainder)."""
    c = Tables(spark, d).customer.select("c_custkey", "c_mktsegment")
    return stratified_split(c, "c_custkey", "c_mktsegment", test_size=0.3, seed=6)


# ------------------------------------------------------------- preparation and intake
_HOLES_CTE = """h AS (SELECT c.c_custkey, c.c_acctbal AS balance, o.spent, o.busiest FROM customer c LEFT JOIN (
  SELECT o_custkey, sum(o_totalprice) AS spent, min(o_orderpriority) AS busiest FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)"""


def _holes(spark, d):
    """Customers with nulls where no finished order exists."""
    t = Tables(spark, d)
    o = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.min("o_orderpriority").alias("busiest"))
    c = t.customer
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.col("c_acctbal").alias("balance"), "spent", "busiest")


@register("prep_stats", S.rounded(f"""WITH {_HOLES_CTE}, md AS (SELECT median(balance) AS mb, median(spent) AS ms FROM h)
SELECT 'balance' AS column_name, any_value(mb) AS median, avg(coalesce(balance, mb)) AS mean, stddev_pop(coalesce(balance, mb)) AS scale, NULL AS mode FROM h, md
UNION ALL SELECT 'spent', any_value(ms), avg(coalesce(spent, ms)), stddev_pop(coalesce(spent, ms)), NULL FROM h, md
UNION ALL SELECT 'busiest', NULL, NULL, NULL, (SELECT busiest FROM h WHERE busiest IS NOT NULL GROUP BY busiest ORDER BY count(*) DESC, busiest LIMIT 1)""",
    ["median", "mean", "scale"]))
def prep_stats_q(spark, d):
    """M1-M3 + M5: fitted medians, means, scales and modes."""
    df = _holes(spark, d).drop("c_custkey")
    p = fit_prep(df, infer_feature_spec(df))
    rows = [(c, p.medians[c], p.means[c], p.scales[c], None) for c in p.spec.numeric_cols] + [(c, None, None, None, p.modes[c]) for c in p.spec.categorical_cols]
    return round_doubles(spark.createDataFrame(rows, "column_name string, median double, mean double, scale double, mode string"))


@register("onehot_domain", f"""WITH {_HOLES_CTE}, top AS (SELECT busiest FROM h WHERE busiest IS NOT NULL GROUP BY busiest ORDER BY count(*) DESC, busiest LIMIT 1),
x AS (SELECT coalesce(busiest, (SELECT busiest FROM top)) AS v FROM h)
SELECT 'busiest=' || v AS feature, count(*) AS ones FROM x GROUP BY v""")
def onehot_domain_q(spark, d):
    """M4: ones per encoded column after mode imputation (encoded for every row)."""
    df = _holes(spark, d).drop("c_custkey", "balance", "spent")
    p = fit_prep(df, infer_feature_spec(df))
    enc = p.transform(df, [], vector=False).select(F.posexplode("features_arr").alias("pos", "one")).groupBy("pos").agg(F.sum("one").cast("bigint").alias("ones"))
    names = spark.createDataFrame(list(enumerate(p.feature_names)), "pos int, feature string")
    return enc.join(names, "pos").select("feature", "ones")


@register("clip_fill_validate", S.rounded(f"""WITH {_HOLES_CTE},
m AS (SELECT median(spent) AS ms FROM h), q AS (SELECT quantile_cont(balance, 0.005) AS b0, quantile_cont(balance, 0.995) AS b1, quantile_cont(spent, 0.005) AS s0, quantile_cont(spent, 0.995) AS s1 FROM h),
top AS (SELECT busiest FROM h WHERE busiest IS NOT NULL GROUP BY busiest ORDER BY count(*) DESC, busiest LIMIT 1)
SELECT c_custkey, least(greatest(balance, b0), b1) AS balance, least(greatest(coalesce(spent, ms), s0), s1) AS spent, coalesce(busiest, (SELECT busiest FROM top)) AS busiest
FROM h, m, q""", ["balance", "spent"]))
def clip_fill_validate_q(spark, d):
    """Fill with median and mode, clip to the training quantiles, and pass the validation."""
    df = _holes(spark, d)
    out = clip_to_quantiles(fill_median_mode(df, infer_feature_spec(df, exclude=["c_custkey"])), ["balance", "spent"], ref=df)
    validate_output(out, ["balance", "spent", "busiest"])
    return round_doubles(out)


@register("recode_domain", """WITH s AS (SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN 'AUTOMOBILE' ELSE c_mktsegment END AS value FROM customer UNION SELECT DISTINCT o_orderpriority FROM orders),
b AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment <> 'MACHINERY')),
x AS (SELECT value FROM s EXCEPT SELECT value FROM b)
SELECT value, pos FROM b UNION ALL SELECT value, CAST((SELECT count(*) FROM b) + row_number() OVER (ORDER BY value) - 1 AS INTEGER) FROM x""")
def recode_domain_q(spark, d):
    """P12 + P13 + U4: labels recoded, then the training domain followed by unseen values."""
    t = Tables(spark, d)
    syn = recode(t.customer.select(F.col("c_mktsegment").alias("v")), {"BUILDING": "AUTOMOBILE"}, ["v"]).unionByName(t.orders.select(F.col("o_orderpriority").alias("v")))
    known = t.customer.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("value")).distinct()
    base = text_ranks(known, "value").select("value", (F.col("nth") - 1).cast("int").alias("pos"))
    return restore_domain(syn, base, "v")


@register("clip_and_union", S.rounded("""SELECT c_custkey AS id, greatest(c_acctbal, 0) AS balance, c_mktsegment AS segment, NULL AS supplier FROM customer
UNION ALL SELECT s_suppkey, greatest(s_acctbal, 0), NULL, s_name FROM supplier""", ["balance"]))
def clip_and_union_q(spark, d):
    """P4 + U2: lower clip, and a union whose missing columns are null."""
    t = Tables(spark, d)
    c = t.customer.select(F.col("c_custkey").alias("id"), clip_lower(F.col("c_acctbal"), 0.0).alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), clip_lower(F.col("s_acctbal"), 0.0).alias("balance"), F.col("s_name").alias("supplier"))
    return round_doubles(c.unionByName(s, allowMissingColumns=True))
