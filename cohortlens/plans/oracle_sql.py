"""Reference SQL (DuckDB dialect) for the registered queries.

Each statement recomputes its query from the provided tables with plain
SQL, so an independent engine checks the Spark plan.  Shared pieces are
CTE strings that later statements reuse.
"""

from __future__ import annotations

from cohortlens.functions.hashing import sql_h52
from cohortlens.operators.resample import GOLDEN, MIX1, MIX2, stream_start


def rounded(sql: str, cols: list[str], digits: int = 6) -> str:
    rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"


STUDENT_DOUBLES = [
    "acctbal", "dropout", "date_registration", "date_unregistration", "is_unregistered",
    "total_vle_clicks", "n_vle_records", "n_vle_sites", "n_vle_days", "mean_vle_clicks",
    "clicks_per_active_day", "n_assessments", "final_grade",
]

STUDENT_CTE = """
st_info AS (
  SELECT c.c_custkey AS id_student, n.n_name AS nation, r.r_name AS region, c.c_acctbal AS acctbal,
         CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 1.0 ELSE 0.0 END AS dropout
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
st_reg AS (
  SELECT o_custkey AS id_student,
         min(CAST(o_orderdate AS DATE) - DATE '1992-01-01') AS date_registration,
         min(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) - DATE '1992-01-01' END) AS date_unregistration
  FROM orders GROUP BY o_custkey
),
st_clk AS (
  SELECT user_id AS id_student, CAST(sum(CAST(value AS DECIMAL(28, 9))) AS DOUBLE) AS total_vle_clicks, count(*) AS n_vle_records,
         count(DISTINCT event_type) AS n_vle_sites, count(DISTINCT CAST(ts AS DATE)) AS n_vle_days
  FROM events GROUP BY user_id
),
st_grd AS (
  SELECT o.o_custkey AS id_student, count(DISTINCT l.l_partkey) AS n_assessments,
         coalesce(sum(p.p_size), 0) AS total_weight,
         coalesce(CAST(sum(CAST(l.l_extendedprice / 1000.0 * p.p_size AS DECIMAL(28, 9))) AS DOUBLE), 0) AS weighted_score_sum
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY o.o_custkey
),
st AS (
  SELECT i.id_student, coalesce(i.nation, 'Unknown') AS nation, coalesce(i.region, 'Unknown') AS region,
         i.acctbal, i.dropout,
         CAST(g.date_registration AS DOUBLE) AS date_registration,
         coalesce(CAST(g.date_unregistration AS DOUBLE), -999.0) AS date_unregistration,
         CAST(CASE WHEN g.id_student IS NULL THEN NULL WHEN g.date_unregistration IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) AS is_unregistered,
         coalesce(CAST(k.total_vle_clicks AS DOUBLE), 0.0) AS total_vle_clicks,
         coalesce(CAST(k.n_vle_records AS DOUBLE), 0.0) AS n_vle_records,
         coalesce(CAST(k.n_vle_sites AS DOUBLE), 0.0) AS n_vle_sites,
         coalesce(CAST(k.n_vle_days AS DOUBLE), 0.0) AS n_vle_days,
         coalesce(k.total_vle_clicks / nullif(k.n_vle_records, 0), 0.0) AS mean_vle_clicks,
         coalesce(k.total_vle_clicks / nullif(k.n_vle_days, 0), 0.0) AS clicks_per_active_day,
         coalesce(CAST(d.n_assessments AS DOUBLE), 0.0) AS n_assessments,
         coalesce(d.weighted_score_sum / nullif(CAST(d.total_weight AS DOUBLE), 0), 0.0) AS final_grade
  FROM st_info i
  LEFT JOIN st_reg g ON i.id_student = g.id_student
  LEFT JOIN st_clk k ON i.id_student = k.id_student
  LEFT JOIN st_grd d ON i.id_student = d.id_student
)"""


def student_split_cte(seed: int = 0, test_size: float = 0.3) -> str:
    """Group split of ``st`` by id_student (adds CTE ``sts`` with column split)."""
    h = sql_h52(str(seed), "id_student")
    return f"""
st_h AS (SELECT id_student, {h} AS h FROM (SELECT DISTINCT id_student FROM st)),
st_r AS (SELECT id_student, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS n FROM st_h),
sts AS (
  SELECT st.*, CASE WHEN r.rn <= ceil(CAST({test_size} AS DOUBLE) * r.n) THEN 'test' ELSE 'train' END AS split
  FROM st JOIN st_r r ON st.id_student = r.id_student
)"""


def q_student_table() -> str:
    return rounded(f"WITH {STUDENT_CTE} SELECT * FROM st", STUDENT_DOUBLES)


INTERACTION_CTE = """
ev AS (
  SELECT user_id, ts AS order_ts, event_id AS order_id, event_type AS skill_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS correct,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS hint_count,
         value AS ms_first_response,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events
),
ev_tot AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n_total FROM ev GROUP BY user_id),
ev_thr AS (SELECT median(n_total) AS thr FROM ev_tot),
ev_feat AS (
  SELECT user_id, avg(CAST(correct AS DOUBLE)) AS student_pct_correct,
         CAST(count(DISTINCT skill_id) AS DOUBLE) AS unique_skills,
         avg(CAST(hint_count AS DOUBLE)) AS hint_rate, 1.0 AS avg_attempts,
         avg(ms_first_response) AS avg_response_time
  FROM ev WHERE rn <= 20 GROUP BY user_id
),
it AS (
  SELECT f.user_id, f.student_pct_correct, f.unique_skills, f.hint_rate,
         CAST(f.avg_attempts AS DOUBLE) AS avg_attempts, f.avg_response_time,
         CAST(CASE WHEN t.n_total >= (SELECT thr FROM ev_thr) THEN 1 ELSE 0 END AS INTEGER) AS high_engagement
  FROM ev_feat f JOIN ev_tot t ON f.user_id = t.user_id
)"""

INTERACTION_DOUBLES = ["student_pct_correct", "unique_skills", "hint_rate", "avg_attempts", "avg_response_time"]


def q_interaction_table() -> str:
    return rounded(f"WITH {INTERACTION_CTE} SELECT * FROM it", INTERACTION_DOUBLES)


def q_group_split() -> str:
    sql = f"WITH {STUDENT_CTE}, {student_split_cte()} SELECT id_student, split, final_grade FROM sts"
    return rounded(sql, ["final_grade"])


def q_shap_additivity() -> str:
    return (f"WITH {STUDENT_CTE}, {student_split_cte()} SELECT task, id_student, 0.0::DOUBLE AS gap "
            "FROM sts, (VALUES ('classification'), ('regression')) AS x(task) WHERE split = 'test'")


# ------------------------------------------------------------ quality / effects
STUDENT_NUMERIC = [
    "acctbal", "dropout", "date_registration", "date_unregistration", "is_unregistered",
    "total_vle_clicks", "n_vle_records", "n_vle_sites", "n_vle_days", "mean_vle_clicks",
    "clicks_per_active_day", "n_assessments", "final_grade",
]
STUDENT_CATEGORICAL = ["nation", "region"]


def _with_split() -> str:
    return f"WITH {STUDENT_CTE}, {student_split_cte()}"


def _unpivot(cols: list[str], where: str, side: int, name: str = "column_name") -> str:
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    on = ", ".join(cols)
    return (f"SELECT {side} AS side, {name}, value FROM "
            f"(UNPIVOT (SELECT {sel} FROM sts WHERE {where}) ON {on} INTO NAME {name} VALUE value)")


def q_ks_complement(raw: bool = False) -> str:
    a = _unpivot(STUDENT_NUMERIC, "split = 'train'", 1)
    b = _unpivot(STUDENT_NUMERIC, "split = 'test'", 0)
    sql = f"""{_with_split()},
lng AS ({a} UNION ALL {b}),
f AS (SELECT column_name, value, sum(side) AS na, sum(1 - side) AS nb FROM lng GROUP BY column_name, value),
c AS (SELECT column_name,
             sum(na) OVER (PARTITION BY column_name ORDER BY value) AS ca,
             sum(nb) OVER (PARTITION BY column_name ORDER BY value) AS cb,
             sum(na) OVER (PARTITION BY column_name) AS ta,
             sum(nb) OVER (PARTITION BY column_name) AS tb FROM f)
SELECT column_name, 'KSComplement' AS metric, 1.0 - max(abs(ca / ta - cb / tb)) AS score FROM c GROUP BY column_name"""
    return sql if raw else rounded(sql, ["score"])


def q_tv_complement(raw: bool = False) -> str:
    parts = []
    for c in STUDENT_CATEGORICAL:
        parts.append(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, CASE WHEN split = 'train' THEN 1 ELSE 0 END AS side FROM sts")
    sql = f"""{_with_split()},
lng AS ({' UNION ALL '.join(parts)}),
f AS (SELECT column_name, value, sum(side) AS na, sum(1 - side) AS nb FROM lng GROUP BY column_name, value),
t AS (SELECT column_name, sum(na) AS ta, sum(nb) AS tb FROM f GROUP BY column_name)
SELECT f.column_name, 'TVComplement' AS metric, 1.0 - 0.5 * sum(abs(na / ta - nb / tb)) AS score
FROM f JOIN t ON f.column_name = t.column_name GROUP BY f.column_name"""
    return sql if raw else rounded(sql, ["score"])


def _pairs(cols):
    return [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]


def q_correlation_similarity(raw: bool = False) -> str:
    parts = []
    for a, b in _pairs(STUDENT_NUMERIC):
        parts.append(
            f"SELECT '{a}' AS column_1, '{b}' AS column_2, 'CorrelationSimilarity' AS metric, "
            f"1.0 - abs((SELECT corr({a}, {b}) FROM sts WHERE split = 'train') - "
            f"(SELECT corr({a}, {b}) FROM sts WHERE split = 'test')) / 2.0 AS score")
    sql = f"{_with_split()} {' UNION ALL '.join(parts)}"
    return sql if raw else rounded(sql, ["score"])


def _contingency_pairs():
    cols = STUDENT_NUMERIC + STUDENT_CATEGORICAL
    cats = set(STUDENT_CATEGORICAL)
    return [(a, b) for a, b in _pairs(cols) if a in cats or b in cats]


def _bin_sql(c: str) -> str:
    if c in STUDENT_CATEGORICAL:
        return f"CAST({c} AS VARCHAR)"
    lo = f"(SELECT min({c}) FROM sts WHERE split = 'train')"
    hi = f"(SELECT max({c}) FROM sts WHERE split = 'train')"
    return (f"CAST(CASE WHEN {c} IS NULL THEN NULL WHEN {hi} = {lo} THEN 0 ELSE "
            f"least(greatest(floor(({c} - {lo}) / ({hi} - {lo}) * 10), 0), 9) END AS BIGINT)::VARCHAR")


def q_contingency_similarity(raw: bool = False) -> str:
    parts = []
    for a, b in _contingency_pairs():
        parts.append(f"SELECT '{a}' AS column_1, '{b}' AS column_2, {_bin_sql(a)} AS x, {_bin_sql(b)} AS y, "
                     f"CASE WHEN split = 'train' THEN 1 ELSE 0 END AS side FROM sts")
    sql = f"""{_with_split()},
lng AS ({' UNION ALL '.join(parts)}),
f AS (SELECT column_1, column_2, x, y, sum(side) AS na, sum(1 - side) AS nb FROM lng GROUP BY ALL),
t AS (SELECT column_1, column_2, sum(na) AS ta, sum(nb) AS tb FROM f GROUP BY ALL)
SELECT f.column_1, f.column_2, 'ContingencySimilarity' AS metric, 1.0 - 0.5 * sum(abs(na / ta - nb / tb)) AS score
FROM f JOIN t USING (column_1, column_2) GROUP BY f.column_1, f.column_2"""
    return sql if raw else rounded(sql, ["score"])


def q_quality_report() -> str:
    shapes = f"SELECT avg(score) AS s FROM (({q_ks_complement(True)}) UNION ALL ({q_tv_complement(True)}))"
    trends = f"SELECT avg(score) AS t FROM (({q_correlation_similarity(True)}) UNION ALL ({q_contingency_similarity(True)}))"
    sql = (f"SELECT (s + t) / 2.0 AS overall_score, s AS column_shapes, t AS column_pair_trends "
           f"FROM ({shapes}) AS a, ({trends}) AS b")
    return rounded(sql, ["overall_score", "column_shapes", "column_pair_trends"])


def q_effect_size_summary() -> str:
    a = _unpivot(STUDENT_NUMERIC, "split = 'train'", 1, "feature")
    b = _unpivot(STUDENT_NUMERIC, "split = 'test'", 0, "feature")
    sql = f"""{_with_split()},
lng AS ({a} UNION ALL {b}),
m AS (SELECT feature,
        count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 0) AS n2,
        avg(value) FILTER (WHERE side = 1) AS m1, avg(value) FILTER (WHERE side = 0) AS m2,
        var_samp(value) FILTER (WHERE side = 1) AS v1, var_samp(value) FILTER (WHERE side = 0) AS v2
      FROM lng GROUP BY feature),
pairs AS (SELECT r.feature, sum(CASE WHEN r.value > s.value THEN 1 ELSE 0 END) AS gt,
                 sum(CASE WHEN r.value < s.value THEN 1 ELSE 0 END) AS lt
          FROM (SELECT * FROM lng WHERE side = 1) r JOIN (SELECT * FROM lng WHERE side = 0) s ON r.feature = s.feature
          GROUP BY r.feature),
e AS (SELECT m.feature,
        (m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0) AS d,
        (m1 - m2) / nullif(sqrt(v1), 0) AS glass_delta,
        (n1 + n2 - 2.0) AS dof,
        (gt - lt) / (CAST(n1 AS DOUBLE) * n2) AS cliff_delta
      FROM m JOIN pairs p ON m.feature = p.feature)
SELECT feature, d AS cohens_d,
  CASE WHEN d IS NULL OR isnan(d) THEN 'undefined' WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small'
       WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS d_interpretation,
  d * (1.0 - 3.0 / (4.0 * dof - 1.0)) AS hedges_g, glass_delta, cliff_delta,
  CASE WHEN cliff_delta IS NULL OR isnan(cliff_delta) THEN 'undefined' WHEN abs(cliff_delta) < 0.147 THEN 'negligible'
       WHEN abs(cliff_delta) < 0.33 THEN 'small' WHEN abs(cliff_delta) < 0.474 THEN 'medium' ELSE 'large' END AS delta_interpretation
FROM e"""
    return rounded(sql, ["cohens_d", "hedges_g", "glass_delta", "cliff_delta"])


def q_feature_auc() -> str:
    """AUC of every numeric feature as a score for the dropout label, by mid-ranks."""
    feats = [c for c in STUDENT_NUMERIC if c not in ("dropout", "final_grade")]
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in feats)
    sql = f"""{_with_split()},
lng AS (SELECT feature, value, dropout FROM (UNPIVOT (SELECT dropout, {sel} FROM st) ON {', '.join(feats)} INTO NAME feature VALUE value)),
rk AS (SELECT feature, dropout, rank() OVER (PARTITION BY feature ORDER BY value) AS r0,
              count(*) OVER (PARTITION BY feature, value) AS tie FROM lng),
u AS (SELECT feature, sum(CASE WHEN dropout = 1 THEN r0 + (tie - 1) / 2.0 ELSE 0 END) AS rsum,
             sum(CASE WHEN dropout = 1 THEN 1 ELSE 0 END) AS n_pos, sum(CASE WHEN dropout = 1 THEN 0 ELSE 1 END) AS n_neg
      FROM rk GROUP BY feature)
SELECT feature, (rsum - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) AS auc,
       greatest((rsum - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 1.0 - (rsum - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)) AS effective_auc,
       CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg
FROM u"""
    return rounded(sql, ["auc", "effective_auc"])


def q_spearman_importance() -> str:
    """Spearman rho between |corr(feature, final_grade)| on train and on test."""
    feats = [c for c in STUDENT_NUMERIC if c not in ("dropout", "final_grade")]
    rows_tr = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, final_grade)) AS imp FROM sts WHERE split = 'train'" for c in feats)
    rows_te = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, final_grade)) AS imp FROM sts WHERE split = 'test'" for c in feats)
    sql = f"""{_with_split()},
a AS ({rows_tr}), b AS ({rows_te}),
j AS (SELECT a.feature, a.imp AS ia, b.imp AS ib FROM a JOIN b ON a.feature = b.feature WHERE a.imp IS NOT NULL AND b.imp IS NOT NULL),
r AS (SELECT feature,
        rank() OVER (ORDER BY ia) + (count(*) OVER (PARTITION BY ia) - 1) / 2.0 AS ra,
        rank() OVER (ORDER BY ib) + (count(*) OVER (PARTITION BY ib) - 1) / 2.0 AS rb FROM j)
SELECT corr(ra, rb) AS spearman_rho, count(*) AS n_features FROM r"""
    return rounded(sql, ["spearman_rho"])


# ------------------------------------------------------------ losses and tests
def _losses_cte() -> str:
    return f"""{_with_split()},
tr AS (SELECT * FROM sts WHERE split = 'train'),
te AS (SELECT * FROM sts WHERE split = 'test'),
gm AS (SELECT avg(final_grade) AS gr, avg(dropout) AS gc FROM tr),
pg AS (SELECT nation, avg(final_grade) AS pr, avg(dropout) AS pc FROM tr GROUP BY nation),
tt AS (SELECT te.id_student AS row_id, te.final_grade AS y, CAST(te.dropout AS INTEGER) AS c,
              gm.gr, coalesce(pg.pr, gm.gr) AS pr, gm.gc, coalesce(pg.pc, gm.gc) AS pc
       FROM te CROSS JOIN gm LEFT JOIN pg ON te.nation = pg.nation),
losses AS (
  SELECT row_id, 'regression' AS task, 'global' AS model, gr AS score, y AS label, abs(y - gr) AS loss FROM tt
  UNION ALL SELECT row_id, 'regression', 'group', pr, y, abs(y - pr) FROM tt
  UNION ALL SELECT row_id, 'classification', 'global', gc, CAST(c AS DOUBLE),
               -ln(least(greatest(CASE WHEN c = 1 THEN gc ELSE 1 - gc END, 1e-15), 1.0)) FROM tt
  UNION ALL SELECT row_id, 'classification', 'group', pc, CAST(c AS DOUBLE),
               -ln(least(greatest(CASE WHEN c = 1 THEN pc ELSE 1 - pc END, 1e-15), 1.0)) FROM tt
)"""


def q_baseline_losses() -> str:
    return rounded(f"{_losses_cte()} SELECT * FROM losses", ["score", "label", "loss"])


def _draws(source: str, n_boot: int, seed: int, groups: str, cols: str, order: str) -> str:
    """CTEs ending in ``dr``: ``cols`` of the rows drawn for each rep, n draws of n rows of each group (one cell holds them
    all): draw j of rep takes the row at floor(u n), u the upper 32 bits of the mix of start + (rep 2^40 + j) * increment."""
    def times(z: str, m: int) -> str:
        return f"CAST(CAST({z} AS UHUGEINT) * CAST({m} AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"

    same = " AND ".join(f"rk.{c.strip()} = ng.{c.strip()}" for c in groups.split(","))
    sel = ", ".join(f"rk.{c.strip()}" for c in cols.split(","))
    start = stream_start(seed, 0)
    return f"""
rk AS (SELECT {cols}, row_number() OVER (PARTITION BY {groups} ORDER BY {order}CAST(row_id AS VARCHAR)) - 1 AS i FROM {source}),
ng AS (SELECT {groups}, count(*) AS n FROM rk GROUP BY {groups}),
dj AS (SELECT n, rep, j, CAST((CAST({start} AS UHUGEINT) + (CAST(rep AS UHUGEINT) * 1099511627776 + CAST(j AS UHUGEINT)) * CAST({GOLDEN} AS UHUGEINT))
         % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) AS z
       FROM (SELECT DISTINCT n FROM ng), (SELECT range AS rep FROM range({n_boot})) AS r, LATERAL (SELECT unnest(range(n)) AS j)),
z1 AS (SELECT n, rep, {times('xor(z, z >> 30)', MIX1)} AS z FROM dj),
z2 AS (SELECT n, rep, {times('xor(z, z >> 27)', MIX2)} AS z FROM z1),
pk AS (SELECT n, rep, CAST(((xor(z, z >> 31) >> 32) * CAST(n AS UBIGINT)) >> 32 AS BIGINT) AS i FROM z2),
wk AS (SELECT n, rep, i, count(*) AS w FROM pk GROUP BY n, rep, i),
dr AS (SELECT {sel}, rep, w, ng.n FROM ng JOIN rk ON {same} JOIN wk ON wk.n = ng.n AND wk.i = rk.i)"""


def _tests_from(pairs: str, groups: str, n_perm: int = 10000, seed: int = 0) -> str:
    """CTEs ending in ``tests``: sign-flip tests of ``pairs`` (row_id, groups, d); 128 sign bits per md5."""
    on = " AND ".join(f"x.{c.strip()} = obs.{c.strip()}" for c in groups.split(","))
    sel = ", ".join(f"obs.{c.strip()}" for c in groups.split(","))
    bit = "((strpos('0123456789abcdef', substr(h, (rep % 128) // 4 + 1, 1)) - 1) >> (3 - rep % 4)) & 1"
    return f"""
hs AS (SELECT {groups}, d, blk, md5('{seed}:' || blk || ':' || row_id) AS h FROM {pairs}, (SELECT range AS blk FROM range({-(-n_perm // 128)})) AS b),
obs AS (SELECT {groups}, sum(d) AS s, avg(d) AS mean_diff, count(*) AS n,
               CASE WHEN stddev_samp(d) = 0 THEN 0.0 ELSE avg(d) / stddev_samp(d) END AS cohens_d FROM {pairs} GROUP BY {groups}),
fl AS (SELECT {groups}, rep, sum(CASE WHEN {bit} = 1 THEN d ELSE -d END) AS s
       FROM hs JOIN (SELECT CAST(range AS INTEGER) AS rep FROM range({n_perm})) AS r ON rep // 128 = blk GROUP BY {groups}, rep),
tests AS (
SELECT {sel}, avg(CASE WHEN abs(x.s) >= abs(obs.s) * (1 - 1e-9) THEN 1.0 ELSE 0.0 END) AS p_value, any_value(mean_diff) AS mean_diff,
  any_value(cohens_d) AS cohens_d,
  any_value(CASE WHEN cohens_d IS NULL THEN 'undefined' WHEN abs(cohens_d) < 0.2 THEN 'negligible' WHEN abs(cohens_d) < 0.5 THEN 'small'
       WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END) AS effect_interpretation,
  any_value(n) AS n, {n_perm} AS n_permutations
FROM fl x JOIN obs ON {on} GROUP BY {sel})"""


def _perm_sql() -> str:
    return f"""{_losses_cte()},
pr AS (SELECT a.row_id, a.task, a.loss - b.loss AS d
       FROM (SELECT * FROM losses WHERE model = 'global') a
       JOIN (SELECT * FROM losses WHERE model = 'group') b ON a.row_id = b.row_id AND a.task = b.task),
{_tests_from('pr', 'task')}"""


def q_paired_permutation() -> str:
    return rounded(f"{_perm_sql()} SELECT * FROM tests", ["p_value", "mean_diff", "cohens_d"])


def q_bonferroni_tests() -> str:
    sql = (f"{_perm_sql()} SELECT *, (SELECT count(*) FROM tests) AS n_tests, "
           f"0.05 / (SELECT count(*) FROM tests) AS alpha_corrected, "
           f"p_value < 0.05 / (SELECT count(*) FROM tests) AS significant FROM tests")
    return rounded(sql, ["p_value", "mean_diff", "cohens_d", "alpha_corrected"])


def q_bootstrap_loss_ci(n_boot: int = 1000, seed: int = 0) -> str:
    sql = f"""{_losses_cte()},{_draws('losses', n_boot, seed, 'task, model', 'task, model, loss', '')},
rp AS (SELECT task, model, rep, n, sum(w * loss) / n AS m FROM dr GROUP BY task, model, rep, n)
SELECT task, model, avg(m) AS mean, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high,
       n AS n_samples, CAST(count(m) AS INTEGER) AS n_bootstrap
FROM rp WHERE rep < CASE WHEN n < 50 THEN {min(n_boot, 500)} ELSE {n_boot} END GROUP BY task, model, n"""
    return rounded(sql, ["mean", "ci_low", "ci_high"])


def _auc_ci(scored: str, groups: str, n_boot: int, seed: int) -> str:
    return f"""{_draws(scored, n_boot, seed, groups, groups + ', score, label', 'score, ')},
wt AS (SELECT {groups}, rep, score, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS wp, sum(CASE WHEN label = 1 THEN 0 ELSE w END) AS wn
       FROM dr GROUP BY {groups}, rep, score),
cu AS (SELECT {groups}, rep, wp, wn, sum(wn) OVER (PARTITION BY {groups}, rep ORDER BY score) - wn AS below FROM wt),
au AS (SELECT {groups}, rep, sum(wp * (below + 0.5 * wn)) / nullif(sum(wp) * sum(wn), 0) AS a FROM cu GROUP BY {groups}, rep)
SELECT {groups}, avg(a) AS mean, quantile_cont(a, 0.025) AS ci_low, quantile_cont(a, 0.975) AS ci_high, CAST(count(*) AS INTEGER) AS n_bootstrap
FROM au WHERE a IS NOT NULL GROUP BY {groups}"""


def q_bootstrap_auc_ci(n_boot: int = 1000, seed: int = 0) -> str:
    sql = f"""{_losses_cte()},
sc AS (SELECT model, row_id, score, label FROM losses WHERE task = 'classification'),
{_auc_ci('sc', 'model', n_boot, seed)}"""
    return rounded(sql, ["mean", "ci_low", "ci_high"])


def q_bootstrap_feature_auc_ci(n_boot: int = 200, seed: int = 1) -> str:
    """A continuous score and a heavily tied one."""
    sql = f"""WITH {STUDENT_CTE},
sc AS (SELECT 'acctbal' AS feature, id_student AS row_id, acctbal AS score, dropout AS label FROM st
       UNION ALL SELECT 'is_unregistered', id_student, is_unregistered, dropout FROM st),
{_auc_ci('sc', 'feature', n_boot, seed)}"""
    return rounded(sql, ["mean", "ci_low", "ci_high"])


def q_exact_quantiles() -> str:
    cols = STUDENT_NUMERIC
    probs = [0.0, 0.005, 0.5, 0.9, 1.0]
    parts = [f"SELECT '{c}' AS column_name, " + ", ".join(f"quantile_cont({c}, {p}) AS q{i}" for i, p in enumerate(probs)) + " FROM st" for c in cols]
    return rounded(f"WITH {STUDENT_CTE} " + " UNION ALL ".join(parts), [f"q{i}" for i in range(len(probs))])


# ------------------------------------------------------------ diagnostics and roll-ups
def q_leakage_screen() -> str:
    feats = [c for c in STUDENT_NUMERIC]
    parts = []
    for t in ["dropout", "final_grade"]:
        for f in feats:
            if f != t:
                parts.append(f"SELECT '{t}' AS target, '{f}' AS feature, abs(corr({f}, {t})) AS r FROM st")
    sql = f"""WITH {STUDENT_CTE}, lc AS ({' UNION ALL '.join(parts)})
SELECT target, max(r) AS max_abs_corr, arg_max(feature, r) AS max_feature, max(r) > 0.8 AS warn, max(r) >= 0.99 AS error
FROM lc WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY target"""
    return rounded(sql, ["max_abs_corr"])


def q_class_balance() -> str:
    sql = f"""WITH {STUDENT_CTE}, c AS (SELECT CAST(dropout AS VARCHAR) AS class, count(*) AS n FROM st GROUP BY dropout)
SELECT class, n, (SELECT CAST(min(n) AS DOUBLE) / max(n) FROM c) AS balance_ratio FROM c"""
    return rounded(sql, ["balance_ratio"])


def q_target_describe() -> str:
    sql = f"WITH {STUDENT_CTE} SELECT min(final_grade) AS min, max(final_grade) AS max, avg(final_grade) AS mean, stddev_samp(final_grade) AS std FROM st"
    return rounded(sql, ["min", "max", "mean", "std"])


def q_split_sizes() -> str:
    return f"{_with_split()} SELECT split, count(*) AS n_rows FROM sts GROUP BY split"


def q_coverage_diagnostic() -> str:
    sql = f"""WITH {INTERACTION_CTE}
SELECT count(*) AS n_users, count(*) FILTER (WHERE n_total >= 20) AS n_full_window,
       avg(CASE WHEN n_total >= 20 THEN 1.0 ELSE 0.0 END) AS share_full_window,
       avg(CASE WHEN n_total >= (SELECT thr FROM ev_thr) THEN 1.0 ELSE 0.0 END) AS share_high_engagement,
       median(n_total) AS engagement_threshold
FROM ev_tot"""
    return rounded(sql, ["share_full_window", "share_high_engagement", "engagement_threshold"])


METRICS_CTE = """
mw AS (
  SELECT event_type AS synthesizer, dayofweek(ts) AS seed,
         avg(value) AS mean_value, CAST(count(*) AS DOUBLE) AS n_events,
         avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS mean_k,
         avg(CASE WHEN value > 300.0 THEN value END) AS high_value_mean
  FROM events GROUP BY event_type, dayofweek(ts)
),
metrics AS (
  SELECT 'events' AS dataset, synthesizer, CAST(seed AS INTEGER) AS seed, metric, value FROM (
    SELECT synthesizer, seed, 'mean_value' AS metric, mean_value AS value FROM mw
    UNION ALL SELECT synthesizer, seed, 'n_events', n_events FROM mw
    UNION ALL SELECT synthesizer, seed, 'mean_k', mean_k FROM mw
    UNION ALL SELECT synthesizer, seed, 'high_value_mean', high_value_mean FROM mw)
)"""


def q_seed_rollup() -> str:
    sql = f"""WITH {METRICS_CTE}
SELECT dataset, synthesizer, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS std, count(*) AS n_observed
FROM metrics WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY dataset, synthesizer, metric"""
    return rounded(sql, ["mean", "std"])


def q_chart_rollup() -> str:
    sql = f"""WITH {METRICS_CTE}
SELECT dataset, synthesizer, metric, avg(value) AS mean, stddev_pop(value) AS std_pop
FROM metrics WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY dataset, synthesizer, metric"""
    return rounded(sql, ["mean", "std_pop"])


def q_seeds_observed() -> str:
    return f"WITH {METRICS_CTE} SELECT dataset, count(DISTINCT seed) AS seeds_observed, 7 AS seeds_requested FROM metrics GROUP BY dataset"


def q_missing_metrics() -> str:
    return f"""WITH {METRICS_CTE},
grid AS (SELECT p.dataset, p.synthesizer, CAST(s.range AS INTEGER) AS seed, m.metric
         FROM (SELECT DISTINCT dataset, synthesizer FROM metrics) p, range(7) s,
              (VALUES ('mean_value'), ('n_events'), ('mean_k'), ('high_value_mean')) m(metric))
SELECT g.* FROM grid g WHERE NOT EXISTS (
  SELECT 1 FROM metrics o WHERE o.value IS NOT NULL AND NOT isnan(o.value)
    AND o.dataset = g.dataset AND o.synthesizer = g.synthesizer AND o.seed = g.seed AND o.metric = g.metric)"""


def q_timing_summary() -> str:
    sql = """SELECT event_type AS operation, count(*) AS count, avg(value) AS mean, median(value) AS median,
       min(value) AS min, max(value) AS max, sum(value) AS total, sum(value) / 60.0 AS total_minutes
FROM events GROUP BY event_type"""
    return rounded(sql, ["mean", "median", "min", "max", "total", "total_minutes"])


def q_performance_matrix() -> str:
    sql = f"""WITH {METRICS_CTE},
r AS (SELECT dataset, synthesizer, metric, avg(value) AS mean FROM metrics
      WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY dataset, synthesizer, metric)
SELECT dataset, synthesizer,
  max(CASE WHEN metric = 'mean_value' THEN mean END) AS mean_value,
  max(CASE WHEN metric = 'n_events' THEN mean END) AS n_events,
  max(CASE WHEN metric = 'mean_k' THEN mean END) AS mean_k,
  max(CASE WHEN metric = 'high_value_mean' THEN mean END) AS high_value_mean
FROM r GROUP BY dataset, synthesizer"""
    return rounded(sql, ["mean_value", "n_events", "mean_k", "high_value_mean"])


# ------------------------------------------------------------ nearest neighbours
def _role_sql() -> str:
    u = f"({sql_h52('0', 'vec_id')} / 4503599627370496.0)"
    return f"CASE WHEN {u} < 1.0 / 3 THEN 'member' WHEN {u} < 2.0 / 3 THEN 'nonmember' ELSE 'synthetic' END"


def q_knn_distances() -> str:
    sql = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, {_role_sql()} AS role FROM embeddings),
q AS (SELECT * FROM e WHERE role <> 'synthetic'), r AS (SELECT * FROM e WHERE role = 'synthetic'),
d AS (SELECT q.vec_id, q.role, list_distance(q.v, r.v) AS dist FROM q, r),
k AS (SELECT vec_id, role, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS rn FROM d)
SELECT vec_id, role, min(dist) AS d_min, avg(dist) AS d_mean_k FROM k WHERE rn <= 5 GROUP BY vec_id, role"""
    return rounded(sql, ["d_min", "d_mean_k"])


def q_streaming_click_features() -> str:
    sql = """SELECT user_id AS id_student, CAST(sum(CAST(value AS DECIMAL(28, 9))) AS DOUBLE) AS total_vle_clicks, count(*) AS n_vle_records,
       count(DISTINCT event_type) AS n_vle_sites, count(DISTINCT CAST(ts AS DATE)) AS n_vle_days,
       CAST(sum(CAST(value AS DECIMAL(28, 9))) AS DOUBLE) / count(*) AS mean_vle_clicks,
       CAST(sum(CAST(value AS DECIMAL(28, 9))) AS DOUBLE) / count(DISTINCT CAST(ts AS DATE)) AS clicks_per_active_day
FROM events GROUP BY user_id"""
    return rounded(sql, ["total_vle_clicks", "mean_vle_clicks", "clicks_per_active_day"])


def q_consolidated_slice() -> str:
    sql = f"""{_with_split()}
SELECT id_student, nation, final_grade, dropout, split, 'real' AS synthesizer FROM sts WHERE split = 'test'"""
    return rounded(sql, ["final_grade", "dropout"])
