"""User-level table from a tutoring interaction log.

Label = engagement from ALL of a user's interactions (count >= global
median); features come from the first K interactions only.

Plan shape: the row number is the only window in its sub-plan, so Catalyst
turns ``rn <= K`` into a partial ``WindowGroupLimit`` before the shuffle;
each map task forwards at most K rows per user and a user with a third of
the log never lands whole in one task.  The full count per user is a
separate partial/final hash aggregate, and the median is one scalar row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.roles import TableRoles

EARLY_WINDOW_K = 20
# Feature defaults when the source column is missing
# (unique_skills 1, hint_rate 0, avg_attempts 1, avg_response_time 0).
OPTIONAL_FEATURES = [
    ("unique_skills", "skill_id", "distinct", 1.0),
    ("hint_rate", "hint_count", "mean", 0.0),
    ("avg_attempts", "attempt_count", "mean", 1.0),
    ("avg_response_time", "ms_first_response", "mean", 0.0),
]


def clean_headers(df: DataFrame) -> DataFrame:
    """Strip, lower, space -> underscore."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Raise when a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"interaction log missing required columns: {missing}")


# The columns of the interaction log that are kept when present.
EXPECTED_COLS = [
    "user_id", "problem_id", "skill_id", "original", "attempt_count", "ms_first_response", "tutor_mode", "answer_type", "type", "hint_count",
    "hint_total", "overlap_time", "template_id", "first_action", "bottom_hint", "opportunity", "opportunity_original", "position", "correct",
]


def keep_expected(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Required columns must be there; of the others only the expected ones stay."""
    require_columns(df, ["user_id", "correct"])
    return df.select(*[c for c in df.columns if c in EXPECTED_COLS or c in extra])


def early_rows(log: DataFrame, order_cols: list[str], k: int) -> DataFrame:
    """W1 + P11: first ``k`` rows of each user by an explicit, total order."""
    w = Window.partitionBy("user_id").orderBy(*[F.col(c).asc() for c in order_cols])
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def user_totals(log: DataFrame) -> DataFrame:
    """A5: interactions per user."""
    return log.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n_interactions_total"))


def engagement_labels(totals: DataFrame) -> DataFrame:
    """label = total >= exact global median (a scalar subquery)."""
    thr = totals.agg(F.median("n_interactions_total")).scalar()
    return totals.withColumn("high_engagement", (F.col("n_interactions_total") >= thr).cast("int"))


def early_features(early: DataFrame) -> DataFrame:
    """Features of the early window, schema-driven defaults."""
    aggs = [
        F.count(F.lit(1)).cast("double").alias("n_interactions_early"),
        F.avg(F.col("correct").cast("double")).alias("student_pct_correct"),
    ]
    for name, src, kind, default in OPTIONAL_FEATURES:
        if src not in early.columns:
            aggs.append(F.lit(default).alias(name))
        elif kind == "distinct":
            aggs.append(F.count_distinct(src).cast("double").alias(name))
        else:
            aggs.append(F.avg(F.col(src).cast("double")).alias(name))
    return early.groupBy("user_id").agg(*aggs)


def build_interaction_table(log: DataFrame, *, order_cols: list[str], k: int = EARLY_WINDOW_K) -> tuple[DataFrame, TableRoles]:
    require_columns(log, ["user_id", "correct"])
    # Truncating int cast; a NULL 'correct' is an error as in the source.
    log = log.withColumn(
        "correct",
        F.when(F.col("correct").isNull(), F.raise_error(F.lit("correct has NULL values"))).otherwise(F.col("correct").cast("int")),
    )
    labels = engagement_labels(user_totals(log))
    feats = early_features(early_rows(log, order_cols, k))
    out = feats.join(labels, "user_id", "inner")  # J3
    out = out.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        "student_pct_correct", "unique_skills", "hint_rate", "avg_attempts", "avg_response_time",
        "high_engagement",
    )
    roles = TableRoles(id_cols=("user_id",), group_col="user_id", target_cols=("high_engagement", "student_pct_correct"), categorical_cols=())
    return out, roles


def coverage_diagnostic(log: DataFrame, k: int = EARLY_WINDOW_K) -> DataFrame:
    """Users, users with >= k rows and their share, label share."""
    lab = engagement_labels(user_totals(log))
    return lab.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if(F.col("n_interactions_total") >= k).alias("n_full_window"),
        F.avg((F.col("n_interactions_total") >= k).cast("double")).alias("share_full_window"),
        F.avg(F.col("high_engagement").cast("double")).alias("share_high_engagement"),
        F.median("n_interactions_total").alias("engagement_threshold"),
    )


# Fixed values of the stand-in binding: event types that count as a correct answer.
CORRECT_EVENT_TYPES = ["purchase", "signup"]


def standin_log(t) -> DataFrame:
    """events -> interaction log (order = ts, event_id; skill = event_type;
    correct = purchase/signup; hints = props.k; response = value)."""
    e = t.events
    return e.select(
        F.col("user_id"),
        F.col("ts").alias("order_ts"),
        F.col("event_id").alias("order_id"),
        F.col("event_type").alias("skill_id"),
        F.col("event_type").isin(CORRECT_EVENT_TYPES).cast("int").alias("correct"),
        F.get_json_object("props", "$.k").cast("int").alias("hint_count"),
        F.col("value").alias("ms_first_response"),
    )


def standin_interaction_table(t, k: int = EARLY_WINDOW_K) -> tuple[DataFrame, TableRoles]:
    return build_interaction_table(standin_log(t), order_cols=["order_ts", "order_id"], k=k)
