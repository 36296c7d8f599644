"""G1: student-level table from a learning-platform export.

One lazy plan.  Every side table is aggregated to the student key before
it meets the student list, so no join multiplies rows, and all sides are
hash-partitioned on the same key, which lets the star of left joins reuse
the aggregation exchanges instead of shuffling again.

Inputs (column names of the export, FIXTURES F1):
  info          keys + categoricals + numerics + outcome text
  registration  keys, date_registration, date_unregistration
  clicks        keys, id_site, date, sum_click            (the big log)
  submissions   id_assessment, id_student, score
  assessments   id_assessment, <keys other than id_student>, weight
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.exprs import clip_lower, label_from_text, safe_div
from cohortlens.roles import TableRoles

# Fixed values of the source format: outcome texts that mean "did not complete".
NEGATIVE_OUTCOMES = ["withdrawn", "fail"]

# Column names of the student table.
CLICK_COLS = ["total_vle_clicks", "n_vle_records", "n_vle_sites", "n_vle_days", "mean_vle_clicks", "clicks_per_active_day"]
GRADE_COLS = ["n_assessments", "final_grade"]
LEAKAGE_COLS = ["weighted_score_sum", "total_weight", "mean_score"]


@dataclass(frozen=True)
class StudentInputs:
    info: DataFrame
    registration: DataFrame
    clicks: DataFrame
    submissions: DataFrame
    assessments: DataFrame
    keys: tuple[str, ...] = ("code_module", "code_presentation", "id_student")
    # fixed values: the categories of the source format
    categorical_cols: tuple[str, ...] = (
        "code_module", "code_presentation", "gender", "region",
        "highest_education", "imd_band", "age_band", "disability",
    )
    outcome_col: str = "final_result"
    student_col: str = "id_student"


def registration_features(reg: DataFrame, keys: list[str]) -> DataFrame:
    """A1 + P2: earliest registration / unregistration per key; the flag is
    taken here, before the left join, so a student without a registration
    row ends up NULL (imputed later)."""
    return (
        reg.groupBy(*keys)
        .agg(F.min("date_registration").alias("date_registration"),
             F.min("date_unregistration").alias("date_unregistration"))
        .withColumn("is_unregistered", F.col("date_unregistration").isNotNull().cast("int"))
    )


def click_features(clicks: DataFrame, keys: list[str], min_clip: float = 0.0) -> DataFrame:
    """A2 + A3 + P6: sum, rows, exact distinct sites and days per key.

    Partial aggregation runs map-side; the first shuffle is on (key, site,
    day), so one very active student is spread over many tasks.
    """
    clk = F.col("sum_click")
    if min_clip > 0.0:
        clk = clip_lower(clk, min_clip)
    # one row per (key, site, day) first: the distinct counts then expand few rows, not the log;
    # decimal sums are exact, so the order of rows does not show in the last digit
    daily = clicks.groupBy(*keys, "id_site", "date").agg(F.sum(clk.cast("decimal(28,9)")).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    agg = daily.groupBy(*keys).agg(
        F.sum("_sum").cast("double").alias("total_vle_clicks"),
        F.sum("_n").alias("n_vle_records"),
        F.count_distinct("id_site").alias("n_vle_sites"),
        F.count_distinct("date").alias("n_vle_days"),
    )
    return agg.select(
        *keys, "total_vle_clicks", "n_vle_records", "n_vle_sites", "n_vle_days",
        safe_div(F.col("total_vle_clicks"), F.col("n_vle_records")).alias("mean_vle_clicks"),
        safe_div(F.col("total_vle_clicks"), F.col("n_vle_days")).alias("clicks_per_active_day"),
    )


def grade_features(sub: DataFrame, meta: DataFrame, keys: list[str], student_col: str) -> DataFrame:
    """J1 + A4 + P5 + P6: attach assessment metadata to each submission
    (left join, before aggregating), then weighted grade per key."""
    other = [k for k in keys if k != student_col]
    m = meta.select("id_assessment", *other, "weight")
    j = sub.join(m, "id_assessment", "left")
    # summed as decimals: exact, so the grade does not depend on the order of rows
    sw = (F.col("score") * F.col("weight")).cast("decimal(28,9)")
    agg = j.groupBy(*keys).agg(
        F.count_distinct("id_assessment").alias("n_assessments"),
        F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("total_weight"),
        F.coalesce(F.sum(sw), F.lit(0)).cast("double").alias("weighted_score_sum"),
        F.avg("score").alias("mean_score"),
    )
    return agg.withColumn("final_grade", safe_div(F.col("weighted_score_sum"), F.col("total_weight")))


def build_student_table(inp: StudentInputs, *, min_click_clip: float = 0.0) -> tuple[DataFrame, TableRoles]:
    keys = list(inp.keys)
    info = inp.info.withColumn("dropout", label_from_text(F.col(inp.outcome_col), NEGATIVE_OUTCOMES))
    reg = registration_features(inp.registration, keys)
    clk = click_features(inp.clicks, keys, min_click_clip)
    grd = grade_features(inp.submissions, inp.assessments, keys, inp.student_col)

    # Star of left joins on the key, each side already one row per key.
    df = info.join(reg, keys, "left").join(clk, keys, "left").join(grd, keys, "left")
    df = df.drop(inp.outcome_col, *LEAKAGE_COLS)  # P10

    cats = [c for c in inp.categorical_cols if c in df.columns]
    # Widen ints/bools to double, keys and categoricals excepted.
    sel = []
    for f in df.schema.fields:
        if f.name in keys or f.name in cats:
            sel.append(F.col(f.name))
        elif isinstance(f.dataType, (T.IntegralType, T.BooleanType, T.FloatType, T.DecimalType)):
            sel.append(F.col(f.name).cast("double").alias(f.name))
        else:
            sel.append(F.col(f.name))
    df = df.select(*sel)
    # P8 + P9: fills.
    fills = {c: 0.0 for c in CLICK_COLS + GRADE_COLS if c in df.columns}
    if "date_unregistration" in df.columns:
        fills["date_unregistration"] = -999.0
    df = df.fillna(fills)
    if cats:
        df = df.fillna("Unknown", subset=cats)

    roles = TableRoles(
        id_cols=tuple(keys),
        group_col=inp.student_col,
        target_cols=("dropout", "final_grade"),
        categorical_cols=tuple(cats),
    )
    return df, roles


# --------------------------------------------------------------------------
# Binding to the provided star-schema tables
# --------------------------------------------------------------------------

# Fixed values of the stand-in binding: day zero of the registration offsets
# and the order status that counts as unregistration.  Segments BUILDING and
# AUTOMOBILE play the "Withdrawn" and "Fail" outcomes.
REGISTRATION_EPOCH = "1992-01-01"
UNREGISTERED_STATUS = "F"


def standin_inputs(t) -> StudentInputs:
    """Map ``customer/orders/events/lineitem/part`` onto the export shape.

    student = customer; registration = orders (day offsets); click log =
    events (site = event_type, day = calendar day, clicks = value);
    submissions = lineitem rows of the customer's orders (assessment =
    part, score = extended price / 1000); assessment weight = part size.
    """
    seg = F.col("c_mktsegment")
    outcome = F.when(seg == "BUILDING", F.lit("Withdrawn")).when(seg == "AUTOMOBILE", F.lit("Fail")).otherwise(F.lit("Pass"))
    info = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("c_custkey").alias("id_student"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
            F.col("c_acctbal").alias("acctbal"),
            outcome.alias("final_result"),
        )
    )
    day = F.datediff(F.to_date("o_orderdate"), F.lit(REGISTRATION_EPOCH))
    registration = t.orders.select(
        F.col("o_custkey").alias("id_student"),
        day.alias("date_registration"),
        F.when(F.col("o_orderstatus") == UNREGISTERED_STATUS, day).alias("date_unregistration"),
    )
    clicks = t.events.select(
        F.col("user_id").alias("id_student"),
        F.col("event_type").alias("id_site"),
        F.to_date("ts").alias("date"),
        F.col("value").alias("sum_click"),
    )
    submissions = (
        t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_partkey").alias("id_assessment"),
            F.col("o_custkey").alias("id_student"),
            (F.col("l_extendedprice") / F.lit(1000.0)).alias("score"),
        )
    )
    assessments = t.part.select(F.col("p_partkey").alias("id_assessment"), F.col("p_size").alias("weight"))
    return StudentInputs(
        info=info, registration=registration, clicks=clicks, submissions=submissions,
        assessments=assessments, keys=("id_student",), categorical_cols=("nation", "region"),
    )


def standin_student_table(t, *, min_click_clip: float = 0.0) -> tuple[DataFrame, TableRoles]:
    return build_student_table(standin_inputs(t), min_click_clip=min_click_clip)
