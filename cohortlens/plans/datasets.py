"""Datasets by name, from raw CSV folders to student tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.plans.interaction_table import build_interaction_table, clean_headers, keep_expected
from cohortlens.plans.student_table import StudentInputs, build_student_table
from cohortlens.roles import TableRoles
from cohortlens.sources.files import largest_csv, load_export, read_csv

KEYS = ("code_module", "code_presentation", "id_student")


def student_table_from_export(spark: SparkSession, raw_dir: str, *, min_click_clip: float = 0.0) -> tuple[DataFrame, TableRoles]:
    """G1 from the CSV export of the learning platform."""
    t = load_export(spark, raw_dir)
    inputs = StudentInputs(info=t["studentinfo"], registration=t["studentregistration"], clicks=t["studentvle"],
                           submissions=t["studentassessment"].select("id_assessment", "id_student", "score"),
                           assessments=t["assessments"], keys=KEYS)
    return build_student_table(inputs, min_click_clip=min_click_clip)


def interaction_table_from_log(spark: SparkSession, raw_dir: str) -> tuple[DataFrame, TableRoles]:
    """G2 from the largest CSV of a folder (ISO-8859-15).

    Rows of a user are in the order of ``order_id``, or in file order without it."""
    log = clean_headers(read_csv(spark, largest_csv(spark, raw_dir), latin9=True))
    order = ["order_id"] if "order_id" in log.columns else ["_place"]
    log = keep_expected(log.withColumn("_place", F.monotonically_increasing_id()), extra=("order_id", "_place"))
    casts = {"user_id": "bigint", "correct": "double", "order_id": "bigint", "hint_count": "double", "attempt_count": "double",
             "ms_first_response": "double"}
    log = log.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in log.columns])
    return build_interaction_table(log, order_cols=order)


#: dataset name -> builder
DATASETS = {"oulad": student_table_from_export, "assistments": interaction_table_from_log}


def build_dataset(spark: SparkSession, name: str, raw_dir: str) -> tuple[DataFrame, TableRoles]:
    """A dataset by name; its own sub-folder of ``raw_dir`` goes before ``raw_dir`` itself."""
    build = DATASETS.get(name.lower())
    if build is None:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}")
    own = f"{raw_dir.rstrip('/')}/{name.lower()}"
    try:
        return build(spark, own)
    except FileNotFoundError as e:
        if f"no folder {own}" not in str(e):
            raise
    return build(spark, raw_dir)
