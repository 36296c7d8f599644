"""Per-row loss tables (F6 ``losses``) and the tests run on them.

The evaluation jobs produce one loss per (test row, model, task); paired
tests join two loss columns by row (J6).  ``baseline_losses`` builds such
a table from two closed-form predictors fitted on the train part --
the overall mean / rate, and the mean / rate per category -- so the
paired machinery can be checked against plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import log_loss
from cohortlens.functions.hashing import h52


def baseline_losses(split_df: DataFrame, *, key: str, group_col: str, reg_target: str, cls_target: str) -> DataFrame:
    """(row_id, task, model, score, label, loss) for the test rows."""
    train = split_df.where(F.col("split") == "train")
    test = split_df.where(F.col("split") == "test")
    g_reg = train.agg(F.avg(reg_target)).scalar()
    g_cls = train.agg(F.avg(F.col(cls_target).cast("double"))).scalar()
    per_group = train.groupBy(group_col).agg(F.avg(reg_target).alias("_pr"), F.avg(F.col(cls_target).cast("double")).alias("_pc"))
    t = test.join(per_group, group_col, "left").select(
        F.col(key).alias("row_id"), F.col(reg_target).alias("_y"), F.col(cls_target).cast("int").alias("_c"),
        g_reg.alias("_gr"), F.coalesce("_pr", g_reg).alias("_pr"), g_cls.alias("_gc"), F.coalesce("_pc", g_cls).alias("_pc"))
    rows = F.array(
        F.struct(F.lit("regression").alias("task"), F.lit("global").alias("model"), F.col("_gr").alias("score"), F.col("_y").alias("label"), F.abs(F.col("_y") - F.col("_gr")).alias("loss")),
        F.struct(F.lit("regression").alias("task"), F.lit("group").alias("model"), F.col("_pr").alias("score"), F.col("_y").alias("label"), F.abs(F.col("_y") - F.col("_pr")).alias("loss")),
        F.struct(F.lit("classification").alias("task"), F.lit("global").alias("model"), F.col("_gc").alias("score"), F.col("_c").cast("double").alias("label"), log_loss(F.col("_gc"), F.col("_c")).alias("loss")),
        F.struct(F.lit("classification").alias("task"), F.lit("group").alias("model"), F.col("_pc").alias("score"), F.col("_c").cast("double").alias("label"), log_loss(F.col("_pc"), F.col("_c")).alias("loss")),
    )
    return t.select("row_id", F.explode(rows).alias("r")).select("row_id", "r.task", "r.model", "r.score", "r.label", "r.loss")


def paired(losses: DataFrame, model_a: str, model_b: str, on: tuple[str, ...] = ("row_id", "task")) -> DataFrame:
    """One row per (row, task) with the losses of two models side by side (one pass, no self-join)."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("loss")))
    both = losses.where(F.col("model").isin(model_a, model_b)).groupBy(*on).agg(pick(model_a).alias("loss_a"), pick(model_b).alias("loss_b"))
    return both.where(F.col("loss_a").isNotNull() & F.col("loss_b").isNotNull())


REAL = "real"
SYNTHESIZERS = ["syn_a", "syn_b", "syn_c"]


def grid_losses(split_df: DataFrame, *, key: str, models: tuple[str, ...], reg_target: str, cls_target: str) -> DataFrame:
    """(row_id, task, synthesizer, model, loss): closed-form stand-ins of the evaluation grid.

    Three seeded thirds of the train part stand for three synthetic tables,
    the whole train part for the real one; a model predicts the mean (rate)
    of its column's value, or of the whole part where it has not seen the value.
    """
    third = F.element_at(F.array(*map(F.lit, SYNTHESIZERS)), (h52(5, F.col(key)) % 3 + 1).cast("int"))
    train = split_df.where(F.col("split") == "train").select(
        F.explode(F.array(third, F.lit(REAL))).alias("synthesizer"), *models, F.col(reg_target).alias("_r"), F.col(cls_target).cast("double").alias("_c"))
    whole = train.groupBy("synthesizer").agg(F.avg("_r").alias("_gr"), F.avg("_c").alias("_gc"))
    test = split_df.where(F.col("split") == "test").select(
        F.col(key).alias("row_id"), *models, F.col(reg_target).alias("_y"), F.col(cls_target).cast("int").alias("_l"),
        F.explode(F.array(*map(F.lit, [*SYNTHESIZERS, REAL]))).alias("synthesizer")).join(whole, "synthesizer")
    rows = []
    for m in models:
        seen = train.groupBy("synthesizer", m).agg(F.avg("_r").alias(f"_r_{m}"), F.avg("_c").alias(f"_c_{m}"))
        test = test.join(seen, ["synthesizer", m], "left")
        reg, rate = F.coalesce(f"_r_{m}", "_gr"), F.coalesce(f"_c_{m}", "_gc")
        rows += [F.struct(F.lit("regression").alias("task"), F.lit(m).alias("model"), F.abs(F.col("_y") - reg).alias("loss")),
                 F.struct(F.lit("classification").alias("task"), F.lit(m).alias("model"), log_loss(rate, F.col("_l")).alias("loss"))]
    return test.select("row_id", "synthesizer", F.explode(F.array(*rows)).alias("r")).select("row_id", "synthesizer", "r.task", "r.model", "r.loss")


def synthesizer_pairs(losses: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(row_id, task, model, first, second, loss_a, loss_b) of every pair of synthesizers."""
    names = names or SYNTHESIZERS
    wide = losses.groupBy("row_id", "task", "model").pivot("synthesizer", names).agg(F.first("loss"))
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("loss_a"), F.col(b).alias("loss_b"))
             for i, a in enumerate(names) for b in names[i + 1 :]]
    out = wide.select("row_id", "task", "model", F.explode(F.array(*pairs)).alias("p")).select("row_id", "task", "model", "p.*")
    return out.where(F.col("loss_a").isNotNull() & F.col("loss_b").isNotNull())


def regime_pairs(losses: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(row_id, task, model, synthesizer, loss_a, loss_b): trained on synthetic against trained on real."""
    names = names or SYNTHESIZERS
    wide = losses.groupBy("row_id", "task", "model").pivot("synthesizer", [*names, REAL]).agg(F.first("loss"))
    gaps = [F.struct(F.lit(a).alias("synthesizer"), F.col(a).alias("loss_a"), F.col(REAL).alias("loss_b")) for a in names]
    out = wide.select("row_id", "task", "model", F.explode(F.array(*gaps)).alias("p")).select("row_id", "task", "model", "p.*")
    return out.where(F.col("loss_a").isNotNull() & F.col("loss_b").isNotNull())
