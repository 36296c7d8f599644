"""Raw CSV folders to tables, result documents, the seed loop, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import report as P
from cohortlens.operators.models import ForestParams
from cohortlens.plans.datasets import build_dataset
from cohortlens.plans.jobs import run_seeds, write_chart_tables
from cohortlens.sources.files import METRIC_PATHS, find_csv, largest_csv, read_csv, read_results, results_to_metrics
from cohortlens.sources.sinks import read_slice, write_consolidated, write_json_document
from cohortlens.streaming.clicks import run_incremental

INFO = "id_student,code_module,code_presentation,gender,region,highest_education,imd_band,age_band,disability,final_result\n"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """A small export with shuffled headers and students with two presentations."""
    d = tmp_path_factory.mktemp("raw")
    own = d / "oulad" / "deep"
    own.mkdir(parents=True)
    rows = [(i // 2, ["AAA", "BBB"][i % 2], "2013J", "MF"[i % 2], f"R{i % 3}", "HE", ["0-10%", ""][i % 5 == 0], "0-35", "NY"[i % 2],
             ["Pass", "Fail", "Withdrawn", "Distinction"][i % 4]) for i in range(120)]
    (own / "studentInfo.csv").write_text(INFO + "".join(",".join(map(str, r)) + "\n" for r in rows))
    (own / "studentRegistration.csv").write_text("code_module,code_presentation,id_student,date_registration,date_unregistration\n"
                                                 + "".join(f"{r[1]},2013J,{r[0]},-{i},{i if i % 4 == 2 else ''}\n" for i, r in enumerate(rows)))
    (own / "studentVle.csv").write_text("date,id_site,sum_click,code_presentation,code_module,id_student\n"
                                        + "".join(f"{k},{100 + k % 3},{(i * 7 + k) % 11},2013J,{r[1]},{r[0]}\n" for i, r in enumerate(rows) for k in range(i % 6)))
    (own / "assessments.csv").write_text("code_module,code_presentation,id_assessment,weight\n" + "AAA,2013J,1,40\nBBB,2013J,2,60\n")
    (own / "studentAssessment.csv").write_text("id_assessment,id_student,score\n" + "".join(f"{1 + i % 2},{r[0]},{(i * 13) % 100}\n" for i, r in enumerate(rows)))
    return d


def test_export_by_name(spark, raw):
    table, roles = build_dataset(spark, "OULAD", str(raw))
    assert table.count() == 120 and roles.id_cols == ("code_module", "code_presentation", "id_student")
    r = table.where("id_student = 2 AND code_module = 'BBB'").first()  # row 5: five clicks over three sites, shuffled headers
    assert (r["n_vle_records"], r["n_vle_sites"], r["n_vle_days"]) == (5.0, 3.0, 5.0)
    assert r["total_vle_clicks"] == sum((35 + k) % 11 for k in range(5)) and r["final_grade"] == 65.0
    assert table.where("id_student = 0 AND code_module = 'AAA'").first()["imd_band"] == "Unknown"


def test_lookup_errors(spark, raw, tmp_path):
    with pytest.raises(ValueError, match="unknown dataset"):
        build_dataset(spark, "other", str(raw))
    with pytest.raises(FileNotFoundError):
        build_dataset(spark, "oulad", str(tmp_path / "nowhere"))
    for sub in ("a", "b"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "Same.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="several files"):
        find_csv(spark, str(tmp_path), "same")
    with pytest.raises(ValueError, match="lacks columns"):
        read_csv(spark, str(tmp_path / "a" / "Same.csv"), "x int, y int")


def test_tutoring_log_by_name(spark, tmp_path):
    (tmp_path / "small.csv").write_text("a\n1\n")
    lines = "".join(f"{u},{u * 100 + i},{i % 2},s{i % 3},café €\n" for u, n in ((1, 5), (2, 25), (3, 30)) for i in range(n))
    (tmp_path / "log.csv").write_bytes(("User ID,Order ID, Correct ,Skill ID,Other\n" + lines).encode("iso-8859-15"))
    assert largest_csv(spark, str(tmp_path)).endswith("log.csv")
    assert read_csv(spark, str(tmp_path / "log.csv"), latin9=True).first()["Other"] == "café €"
    table, roles = build_dataset(spark, "assistments", str(tmp_path))
    got = {r["user_id"]: r for r in table.collect()}
    assert got[3]["student_pct_correct"] == 0.5 and got[3]["unique_skills"] == 3.0 and got[1]["high_engagement"] == 0
    assert roles.target_cols == ("high_engagement", "student_pct_correct")


def test_result_document_round_trip(spark, tmp_path):
    doc = {"dataset": "d", "seed": 3, "synthesizers": {"g": {
        "sdmetrics": {"overall_score": 0.8}, "c2st": {"effective_auc": 0.62},
        "mia": {"worst_case_effective_auc": 0.53, "attackers": {"lr": {"effective_auc": 0.53}}},
        "utility": {"classification": {"trtr_rf_auc": 0.8, "rf_auc": 0.78, "rf_auc_ci": {"ci_low": 0.76, "ci_high": 0.8}},
                    "regression": {"trtr_ridge_mae": 12.0, "ridge_mae": 11.0, "ridge_mae_ci": {"ci_low": 10.0, "ci_high": 12.0}}},
        "shap": {"classification": {"rank_correlation": {"spearman_rho": 0.9, "p_value": 0.01, "n_features": 8}}},
        "timing": {"fit_seconds": 1.0, "total_seconds": 2.0}}}}
    write_json_document(spark, doc, str(tmp_path / "results.json"))
    got = {r.metric: r.value for r in results_to_metrics(read_results(spark, str(tmp_path / "results.json"))).collect()}
    assert set(got) == set(METRIC_PATHS) >= set(P.SUMMARY_METRICS)
    assert got["tstr_cls_rf_auc"] == 0.78 and got["tstr_cls_rf_auc_ci_low"] == 0.76 and got["shap_spearman_rho_cls"] == 0.9
    assert got["timing_total_seconds"] == 2.0 and got["tstr_cls_lr_auc"] is None


def test_consolidated_overwrite(spark, tmp_path):
    a, b = (spark.range(n).withColumn("x", F.lit(n)) for n in (3, 5))
    write_consolidated({("train", "real"): a, ("train", "syn"): b}, str(tmp_path / "t"))
    write_consolidated({("train", "syn"): a}, str(tmp_path / "t"))
    assert read_slice(spark, str(tmp_path / "t"), "train", "syn").count() == 3
    assert read_slice(spark, str(tmp_path / "t"), "train", "real").count() == 3


@pytest.mark.parametrize("most_deltas", [16, 1])
def test_stream_resumes_and_equals_batch(spark, tmp_path, most_deltas):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    rows = [(i % 7 if i % 3 else 0, f"s{i % 4}" if i % 11 else None, f"2024-01-0{1 + i % 5}", float(i)) for i in range(300)]
    schema = "id_student long, id_site string, date string, sum_click double"
    read, states = [], []
    for n, part in enumerate((rows[:120], rows[120:220], rows[220:]), 1):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        progress = []
        got = run_incremental(spark, stream, ["id_student"], out_dir=out, checkpoint=ckpt, most_deltas=most_deltas, progress=progress)
        read.append(max(p["numInputRows"] for name, p in progress if name == "totals"))
        states.append(max(s["numRowsTotal"] for name, p in progress if name == "values" for s in p["stateOperators"]))
        so_far = spark.createDataFrame(rows[: sum((120, 100, 80)[:n])], schema)
        batch = so_far.groupBy("id_student").agg(
            F.sum("sum_click").alias("t"), F.count(F.lit(1)).alias("n"), F.count_distinct("id_site").alias("s"), F.count_distinct("date").alias("d"))
        assert {r.id_student: (r.total_vle_clicks, r.n_vle_records, r.n_vle_sites, r.n_vle_days) for r in got.collect()} == {
            r.id_student: (r.t, r.n, r.s, r.d) for r in batch.collect()}
    assert read == [120, 100, 80]  # only the new files
    triples = {(r[0], "site", r[1]) for r in rows if r[1]} | {(r[0], "day", r[2]) for r in rows}
    assert states[-1] == len(triples)
    folders = list((tmp_path / "out" / "totals").glob("level=*/epoch=*"))
    assert len(folders) == (4 if most_deltas == 16 else 2)


def test_seed_loop(spark, raw, tmp_path):
    """The copula and a synthetic table made elsewhere (real rows of half of the students)."""
    fp = ForestParams(num_trees=4, max_depth=3, shap_trees=3)
    table, _ = build_dataset(spark, "oulad", str(raw))
    outside = {("oulad", 1): {"copied": table.where("id_student % 2 = 0")}}
    summary, seen = run_seeds(spark, str(raw), str(tmp_path), datasets=["oulad"], seeds=[1], made_elsewhere=outside, fp=fp, boosting_rounds=3, n_perm=200)
    got = {(r.synthesizer, r.metric): r for r in summary.collect()}
    assert {m for s, m in got if s == "gaussian_copula"} >= set(P.SUMMARY_METRICS)
    assert {m for s, m in got if s == "copied"} >= {"tstr_cls_rf_auc", "mia_worst_case_effective_auc", "shap_spearman_rho_reg"}
    assert got["gaussian_copula", "tstr_cls_rf_auc_ci_low"].mean <= got["gaussian_copula", "tstr_cls_rf_auc"].mean + 0.1
    assert seen.first()["seeds_observed"] == 1
    res = {r["seed"]: r for r in read_results(spark, str(tmp_path / "seed_*" / "*" / "results.json")).collect()}
    two = res[1]
    assert set(two["pairwise_tests"]) == {"gaussian_copula_vs_copied"} and two["multiple_testing_correction"]["n_tests"] == 2 + 8
    test = two["tstr_vs_trtr"]["copied"]["regression_ridge"]
    assert 0 <= test["p_value"] <= 1 and test["significant_bonferroni"] == (test["p_value"] < 0.05 / 10) and test["n_permutations"] == 200
    shap = two["synthesizers"]["copied"]["shap"]["classification"]
    assert shap["trtr_importance"].keys() == shap["tstr_importance"].keys() and "gender" in shap["trtr_importance"]
    assert read_slice(spark, str(tmp_path / "seed_1" / "oulad" / "data"), "synthetic_train", "copied").count() > 0

    names = write_chart_tables(spark, str(tmp_path), str(tmp_path / "charts"))
    assert {"seed_summary", "score_matrices", "tests", "rank_correlations", "importance_comparison", "attackers"} <= set(names)
    tables = {n: spark.read.parquet(str(tmp_path / "charts" / n)) for n in names}
    assert all(t.count() > 0 for t in tables.values())
    assert tables["tests"].count() == 10
    rho = {(r["seed"], r["task"], r["source_a"], r["source_b"]): r["spearman_rho"] for r in tables["rank_correlations"].collect()}
    assert rho[1, "regression", "trtr", "trtr"] == pytest.approx(1.0)
    assert rho[1, "regression", "trtr", "copied"] == pytest.approx(two["synthesizers"]["copied"]["shap"]["regression"]["rank_correlation"]["spearman_rho"])
