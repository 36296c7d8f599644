"""Property and brute-force checks of the operators (SURVEY 5 'our tests')."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import resample as R
from cohortlens.operators import split
from cohortlens.operators.dist import auc_mann_whitney, cliff_counts, exact_percentiles, ks_statistic, value_prefix
from cohortlens.operators.effect import effect_size_summary
from cohortlens.operators.knn import knn_distances
from cohortlens.operators.quality import ks_complement, tv_complement
from cohortlens.operators.ranks import spearman_p_value
from cohortlens.operators.split import group_split, kth_smallest, sample_exact, stratified_split, subsample_at_most


def test_kth_smallest_matches_sort(spark):
    vals = [int(x) for x in np.random.default_rng(1).integers(0, 2**52, 500)]
    df = spark.createDataFrame([(v,) for v in vals], "h long")
    s = sorted(vals)
    for k in (1, 2, 250, 499, 500):
        assert kth_smallest(df, "h", k) == s[k - 1]
    assert kth_smallest(df, "h", 0) == -1


def test_kth_smallest_per_class(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(None if i % 5 == 0 else f"c{i % 3}", int(x)) for i, x in enumerate(rng.integers(0, 2**52, 600))] + [("same", 77)] * 50
    df = spark.createDataFrame(rows, "c string, h long")
    by = {c: sorted(h for k, h in rows if k == c) for c in {k for k, _ in rows}}
    wants = {None: 7, "c0": 1, "c1": 90, "c2": 10**6, "same": 9, "absent": 3}
    want = {c: -1 if c not in by else by[c][min(k, len(by[c])) - 1] for c, k in wants.items()}
    assert split.kth_smallest_by(df, "h", "c", wants) == want
    monkeypatch.setattr(split, "FEW", 0)  # by histograms alone
    assert split.kth_smallest_by(df, "h", "c", wants) == want


def test_group_split_keeps_groups_whole_and_exact_size(spark):
    rows = [(g, i) for g in range(101) for i in range(g % 4 + 1)]
    df = spark.createDataFrame(rows, "grp long, i long")
    out = group_split(df, "grp", test_size=0.3, seed=7)
    sides = out.groupBy("grp").agg(F.count_distinct("split").alias("k")).where("k > 1").count()
    assert sides == 0
    n_test = out.where("split = 'test'").select("grp").distinct().count()
    assert n_test == math.ceil(0.3 * 101)


def test_sample_exact_and_stratified(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(300)], "id long, y boolean")
    assert sample_exact(df, "id", 57, seed=3).count() == 57
    repeated = df.withColumn("id", F.lit(1)).unionByName(df)  # a key that half of the rows share
    assert sample_exact(repeated, "id", 57, seed=3).count() == 57
    assert sample_exact(df, "id", 900, seed=3).count() == 300 and subsample_at_most(df, "id", 900, seed=3).count() == 300
    s = stratified_split(df.withColumn("y", F.col("y").cast("int")), "id", "y", test_size=0.3, seed=1)
    counts = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert counts[(1, "test")] + counts[(0, "test")] == 90
    assert counts[(1, "test")] == 30


def test_auc_equals_pairwise_definition(spark):
    rng = np.random.default_rng(0)
    s = np.round(rng.normal(size=300), 1)
    y = (rng.random(300) < 0.4).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    got = auc_mann_whitney(df, "s", "y").first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert abs(got - want) < 1e-12


def test_cliff_and_ks_brute_force(spark):
    rng = np.random.default_rng(2)
    a = np.round(rng.normal(size=120), 1)
    b = np.round(rng.normal(0.3, size=90), 1)
    da = spark.createDataFrame([(float(x),) for x in a], "v double")
    db = spark.createDataFrame([(float(x),) for x in b], "v double")
    c = cliff_counts(da, db, "v").first()
    assert c["n_greater"] == sum(x > y for x in a for y in b)
    assert c["n_less"] == sum(x < y for x in a for y in b)
    ks = ks_statistic(da, db, "v").first()["ks"]
    grid = np.union1d(a, b)
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert abs(ks - want) < 1e-12


def test_value_prefix_partition_invariant(spark):
    rows = [(float(i % 37), i % 2) for i in range(1000)]
    one = spark.createDataFrame(rows, "v double, y int").coalesce(1)
    seven = spark.createDataFrame(rows, "v double, y int").repartition(7)
    w = {"p": F.col("y").cast("long")}
    a = sorted(tuple(r) for r in value_prefix(one, "v", w, buckets=5).collect())
    b = sorted(tuple(r) for r in value_prefix(seven, "v", w, buckets=3).collect())
    assert a == b


def test_identical_tables_score_perfectly(spark):
    df = spark.createDataFrame([(float(i % 13), str(i % 4), i) for i in range(200)], "x double, c string, id long")
    assert ks_complement(df, df, ["x"]).first()["score"] == 1.0
    assert tv_complement(df, df, ["c"]).first()["score"] == 1.0
    e = effect_size_summary(df, df, ["x"]).first()
    assert e["cohens_d"] == 0.0 and e["cliff_delta"] == 0.0
    pairs = df.select("id", F.col("x").alias("a"), F.col("x").alias("b"))
    p = R.paired_permutation_test(pairs, "a", "b", "id", n_perm=200).first()
    assert p["p_value"] == 1.0 and p["cohens_d"] == 0.0


def test_exact_percentiles_match_numpy(spark):
    x = np.random.default_rng(5).exponential(size=3000)
    x[:500] = 1.0  # a heavy tie
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.005, 0.1, 0.5, 0.9, 0.995, 1.0]
    assert np.allclose(exact_percentiles(df, "x", probs), np.quantile(x, probs), rtol=0, atol=0)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    Q, Rm = rng.normal(size=(40, 6)), rng.normal(size=(70, 6))
    q = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(Q)], "id long, features_arr array<double>")
    r = spark.createDataFrame([([float(v) for v in row],) for row in Rm], "features_arr array<double>")
    got = {row["id"]: row for row in knn_distances(q, r, key="id", k=5, tile_rows=16).collect()}
    for i, row in enumerate(Q):
        d = np.sort(np.sqrt(((Rm - row) ** 2).sum(axis=1)))[:5]
        assert abs(got[i]["d_min"] - d[0]) < 1e-9
        assert abs(got[i]["d_mean_k"] - d.mean()) < 1e-9


def test_knn_copy_has_zero_distance(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(30)]
    q = spark.createDataFrame(rows, "id long, features_arr array<double>")
    d = knn_distances(q, q.select("features_arr"), key="id", k=1)
    assert d.agg(F.max("d_min")).first()[0] == 0.0


def test_resampling_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(a + rng.normal(0.05, 1)), int(rng.random() < 0.3)) for i, a in enumerate(rng.normal(size=700))]
    one, many = (spark.createDataFrame(rows, "id long, a double, b double, y int").repartition(n) for n in (1, 7))
    for f in (lambda d: R.paired_permutation_test(d, "a", "b", "id", n_perm=500), lambda d: R.bootstrap_mean_ci(d, "a", "id", n_boot=300),
              lambda d: R.bootstrap_auc_ci(d, "a", "y", "id", n_boot=100)):
        assert [round(x, 9) if isinstance(x, float) else x for x in f(one).first()] == [round(x, 9) if isinstance(x, float) else x for x in f(many).first()]


def test_signs_are_fair_and_come_from_md5(spark):
    import hashlib

    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    rows = df.select("k", R.digests("k", 7, 3).alias("h")).collect()
    assert rows[5]["h"] == b"".join(hashlib.md5(f"7:{b}:{rows[5]['k']}".encode()).digest() for b in range(3))
    assert abs(R.sign_matrix([r["h"] for r in rows], 300).mean()) < 0.01


@pytest.mark.parametrize("per_cell", [40, 10**6])
def test_every_replicate_draws_exactly_n_rows(spark, monkeypatch, per_cell):
    monkeypatch.setattr(R, "ROWS_PER_CELL", per_cell)
    n, reps = 330, 400
    rows = spark.createDataFrame([(i, float(i)) for i in range(n)], "id long, x double").select(F.col("id").cast("string").alias("_k"), F.col("x").alias("_x"))
    cells = -(-n // per_cell)
    rows = rows.withColumn("_c", F.floor(R.uniform("cell", F.col("_k")) * cells))

    def kernel(cell, draws, number):
        squares, total, first = np.zeros(reps), np.zeros(reps), np.zeros(reps)
        for a, rep, at in R.picked_rows(draws, len(cell), 3, number):
            w = np.zeros((reps, len(cell)))
            np.add.at(w, (rep + a, at), 1)
            squares += (w**2).sum(axis=1)
            total += w.sum(axis=1)
            first += w @ (cell["_x"].to_numpy() == 0)
        return [total, squares, first]

    got = R._resampled(rows, [], cells, reps, 3, ["w", "w2", "first"], kernel).groupBy("rep").agg(
        F.sum("w").alias("w"), F.sum("w2").alias("w2"), F.sum("first").alias("first"), F.count(F.lit(1)).alias("cells")).collect()
    assert len(got) == reps and all(r["w"] == n for r in got)
    assert (got[0]["cells"] > 3) == (per_cell == 40)
    # a multinomial count over n equal rows: mean 1, variance 1 - 1/n, so the mean of squares is 2 - 1/n
    assert abs(np.mean([r["w2"] for r in got]) / n - (2 - 1 / n)) < 0.02
    assert abs(np.mean([r["first"] for r in got]) - 1) < 0.2 and abs(np.var([r["first"] for r in got]) - 1) < 0.35


def test_intervals_of_many_cells_agree_with_those_of_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.integers(0, 5)) if i % 3 else float(rng.normal()), int(rng.random() < 0.4)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, s double, y int")
    exact = auc_mann_whitney(df, "s", "y").first()["auc"]
    one = R.bootstrap_auc_ci(df, "s", "y", "id", n_boot=300).first(), R.bootstrap_mean_ci(df, "s", "id", n_boot=300).first()
    monkeypatch.setattr(R, "ROWS_PER_CELL", 40)
    many = R.bootstrap_auc_ci(df, "s", "y", "id", n_boot=300).first(), R.bootstrap_mean_ci(df, "s", "id", n_boot=300).first()
    for a, b in zip(one, many):
        assert all(abs(a[c] - b[c]) < 0.02 * max(1, abs(a[c])) for c in ("mean", "ci_low", "ci_high"))
    assert abs(many[0]["mean"] - exact) < 0.005


def test_auc_replicates_are_the_auc_of_the_drawn_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(f"k{i:03d}", float(rng.integers(0, 4)), int(rng.random() < 0.5)) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, s double, y int")
    got = R.bootstrap_auc_ci(df, "s", "y", "id", n_boot=50, alpha=0.0).first()
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    s, y = np.array([r[1] for r in ordered]), np.array([r[2] for r in ordered])
    aucs = np.zeros(50)
    for a, rep, at in R.picked_rows(np.full(50, 90), 90, 0, 0):
        for r in np.unique(rep):
            p, q = s[at[rep == r]][y[at[rep == r]] == 1], s[at[rep == r]][y[at[rep == r]] == 0]
            aucs[a + r] = ((p[:, None] > q) + 0.5 * (p[:, None] == q)).mean()
    assert abs(got["mean"] - aucs.mean()) < 1e-12 and abs(got["ci_low"] - aucs.min()) < 1e-12 and abs(got["ci_high"] - aucs.max()) < 1e-12


def test_small_groups_take_fewer_replicates(spark):
    df = spark.createDataFrame([(i, float(i % 7), i < 20) for i in range(90)], "id long, x double, small boolean")
    got = {r["small"]: r for r in R.bootstrap_mean_ci(df, "x", "id", group_cols=("small",), n_boot=600).collect()}
    assert (got[True]["n_bootstrap"], got[False]["n_bootstrap"]) == (500, 600) and got[True]["n_samples"] == 20


def test_empty_and_null_sides_give_null(spark):
    some = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, c string")
    none = spark.createDataFrame([(None, "a")], "x double, c string")
    assert ks_complement(some, none, ["x"]).first()["score"] is None
    assert tv_complement(some, some.limit(0), ["c"]).first()["score"] is None


def test_spearman_p_value_known_values():
    # rho = 0.5 with 10 pairs: t = 1.633, df 8, two-sided p = 0.1411
    assert abs(spearman_p_value(0.5, 10) - 0.1411) < 1e-3
    assert spearman_p_value(float("nan"), 10) is None
