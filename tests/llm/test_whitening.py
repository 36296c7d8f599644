"""Whitening: the eigenproblem against numpy, the query against a plain version, edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import whitening as W
from cohortlens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def test_eigenpairs_against_numpy():
    rng = np.random.default_rng(3)
    for d, k in [(1, 1), (2, 2), (3, 3), (10, 10), (64, 4), (64, 64), (150, 20)]:
        m = rng.normal(size=(d, 2 * d)) * rng.uniform(0.1, 5, size=(d, 1))
        a = m @ m.T
        values, vectors = W.leading_eigenpairs(a, k)
        want, _ = np.linalg.eigh(a)
        assert np.allclose(values, want[::-1][:k], rtol=1e-10, atol=1e-12 * want[-1])
        assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11 * want[-1] * d
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 1], [3, 3, 0, 0], [0, 0, 0, 0], [1, 1 - 1e-13, 1 - 2e-13, 1e-20], [2, 2, 2, 2]])
def test_equal_and_close_eigenvalues(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(4, 4)))
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = W.leading_eigenpairs(a, 4)
    assert np.allclose(values, spectrum, atol=1e-13)
    assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-12


def test_diagonal_matrix_and_sturm_counts():
    a = np.diag([1.0, 7.0, 3.0, 3.0])
    values, vectors = W.leading_eigenpairs(a, 3)
    assert np.allclose(values, [7, 3, 3]) and np.allclose(np.abs(vectors[0]), [0, 1, 0, 0])
    assert W.sturm_counts(np.array([1.0, 7.0, 3.0]), np.zeros(2), np.array([0.0, 2.0, 5.0, 9.0])).tolist() == [0, 1, 2, 3]


def plain(rows, k=4, d=None):
    """The contract by plain loops and numpy's own solver."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array(sums) / n
    y = np.array(fit) - mean
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k].T
    out = {}
    for i, x in kept:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out.setdefault(i, []).append((n, dev, (np.array(x) - mean) @ vectors.T / np.sqrt(values), values / np.trace(y.T @ y / n)))
    return out


def held_against(got, want, k):
    signs = np.zeros(k)
    assert len(got) == sum(len(v) for v in want.values()) * k
    for r in got:
        n, dev, white, share = want[r["vec_id"]][0]
        j = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(r["explained"] - share[j]) < 1e-9 and r["identity_error"] < 1e-9
        if signs[j] == 0 and abs(white[j]) > 1e-6:
            signs[j] = np.sign(white[j] * r["whitened"])
        assert abs(r["whitened"] - signs[j] * white[j]) < 1e-7


def test_query_against_plain_version(spark):
    got = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.01").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    held_against(got, plain(rows, 4, 64), 4)


def test_unusable_rows_copies_and_extra_columns(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)]
    rows += [(100, rows[0][1])] * 30 + [(101, [c + 1e-9 for c in rows[0][1]])]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan] * 5), (203, [math.inf, 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0, 2.0]), (None, rows[3][1])]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    got = W.whitened_components(df, "vec_id", "embedding", 4).collect()
    assert sum(r["vec_id"] is None for r in got) == 4
    held_against([r for r in got if r["vec_id"] is not None], plain(rows, 4, 5), 4)
    clash = df.withColumns({"deviation": F.lit("mine"), "x": F.lit(1), "whitened": F.lit(2)})
    out, w, _ = W.whiten(clash, "embedding", 2)
    assert w.n == 40 and set(out.columns) == {"vec_id", "embedding", "x", "deviation", "whitened"}
    assert out.count() == 72


def test_too_few_distinct_vectors(spark):
    assert W.whitened_components(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", 4).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 9, SCHEMA)
    assert W.whitened_components(one, "vec_id", "embedding", 4).collect() == []
    two = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 5.0, 3.0]), (3, [0.0, 5.0, 3.0])], SCHEMA)
    got = W.whitened_components(two, "vec_id", "embedding", 4).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 3
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 and abs(r["explained"] - 1) < 1e-12 for r in got)


def test_large_entries_stay_exact_or_stop():
    x = np.array([[2 ** 30, -(2 ** 30)], [5, 6]])
    sums = [int(c) for c in x.sum(axis=0)]
    want = [sum((2 * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    assert W._deviations(x, 2, sums).tolist() == want
    with pytest.raises(OverflowError):
        W._deviations(x * 2 ** 10, 2, [s * 2 ** 10 for s in sums])
