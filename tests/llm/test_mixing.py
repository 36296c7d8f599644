"""Poisson mixing: rates, counts by brute force, target shares, degenerate rows."""

import hashlib
import math

import pytest

from cohortlens.llm.mixing import SEED, mix_documents, poisson_mixture, source_rates


def u(*parts):
    return int(hashlib.md5(":".join(map(str, (SEED, *parts))).encode()).hexdigest()[:13], 16) / 2**52


def plain_count(doc_id, rate):
    parts = max(1, math.ceil(rate / 32))
    r, n = rate / parts, 0
    for j in range(1, parts + 1):
        p = c = math.exp(-r)
        k = 0
        while c <= min(u(doc_id, j), 1 - 1e-13):
            k += 1
            p = p * r / k
            c += p
        n += k
    return n


@pytest.fixture()
def docs(spark):
    rows = [(i, "x" * (i % 50 + 1), "hot", 1) for i in range(3000)] + [(9000 + i, "yy", "small", 2) for i in range(20)]
    rows += [(9500, "zz", None, 3), (9501, None, "none", 4), (9501, "", "none", 4)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, rate int")


def test_counts_and_shares(spark, docs):
    rates = {r.source: r.rate for r in source_rates(docs).collect()}
    total = sum(i % 50 + 1 for i in range(3000)) + 40 + 2
    assert rates == {"hot": pytest.approx(total / 3 / (total - 42)), "small": pytest.approx(total / 3 / 40), None: pytest.approx(total / 3 / 2)}
    out = poisson_mixture(docs).collect()
    seen = {}
    for r in out:
        seen.setdefault(r.doc_id, []).append(r.copy)
    sources = {r.doc_id: r.source for r in docs.collect()}
    for i, s in sources.items():
        n = plain_count(i, rates[s]) if s in rates else 0
        assert sorted(seen.get(i, [])) == list(range(1, n + 1))
    for s in rates:
        assert sum(r.n_bytes for r in out if r.source == s) == pytest.approx(total / 3, rel=0.12)


def test_weights_and_columns(spark, docs):
    out = mix_documents(docs, weights={"hot": 1, "small": 3}, budget=20_000)
    assert out.columns == docs.columns
    size = {r.source: r.b for r in out.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "b").collect()}
    assert set(size) == {"hot", "small"} and size["small"] * 2 == pytest.approx(15_000, rel=0.05)


def test_ties_and_empty(spark, docs):
    twice = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (None, "b", "s")], "doc_id bigint, text string, source string")
    out = poisson_mixture(twice, budget=30).collect()
    assert len([r for r in out if r.doc_id == 1]) == 2 * plain_count(1, 10.0)
    assert poisson_mixture(docs.limit(0)).count() == 0


def test_texts_move_through_the_exchange(spark, docs):
    node = poisson_mixture(docs)._jdf.queryExecution().optimizedPlan()
    while "Repartition" not in node.nodeName():
        node = node.children().head()
    dealt = node.output().mkString(" ")
    assert "text#" in dealt and "bytes" not in dealt
    size = {r.doc_id: len(r.text or "") for r in docs.collect()}
    assert all(r.n_bytes == size[r.doc_id] for r in poisson_mixture(docs).collect())
