"""Exact de-duplication: groups by brute force, a second batch, a reopened index, degenerate rows."""

import hashlib

import pytest

from cohortlens.llm.common import shared_path
from cohortlens.llm.exact import DigestIndex, buckets_for, drop_exact_duplicates, exact_duplicates


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.fixture()
def docs(spark):
    rows = [(1, "a", "x"), (9, "a", "y"), (4, "A", "x"), (5, None, "x"), (6, "", "y"), (7, "é" * 50_000, "x"), (8, "é" * 50_000, "x")]
    rows += [(20, "twice", "q"), (20, "twice", "q"), (None, "lost", "q"), (None, "lost", "q"), (30, "lost too", "q"), (None, "lost too", "q")]
    rows += [(100 + i, "hot", "h") for i in range(500)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string")


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_groups(docs, batches):
    out = exact_duplicates(docs, buckets=4, batches=batches).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    assert sorted(r.text_sha256 for r in out) == sorted(sha(r.text) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(sha(r.text), []).append(r.doc_id)
    for r in out:
        ids = by[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    for digest, ids in by.items():
        kept = [r for r in out if r.text_sha256 == digest and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def test_rows_that_stay(docs):
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["9", "4", "6", "8", "20", "None", "30", "599"])


def test_second_batch_and_reopened_index(spark, docs):
    path = shared_path(spark, "index")
    first = DigestIndex(spark, path, buckets=4)
    first.add(docs).count()
    size = first.rows().count()
    again = DigestIndex(spark, path, buckets=4)
    new = spark.createDataFrame([(9999, "hot"), (50, "new"), (51, "new"), (52, None)], "doc_id bigint, text string")
    out = {r.doc_id: r for r in again.add(new).collect()}
    assert not out[9999].kept and out[9999].keep_id == 599 and out[9999].group_size == 1
    assert out[51].kept and not out[50].kept and not out[52].kept and out[52].keep_id == 6
    assert again.rows().count() == size + 1


def test_later_batches_lose_their_copies_to_the_index(spark, monkeypatch):
    verdicts, admit = [], DigestIndex.admit
    monkeypatch.setattr(DigestIndex, "admit", lambda index, rows: verdicts.append(admit(index, rows)) or verdicts[-1])
    docs = spark.createDataFrame([(i, f"text {i % 60}") for i in range(100)], "doc_id bigint, text string")
    out = exact_duplicates(docs, buckets=4).collect()
    assert sum(r.kept for r in out) == 60 and all(r.keep_id == (r.doc_id if r.doc_id >= 40 else r.doc_id + 60) for r in out)
    assert len(verdicts) == 2 and verdicts[0].count() + verdicts[1].count() > 60
    assert verdicts[0].where("keep_row IS NULL").count() == 0 and verdicts[1].where("keep_row IS NULL").count() >= 30


def test_compaction(spark, docs):
    index = DigestIndex(spark, shared_path(spark, "index"), buckets=4)
    for part in docs.randomSplit([0.5, 0.5], 3):
        index.add(part).count()
    small = index.compact(shared_path(spark, "index"))
    files = small.rows().inputFiles()
    assert sorted(map(str, small.rows().collect())) == sorted(map(str, index.rows().collect()))
    assert len(files) <= 4 < len(index.rows().inputFiles())
    more = spark.createDataFrame([(1, "hot"), (2, "unseen")], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in small.add(more).collect()} == {1: False, 2: True}
    assert [buckets_for(n) for n in (0, 10**6, 4 * 10**8, 10**11)] == [16, 16, 256, 65536]


def test_index_side_is_not_shuffled(spark, docs):
    index = DigestIndex(spark, shared_path(spark, "index"), buckets=8)
    index.add(docs).count()
    groups = docs.selectExpr("unhex(sha2(text, 256)) AS digest").groupBy("digest").count()
    plan = groups.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_empty_table(docs):
    assert exact_duplicates(docs.limit(0)).count() == 0 and drop_exact_duplicates(docs.limit(0)).count() == 0
