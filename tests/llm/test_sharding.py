"""Histogram sort: near equal bytes, gapless slots, equal texts together, bounded counts."""

import zlib

import pytest

from cohortlens.llm.queries import QUERIES
from cohortlens.llm.sharding import find_splitters, histogram_shards, shard_documents

SF = "/root/testdata/sf0.001"


def check(out, docs, shards, slack):
    texts = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    rows = out.collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == texts
    size, slots = [0] * shards, {}
    for r in rows:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size) / shards
    assert max(abs(s - mean) for s in size) <= slack + 0.001 * mean
    return rows


def test_query_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    largest = max(r.size for r in check(QUERIES["op5_histogram_sharding"](spark, SF), docs, 40, 1e12))
    check(QUERIES["op5_histogram_sharding"](spark, SF), docs, 40, largest)


def test_hot_text_and_degenerate_rows(spark):
    rows = [(i, "copy " * 20, "a") for i in range(400)] + [(1000 + i, f"text {i} " * (i % 9), "b") for i in range(700)]
    rows += [(5, None, "c"), (6, "", "c"), (7, "twice", "d"), (7, "twice", "d"), (None, "no id", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    out = check(histogram_shards(docs, shards=8, parts=4), docs, 8, 200)
    apart = {}
    for r in out:
        apart.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in apart.values()) <= 7  # only texts at a boundary are divided


def test_splitters_are_exact_counts(spark):
    rows = spark.createDataFrame([(f"{i * 7919:032X}", 10) for i in range(1000)], "key string, size bigint")
    splitters, counts = find_splitters(rows, [2500.0, 5000.0], tolerance=5)
    below = [sum(10 for i in range(1000) if f"{i * 7919:032X}" < s) for s in splitters]
    assert all(abs(b - t) <= 10 for b, t in zip(below, (2500, 5000)))
    assert max(counts[1:]) <= 512


def test_files_and_empty(spark, tmp_path):
    rows = [(i, f"text {i}", i, "k", 7) for i in range(200)] + [(1, None, 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, slot int, key string, size int")
    shard_documents(docs, str(tmp_path / "out"), shards=4, parts=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "shard"}
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(ValueError):
        shard_documents(docs.withColumn("shard", docs.slot), str(tmp_path / "no"), shards=4)
    shard_documents(docs.withColumn("shard", docs.slot), str(tmp_path / "named"), shards=4, shard_col="part")
    assert {"shard", "part"} <= set(spark.read.parquet(str(tmp_path / "named")).columns)
    assert histogram_shards(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [[(1, "x")], [(1, "x")] * 30])
def test_fewer_keys_than_shards(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(histogram_shards(docs, shards=5), docs, 5, 17)


def test_equal_rows_are_divided(spark):
    """A third of all rows share their text and have no id; one text is very long."""
    rows = [(None, "same text")] * 1000 + [(i, f"text number {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = check(histogram_shards(docs, shards=40), docs, 40, 80)
    hot = zlib.crc32(b"same text")
    assert 10 <= len({r.shard for r in out if r.text_crc32 == hot}) <= 15  # a third of the bytes, together
    long = docs.union(spark.createDataFrame([(-1, "long " * 400_000)], docs.schema))
    check(histogram_shards(long, shards=3), long, 3, 2_000_016)


def test_plain_construction(spark):
    """Boundaries against sorting all keys and cutting at the wanted bytes."""
    rows = spark.createDataFrame([(f"{(i * 2654435761) % 2**32:08X}" * 4, 10 + i % 7) for i in range(3000)], "key string, size bigint")
    held = sorted((r.key, r.size) for r in rows.collect())
    total = sum(n for _, n in held)
    targets = [total * i / 8 for i in range(1, 8)]
    splitters, _ = find_splitters(rows, targets, tolerance=0)
    for target, s in zip(targets, splitters):
        below, best, run = sum(n for k, n in held if k < s), 10**9, 0
        for _, n in [("", 0), *held]:
            run += n
            best = min(best, abs(run - target))
        assert abs(below - target) == best
