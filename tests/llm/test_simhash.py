"""SimHash: fingerprints and components against brute force, for any pair limit."""

import random
import re

import pytest
import xxhash

from cohortlens.llm.components import connected_components
from cohortlens.llm.queries import QUERIES
from cohortlens.llm.simhash import drop_near_duplicates, fingerprint, links, near_duplicates

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    """fp -> smallest fp reachable, by all pairs."""
    fps, root = sorted(set(fps)), {}
    for f in fps:
        root[f] = f

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_fingerprint_matches_definition():
    for t in [None, "", " \t\n", "one", "One TWO", "É é x", "a b c", "a b c a b c a b c", "x\x0by\x0cz \xa0 w", "w " * 70_000 + "q r s"]:
        assert fingerprint(t) & (2**64 - 1) == plain_fingerprint(t)


@pytest.mark.parametrize("pair_limit", [2, 5, 64])
def test_links_keep_components(spark, pair_limit):
    rng = random.Random(pair_limit)
    fps = set()
    for _ in range(6):
        seed = rng.getrandbits(64)
        for _ in range(40):
            f = seed
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
        half = rng.getrandbits(32)
        fps |= {half << 32 | rng.getrandbits(3) << rng.randrange(29) for _ in range(15)}
        fps |= {half | rng.getrandbits(2) << rng.randrange(32, 60) for _ in range(15)}
    fps = [f - 2**64 if f >= 2**63 else f for f in fps] + [0]
    table = spark.createDataFrame([(f,) for f in set(fps)], "fp bigint")
    found = links(table, pair_limit=pair_limit)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in found.collect())
    got = {r.node: r.root for r in connected_components(found).collect()}
    assert {f: got.get(f, f) for f in set(fps)} == plain_components(fps)


def test_query_over_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fp = {i: plain_fingerprint(t) for i, t in docs}
    root, least = plain_components(fp.values()), {}
    for i, f in fp.items():
        least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((i, f"{f:016x}", least[root[f]]) for i, f in fp.items())
    assert sorted(tuple(r) for r in QUERIES["op2_simhash_near_dedup"](spark, SF).collect()) == want


def test_degenerate_rows(spark):
    rows = [(3, None, "a"), (2, "", "b"), (9, "one", "c"), (9, "one", "c"), (None, "one", "d"), (7, "two " * 50_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted((str(r.doc_id), r.component_id) for r in near_duplicates(docs).collect())
    assert got == [("2", 2), ("3", 2), ("7", 7), ("9", 9), ("9", 9), ("None", 9)]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 9]
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "x")], "doc_id bigint, text string")
    assert near_duplicates(alone).first().component_id is None
