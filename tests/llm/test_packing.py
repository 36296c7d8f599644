"""Packing: exact tokens, valid places, few sequences, degenerate rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlens.llm.packing import best_fit, best_fit_packing, packing_plan, reduce_by_dominance, sequences
from cohortlens.llm.pretokens import IdCache

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "s", "t", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", " ", "　", "1", "٣", "é",
         "é", "!", "#", "<|endoftext|>", "中", "\U0001f600", "​", "\x00", "\x85", "²", "x'd", " '"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), max_size=12))
def test_ids_equal_the_library(texts):
    ids, counts = IdCache(PATH).encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []
    assert got == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def bins_of(plan):
    out = {}
    for length, first, times, copies, sequence, offset in plan.tolist():
        for t in range(times):
            for c in range(copies):
                out.setdefault(sequence + t, []).append((offset + c * length, length))
    return out


def optimum(items, cap):
    """Fewest bins by exhaustive search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= items[i]:
                go(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
        go(i + 1, rooms + [cap - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_plan_is_valid_and_reduction_keeps_the_optimum(items):
    cap = 12
    counts = np.bincount(items, minlength=cap + 1)
    bins = bins_of(packing_plan(counts, cap))
    assert sorted(k for b in bins.values() for _, k in b) == sorted(items)
    for b in bins.values():
        end = 0
        for offset, k in sorted(b):
            assert offset == end
            end += k
        assert end <= cap
    fixed, left = reduce_by_dominance(counts, cap)
    rest = np.repeat(np.arange(cap + 1), left).tolist()
    assert sum(t for _, t in fixed) + optimum(rest, cap) == optimum(items, cap)


def test_bulk_best_fit_equals_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(30):
        items = sorted(rng.integers(1, 40, 60).tolist(), reverse=True)
        rooms = []
        for k in items:
            fit = [r for r in rooms if r >= k]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - k)
            else:
                rooms.append(64 - k)
        groups = best_fit(np.bincount(items, minlength=65), 64)
        left = sorted(64 - sum(a * b for a, b in p) for p, t in groups for _ in range(t))
        assert left == sorted(rooms)


@pytest.fixture()
def docs(spark):
    long = "word and another " * 1500
    rows = [(1, long, "x"), (2, None, "x"), (3, "", "y"), (4, "hello world", None), (4, "hello world", None), (None, "odd id", "z")]
    rows += [(10 + i, "same text again", "hot") for i in range(300)] + [(1000 + i, "w " * (i * 7), "v") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id string")


def test_packing_against_brute_force(spark, docs):
    out = best_fit_packing(docs, PATH).toPandas()
    tok = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, _ in docs.collect():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024)] if len(ids) > 1024 else [0]
        for p, a in enumerate(cuts):
            piece = ids[a : cuts[p + 1] if p + 1 < len(cuts) else len(ids)]
            want.append((str(doc_id), p, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    ids = ["None" if x != x else str(int(x)) for x in out.doc_id]
    assert sorted(zip(ids, out.piece, out.start, out.length, out.ids_crc32)) == sorted(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 1024) + 3


def test_sequences_hold_the_ids(spark, docs):
    seqs = sequences(docs, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in docs.collect())
    assert sum(len(s.ids) for s in seqs) == total and max(len(s.ids) for s in seqs) <= 1024


def test_empty_table(spark, docs):
    assert best_fit_packing(docs.limit(0), PATH).count() == 0
