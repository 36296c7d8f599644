"""Burst trie against a plain dictionary of prefixes, at several container sizes."""

import hashlib
import random
import zlib

import pytest

from cohortlens.llm import trie
from cohortlens.llm.queries import QUERIES

ROWS = "conv_id long, turn long, role string, text string"


def plain_trie(convs: dict):
    """Node rows of {conversation: [(role, text), ...]} by the definition."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        inner = {q[:-1] for q in below if len(q) > len(p)}
        ended = sorted(c for c in cs if len(convs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(q[:-1] == p and q != p for q in below),
                    sum(q not in inner for q in below), sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below),
                    hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def rebuilt(convs: dict):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def frame(spark, convs, parts=4):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, ROWS).repartition(parts)


def sample(seed, n=60):
    rng = random.Random(seed)
    texts = ["", "a", "bb", "ccc", "é\U0001f600"]
    convs = {}
    for c in rng.sample(range(1000), n):
        shared = [("system", "s"), ("user", "long shared opening")] * rng.randrange(0, 3)
        convs[c] = shared + [(rng.choice(["user", "assistant"]), rng.choice(texts)) for _ in range(rng.randrange(1, 9))]
    ids = sorted(convs)
    for c in ids[: n // 3]:
        convs[c] = convs[ids[0]]  # a third are copies
    return convs


@pytest.mark.parametrize("limit", [0, 60])
def test_against_plain_trie(spark, limit, monkeypatch):
    monkeypatch.setattr(trie, "SLICE", 3)
    monkeypatch.setattr(trie, "RUN_IDS", 4)
    convs = sample(limit)
    assert nodes(trie.conversation_trie(frame(spark, convs), *ROWS.replace(" long", "").replace(" string", "").split(", "), container_rows=limit)) == plain_trie(convs)


def test_shared_passage_takes_one_round_and_every_conversation_differs_later(spark, monkeypatch):
    rounds = []
    burst = trie._burst
    monkeypatch.setattr(trie, "_burst", lambda *a: rounds.append(1) or burst(*a))
    stem = [("user", f"t{i}") for i in range(80)]
    convs = {c: stem + [("user", str(c)), ("assistant", "x")] for c in range(9)} | {50: stem[:40], 51: stem}
    got = nodes(trie.conversation_trie(frame(spark, convs), "conv_id", "turn", "role", "text", container_rows=10))
    assert got == plain_trie(convs) and len(rounds) == 2


def test_borrowed_heads(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE", 2)
    rng = random.Random(4)
    convs = {c: [("user", f"{c if rng.random() < 0.5 else 0}-{i}") for i in range(rng.randrange(1, 12))]
             for c in [0, 1, 2, 3, 5, 7, 42, 99, 100, 101, 133, 199, 301, 302, 303, 304, 305, 306, 307, 555]}
    convs[304] = convs[304][:1]
    turns = trie.turn_sequences(frame(spark, convs), "conv_id", "turn", "role", "text")
    want = rebuilt(convs)
    assert any(not v for v in want.values())  # some conversation is left without turns
    assert nodes(trie.prefix_trie(*trie.with_borrowed_heads(turns), container_rows=8)) == plain_trie(want)


def test_positions_of_a_conversation_over_many_partitions(spark):
    rows = [(1, t, "user", str(t)) for t in range(3000)] + [(2, 0, "user", "x")]
    rows += [(1, None, "system", "first"), (1, 5, "user", "5"), (1, 5, "user", "5")]
    df = spark.createDataFrame(rows, ROWS).repartition(8)
    got = trie.turn_sequences(df, "conv_id", "turn", "role", "text").where("conv_id = 1").orderBy("pos").collect()
    lens = [5] + [len(str(t)) for t in range(3000) for _ in range(3 if t == 5 else 1)]
    assert [r["pos"] for r in got] == list(range(1, 3004)) and [r["len"] for r in got] == lens
    assert got[-1]["cum"] == sum(lens)


def test_nulls_ties_extra_columns_and_empty_table(spark):
    rows = [(1, 1, None, "a", 1), (1, None, "user", None, 1), (2, 1, "", "a", 2), (2, 0, "user", "", 2), (None, 0, "user", "lost", 3), (3, 0, "user", "", 3)]
    df = spark.createDataFrame(rows, ROWS + ", pos long").withColumnRenamed("pos", "tid")
    convs = {1: [("user", ""), ("", "a")], 2: [("user", ""), ("", "a")], 3: [("user", "")]}
    assert nodes(trie.conversation_trie(df, "conv_id", "turn", "role", "text")) == plain_trie(convs)
    assert nodes(trie.conversation_trie(df.limit(0), "conv_id", "turn", "role", "text")) == []
    tied = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b")], ROWS)
    assert len(nodes(trie.conversation_trie(tied, "conv_id", "turn", "role", "text"))) == 3


def test_very_long_text(spark):
    convs = {1: [("user", "x" * 3_000_000)], 2: [("user", "x" * 3_000_000), ("assistant", "y")]}
    assert nodes(trie.conversation_trie(frame(spark, convs, 2), "conv_id", "turn", "role", "text")) == plain_trie(convs)


def test_registered_query_against_plain_trie(spark):
    got = nodes(QUERIES["op11_conversation_trie"](spark, "/root/testdata/sf0.001"))
    convs = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == plain_trie(rebuilt(convs))
