"""Host rules: features and shrunken rates against plain Python."""

import re
from collections import Counter

import pytest

from cohortlens.llm.hostrules import judge
from cohortlens.llm.queries import QUERIES

GAP = "[^\x20\x09-\x0d]+"


def plain_features(text):
    t = text or ""
    w = re.findall(GAP, t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(GAP, x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines))


def plain(rows):
    f = [(i, s, *plain_features(t)) for i, t, s in rows]
    fails = [(n < 10, 100 * rep > 20 * n, 10 * sym > chars, 100 * dup > 30 * lines) for _, _, n, chars, sym, dup, rep, lines in f]
    hosts = {s: [x for r, x in zip(f, fails) if r[1] == s] for s in {r[1] for r in f}}
    rate, bad = dict.fromkeys(hosts, 0.0), dict.fromkeys(hosts, False)
    for k in range(4):
        raw = {s: sum(x[k] for x in xs) / len(xs) for s, xs in hosts.items()}
        m = sum(raw.values()) / len(raw)
        v = sum((x - m) ** 2 for x in raw.values()) / len(raw)
        strength = 1e6 if v <= 1e-12 else min(1e6, max(0, m * (1 - m) / v - 1))
        for s, xs in hosts.items():
            p = (sum(x[k] for x in xs) + m * strength) / (len(xs) + strength)
            rate[s] = max(rate[s], p)
            bad[s] |= p - 3 * (p * (1 - p) / (len(xs) + strength + 1)) ** 0.5 > min(0.5, max(0.2, 3 * m))
    return sorted(
        (str(r[0]), *r[2:7], base := x[0] or x[1], not base and not bad[r[1]], pytest.approx(rate[r[1]], abs=1e-6), bad[r[1]])
        for r, x in zip(f, fails)
    )


def result(df):
    cols = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept host_rate host_bad".split()
    return sorted((str(r.doc_id), *(r[c] for c in cols)) for r in df.collect())


def test_rules_and_hosts(spark):
    fine = "one two three four five six seven eight nine ten eleven"
    rows = [(i, f"{fine} number {i}", "good") for i in range(30)]
    rows += [(100 + i, "# | # | " * 20 + f"{i}", "bad") for i in range(30)] + [(140, fine, "bad"), (141, fine, None)]
    rows += [(150, None, "mixed"), (151, "", "mixed"), (152, " \t\x0b\x0c\r\n ", "mixed"), (153, fine, "mixed"), (153, fine, "mixed")]
    rows += [(160, "a b c d e f a b c d e x a b c d e", "mixed"), (161, "x x x x x x x", "mixed"), (162, "é ö 中\n\nsame\nsame\r\nsame \n", "mixed"),
             (163, "r s t u v w " * 600, "good"), (None, f"{fine} 77", "good"), (164, "a b c d e a b c d e " + fine * 9, "good")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, n_words int")
    got = result(judge(docs))
    assert got == plain(rows)
    assert not [r for r in got if r[0] == "140"][0][7] and [r for r in got if r[0] == "0"][0][7]


def test_planted_host_far_above_the_corpus(spark, tmp_path):
    """Through the registered query: 40 % of one host's documents are symbols; a small host with as many stays."""
    fine = "one two three four five six seven eight nine ten eleven"
    marks = " ".join(f"#|#|{j}" for j in range(12))
    rows = [(1000 * h + i, f"{marks if i % 25 == 0 else fine} {i}", f"host{h}") for h in range(20) for i in range(50)]
    rows += [(70_000 + i, f"{marks if i % 5 < 2 else fine} {i}", "planted") for i in range(300)]
    rows += [(80_000 + i, f"{marks if i < 2 else fine} {i}", "small") for i in range(5)]
    rows += [(90_000, "w " * 100_000 + fine, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op6_host_rules"](spark, str(tmp_path))
    assert result(out) == plain(rows)
    went = {r.doc_id for r in out.collect() if not r.kept and not r.base_failed}
    assert went == set(range(70_000, 70_300))


def test_one_host_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "one two three four five six seven eight nine ten", "s")], "doc_id bigint, text string, source string")
    assert [r.kept for r in judge(docs).orderBy("doc_id").collect()] == [False, True]
    assert judge(docs.limit(0)).count() == 0
