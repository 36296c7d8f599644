"""Language models: probabilities against a plain Kneser-Ney, held-out accuracy, rejection."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlens.llm import langid
from cohortlens.llm.langid import MIN_TEXTS, ORDER, KneserNey, _window_hashes, drop_rejected, fit, identify_languages, key_cuts, normalised

SF = "/root/testdata/sf0.01"


def plain_model(grams, alphabet):
    """p(character | context) as dictionaries, straight from the definition."""
    levels = {ORDER: dict(grams)}
    for k in range(ORDER - 1, 0, -1):
        before = defaultdict(set)
        for g in levels[k + 1]:
            before[g[1:]].add(g[0])
        levels[k] = {g: len(b) for g, b in before.items()}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / alphabet
        counts = levels[k]
        n1, n2 = (sum(1 for c in counts.values() if c == x) for x in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(counts.get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    return p


def test_probabilities_match_the_definition():
    points, owner, _ = normalised(["The cat sat on the mat.", "A cat, the hat and a bat!"])
    line = points.tobytes().decode("utf-32-le")
    grams = Counter(line[i - ORDER + 1 : i + 1] for i in np.flatnonzero(owner >= 0))
    names = sorted(grams)
    rows = np.array([[ord(c) for c in g] for g in names], np.uint32)
    model = KneserNey(rows, np.array([grams[g] for g in names]), 30)
    p = plain_model(grams, 30)
    other, who, _ = normalised(["that cat zzz"])
    place = np.flatnonzero(who >= 0)
    windows = _window_hashes(other)
    got = model.log2([w[place] for w in windows], [w[place - 1] for w in windows])
    text = other.tobytes().decode("utf-32-le")
    assert got == pytest.approx([math.log2(p(text[i - ORDER + 1 : i + 1])) for i in place], abs=1e-4)


def test_normalised_texts_do_not_touch():
    points, owner, letters = normalised(["Ab  c!", "", "1 2", "É"])
    assert points.tobytes().decode("utf-32-le") == "    ab c         é" or owner.max() == 3
    assert letters.tolist() == [3, 0, 0, 1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = identify_languages(docs).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth) and 0.25 < len(held) / len(out) < 0.42
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out) and np.mean([r.rejected for r in out]) < 0.005


def test_defined_results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(600)
    odd = [(-1, None, None), (-2, "", "en"), (-3, "123 !?", None), (-4, "中文字符" * 30, None), (-5, "xq zvkj wqpt " * 30, None),
           (None, "the and of", None), (-6, "the and of", None), (-6, "the and of", None), (-7, "of the thing " * 40_000, None)]
    both = docs.union(spark.createDataFrame(odd, "doc_id bigint, text string, lang string"))
    out = {}
    for r in identify_languages(both).where("doc_id < 0 OR doc_id IS NULL").collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [out[i][0].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and all(out[i][0].rejected for i in (-1, -2, -3, -4, -5))
    assert len(out[-6]) == 2 and out[-6][0] == out[-6][1] and not out[-6][0].rejected and not out[-7][0].rejected
    assert out[None][0].lang_pred == out[-6][0].lang_pred == "en"
    kept = drop_rejected(both)
    assert kept.columns == both.columns and kept.where("doc_id BETWEEN -5 AND -1").count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.rejected) for r in identify_languages(docs).orderBy("doc_id").collect()] == [("und", False), ("und", True)]
    assert identify_languages(docs.limit(0)).count() == 0


def test_copies_do_not_crowd_out_a_language(spark):
    words = {"aa": "wolu takemi ponar silue".split(), "bb": "grsch dtrk pfund zwrn".split()}
    rows = [(0, "hot " * 500, "aa")] * 3000
    rows += [(i, " ".join(words[x][(i * k) % 4] for k in range(1, 30)) + f" {words[x][i % 4]}", x) for x in words for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    truth = {i: {"aa", "bb"} for i in range(1, 400)}
    out = [r for r in identify_languages(docs, sample_chars=2_000).collect() if r.doc_id in truth]
    assert sorted(r.lang_pred for r in out) == ["aa"] * 399 + ["bb"] * 399
    assert fit(docs, sample_chars=2_000).value.languages == ["aa", "bb"]


def test_texts_are_taken_in_order_until_the_budget_is_full(spark):
    keys = [(x, (k * 7919) % (1 << 20) + (k % 3 << 50), c) for x, c in (("a", 10), ("b", 1000)) for k in range(300)]
    rows = spark.createDataFrame(keys, "lang string, key bigint, chars bigint")
    got = key_cuts(rows, 60, 1505, 20)
    order = {x: sorted(k for y, k, _ in keys if y == x) for x in "ab"}
    assert got == {"a": order["a"][150], "b": order["b"][19]}
    assert key_cuts(rows, 60, 1e9, 0) == {x: order[x][-1] for x in "ab"} and key_cuts(rows.limit(0), 60, 9, MIN_TEXTS) == {}


def test_met_ngrams_score_as_new_ones(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdef gh"), size=400)) for _ in range(30)]

    def model(seed):
        grams = np.unique(np.random.default_rng(seed).integers(97, 105, size=(500, langid.ORDER)).astype(np.uint32), axis=0)
        return langid.KneserNey(grams, np.ones(len(grams), int), 9)

    models = {"x": model(1), "y": model(2)}
    want = langid.Identifier(models).bits(texts)[0]
    for most in (500_000, 50, 0):
        monkeypatch.setattr(langid, "KNOWN_GRAMS", most)
        one = langid.Identifier(models)
        for _ in range(2):
            got = np.concatenate([one.bits(texts[i:i + 7])[0] for i in range(0, 30, 7)])
            assert np.allclose(got, want, rtol=1e-9, atol=0)
        assert len(one._hashes) <= most


def test_all_texts_are_counted_and_calibrate(spark, monkeypatch):
    """As many texts as the former bounds (1.5 and 8 million characters of a language) did not hold."""
    size = 60_000
    rows = [(i, f"ab{chr(0x4E00 + i)} " * size, "aa") for i in range(120)]  # one character of its own in each text
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    part = {r.doc_id: r.part for r in docs.select("doc_id", langid.remainder().alias("part")).collect()}
    counted = {i for i in part if part[i] == 0}
    assert len(counted) * 4 * size > 1_500_000
    grams = []
    whole = langid.KneserNey.__init__
    monkeypatch.setattr(langid.KneserNey, "__init__", lambda self, g, n, a: (grams.append(np.unique(g)), whole(self, g, n, a))[1])
    fit(docs)
    assert {int(c) - 0x4E00 for c in grams[0] if c >= 0x4E00} == counted
    fit(docs, sample_chars=1_000)
    assert {int(c) - 0x4E00 for c in grams[1] if c >= 0x4E00} < counted or len(counted) <= MIN_TEXTS
