"""Classifier chain: features, out-of-fold training, held-out accuracy, degenerate rows."""

import numpy as np
import pytest

from cohortlens.llm.toxicity import Logistic, _best_threshold, fit, predict_toxicity, toxicity, word_features

SF = "/root/testdata/sf0.01"


def test_word_features_are_functions_of_the_word():
    texts = ["Hello world", "  hello", "", "worldly ÉTÉ", None or ""]
    text, code, form = word_features(texts)
    by = [set(code[text == i].tolist()) for i in range(len(texts))]
    assert by[1] < by[0] and len(by[1]) == 3  # hello: the word, 4 and 5 letters of it
    assert len(by[0] & by[3]) == 2 and not by[2]  # world begins worldly: 4 and 5 letters
    assert form.shape == (5, 2)


def test_logistic_separates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    rows = np.concatenate([np.flatnonzero(y == 1), np.arange(400)])
    cols = np.concatenate([np.zeros(int(y.sum()), int), rng.integers(1, 5, 400)])
    model = Logistic(rows, cols, np.zeros((400, 1)), y, 5)
    p = model.predict(rows, cols, np.zeros((400, 1)))
    assert ((p > 0.5) == (y == 1)).all()
    assert Logistic(rows, cols, np.zeros((400, 1)), np.zeros(400), 5).predict(rows, cols, np.zeros((400, 1))).max() == 0


def test_threshold_lies_in_the_best_gap():
    assert 0.3 < _best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1.0, 1.0, 0.0, 0.0])) < 0.8
    assert _best_threshold(np.array([0.5]), np.array([0.0])) > 1


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = fit(docs, labels.where("crc32(cast(doc_id as string)) % 4 <> 0"), screen_z=2.5)
    truth = {r.doc_id: r.toxic for r in labels.where("crc32(cast(doc_id as string)) % 4 = 0").collect()}
    out = {r.doc_id: r.toxic for r in predict_toxicity(docs, chain).collect() if r.doc_id in truth}
    assert np.mean([out[i] == (t == 1) for i, t in truth.items()]) > 0.92
    assert np.mean([out[i] for i, t in truth.items() if t == 0]) < 0.06


@pytest.fixture()
def small(spark):
    rows = [(i, f"nice text number {i} here", "x") for i in range(60)] + [(100 + i, f"you awful fool {i} there", "x") for i in range(60)]
    rows += [(500, None, "y"), (501, "", "y"), (502, "such an awful fool", "y"), (502, "such an awful fool", "y"), (None, "awful fool", "y"),
             (503, "plain words " * 60_000, "y"), (504, "123 !!", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame(
        [(r[0], 1, int(r[0] >= 100)) for r in rows if r[0] is not None and r[0] < 500] + [(0, None, None), (None, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    return docs, labels


def test_defined_results(small):
    docs, labels = small
    out = {}
    for r in toxicity(docs, labels).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert len(out[502]) == 2 and out[502][0] == out[502][1] and out[502][0].toxic and out[None][0].toxic
    assert not any(out[i][0].toxic for i in (500, 501, 503, 504, 1)) and all(out[100 + i][0].toxic for i in range(60))
    assert {r.p_low_quality for rs in out.values() for r in rs} == {0.0}  # one class only: its share


def test_no_labels_and_empty(small):
    docs, labels = small
    assert not any(r.toxic for r in toxicity(docs, labels.limit(0)).collect())
    assert toxicity(docs.limit(0), labels).count() == 0
