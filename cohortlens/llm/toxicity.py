"""Toxicity by a classifier chain (operator 9).

``CATEGORIES`` are predicted one after the other by logistic models; each
sees the words of the text and the probabilities of the earlier categories.
While training, those probabilities are out-of-fold predictions: the rows are
in ``FOLDS`` folds by a hash of the text (equal texts share a fold), and a row
is predicted by a model that did not see its fold, its feature screening
included.  The decision threshold of the last category maximises F1 of its
out-of-fold probabilities.

Features are hashed words and word beginnings of 4 to 6 letters, screened by
the z value of their log odds ratio, and two numbers of form.  The fit reads
at most about ``TRAIN_ROWS`` labelled rows (drawn by a hash of the id, the
documented bound); feature counts are summed by Spark, and the driver gets
screened features only.  Every text is scored whole.

Defined results
    * labels: rows of one id are merged by their maximum; null counts as 0;
    * a text without any screened word (null, empty, no letters, or none of
      them) shows no evidence and is not toxic, whatever the prior says;
    * a category without both classes in the training rows gets its constant
      share; without labels nothing is toxic;
    * repeated rows get a row each; an empty table gives an empty result;
      extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged
from cohortlens.llm.langid import _values, normalised
from cohortlens.llm.pretokens import text_slices

#: name -> label expression, in the order of the chain; the last one decides
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
TRAIN_ROWS = 8_000
FOLDS = 4
BEGINNINGS = (4, 5, 6)
SCREEN_Z = 4.0
MOST_FEATURES = 8_192
PENALTY = 1e-4
_MULTIPLIER = 0xD1342543DE82EF95


# ---------------------------------------------------------------- features
def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of every word and word beginning; numbers of form per text."""
    points, owner, letters = normalised(texts)
    inside = (points != 0x20) & (owner >= 0)
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power = np.full(len(points) + 1, _MULTIPLIER, np.uint64)
    inverse = np.full(len(points) + 1, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(_values(points) * power[:-1], dtype=np.uint64)]

    def hashed(s: np.ndarray, e: np.ndarray, kind: int) -> np.ndarray:
        h = (total[e] - total[s]) * inverse[s] + np.uint64(kind)
        h ^= h >> np.uint64(31)
        return (h * np.uint64(_MULTIPLIER)).view(np.int64)

    text, code = [owner[start]], [hashed(start, end, 0)]
    for n in BEGINNINGS:
        long = end - start >= n
        text.append(owner[start[long]])
        code.append(hashed(start[long], start[long] + n, n))
    chars = np.array([len(t) for t in texts])
    form = np.stack([np.log1p(letters) / 10, 1 - letters / np.maximum(chars, 1)], axis=1)
    return np.concatenate(text), np.concatenate(code), form


def _known_features(texts: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, place in the sorted array ``known``) pairs, and the numbers of form."""
    text, code, form = word_features(texts)
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), form
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    hit = known[at] == code
    pair = np.unique(text[hit] * len(known) + at[hit])
    return pair // len(known), pair % len(known), form


# ------------------------------------------------------------------- model
class Logistic:
    """L2 logistic regression on sparse 0/1 features and a few dense ones (Nesterov descent)."""

    def __init__(self, rows, cols, dense, y, n_features: int, steps: int = 600):
        self.sparse, self.dense, self.bias = np.zeros(n_features), np.zeros(dense.shape[1]), 0.0
        n, share = len(y), y.mean() if len(y) else 0.0
        self.constant = None if 0 < share < 1 else float(share)
        if self.constant is not None:
            return
        self.bias = np.log(share / (1 - share))
        # the curvature is at most a quarter of the largest row norm
        rate = 4 / (np.bincount(rows, minlength=n).max() + 1 + (dense**2).sum(axis=1).max())
        w = np.r_[self.sparse, self.dense, self.bias]
        ahead, momentum = w.copy(), 1.0
        for _ in range(steps):
            error = (self._p(ahead, rows, cols, dense) - y) / n
            slope = np.r_[np.bincount(cols, weights=error[rows], minlength=n_features), dense.T @ error, error.sum()]
            slope[:-1] += PENALTY * ahead[:-1]
            following = ahead - rate * slope
            next_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            ahead = following + (momentum - 1) / next_momentum * (following - w)
            w, momentum = following, next_momentum
        self.sparse, self.dense, self.bias = w[:n_features], w[n_features:-1], w[-1]

    def _p(self, w, rows, cols, dense):
        k = len(self.sparse)
        z = np.bincount(rows, weights=w[:k][cols], minlength=len(dense)) + dense @ w[k:-1] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def predict(self, rows, cols, dense) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(dense), self.constant)
        return self._p(np.r_[self.sparse, self.dense, self.bias], rows, cols, dense)


class Chain:
    """Fitted models of all categories, their features and the threshold of the last."""

    def __init__(self, names, known, models, threshold):
        self.names, self.known, self.models, self.threshold = names, known, models, threshold

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, texts x categories, and the verdict of the last category."""
        rows, cols, dense = _known_features(texts, self.known)
        for use, model in self.models:
            here = use[cols]
            dense = np.c_[dense, model.predict(rows[here], cols[here], dense)]
        evidence = np.bincount(rows[here], minlength=len(texts)) > 0
        return dense[:, -len(self.models) :], evidence & (dense[:, -1] > self.threshold)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap that maximises F1; above 1 when there is no positive row."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    ends = np.r_[p[order][1:] < p[order][:-1], True]
    f1 = np.where(ends, 2 * hits / (np.arange(1, len(y) + 1) + y.sum()), 0)
    i = int(f1.argmax())
    return float((p[order][i] + (p[order][i + 1] if i + 1 < len(p) else 0)) / 2)


# --------------------------------------------------------------------- fit
def _training_rows(docs: DataFrame, labels: DataFrame, categories, train_rows: int) -> DataFrame:
    """fold, y0, y1, ... , features (distinct hashes), form of a bounded sample of labelled rows."""
    merged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        *(F.max(F.coalesce(F.expr(e), F.lit(False)).cast("int")).alias(f"y{i}") for i, e in enumerate(categories.values()))
    )
    total = merged.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < F.lit(int(min(1.0, train_rows / max(1, total)) * (1 << 30)))
    # about train_rows rows of a few numbers each: a bound that does not grow with the data
    chosen = F.broadcast(merged.where(draw))
    ys = [f"y{i}" for i in range(len(categories))]
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(
        F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), *ys, F.col("text").cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, code, form = word_features([batch.column("text")[i].as_py() or ""])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, 1) for c in ["fold", *ys]),
                     pa.array([np.unique(code)], pa.list_(pa.int64())), pa.array([form[0]], pa.list_(pa.float64()))],
                    ["fold", *ys, "features", "form"],
                )

    kinds = ", ".join(f"{y} int" for y in ys)
    return staged(rows.mapInArrow(run, f"fold int, {kinds}, features array<bigint>, form array<double>"), "toxicity-rows")


def _screened(rows: DataFrame, n_categories: int, screen_z: float) -> list:
    """Features with the models they may serve: use<category>_<fold left out, or FOLDS for none>."""
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"y{i}").alias(f"y{i}") for i in range(n_categories)))
    sizes = {r["fold"]: r for r in sizes.collect()}
    words = rows.withColumn("feature", F.explode("features")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count(F.when(F.col("fold") == f, 1)).alias(f"n_{f}") for f in range(FOLDS)),
        *(F.sum(F.when(F.col("fold") == f, F.col(f"y{i}")).otherwise(0)).alias(f"y{i}_{f}") for i in range(n_categories) for f in range(FOLDS)),
    )
    uses, scores = {}, []
    for i in range(n_categories):
        for out in range(FOLDS + 1):
            inside = [f for f in range(FOLDS) if f != out]
            n = sum((F.col(f"n_{f}") for f in inside), F.lit(0))
            a = sum((F.col(f"y{i}_{f}") for f in inside), F.lit(0))
            all_a = sum(sizes[f][f"y{i}"] for f in inside if f in sizes)
            all_b = sum(sizes[f]["n"] for f in inside if f in sizes) - all_a
            b = n - a
            odds = F.log((a + 0.5) / (F.lit(all_a) - a + 0.5)) - F.log((b + 0.5) / (F.lit(all_b) - b + 0.5))
            z = F.abs(odds) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            uses[f"use{i}_{out}"] = z > screen_z
            scores.append(z)
    judged = words.where("n >= 4").withColumns(uses).withColumn("z", F.greatest(*scores))
    return judged.where(F.col("z") > screen_z).orderBy(F.desc("z"), "feature").select("feature", *uses).limit(MOST_FEATURES).collect()


def fit(docs: DataFrame, labels: DataFrame, categories=None, train_rows: int = TRAIN_ROWS, screen_z: float = SCREEN_Z) -> Chain:
    categories = dict(categories or CATEGORIES)
    n_cat = len(categories)
    rows = _training_rows(docs, labels, categories, train_rows)
    found = sorted(_screened(rows, n_cat, screen_z), key=lambda r: r["feature"])
    known = np.array([r["feature"] for r in found], np.int64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features").to_pylist()
            places = [np.flatnonzero(np.isin(known, np.array(x, np.int64))).tolist() for x in lists]
            others = [c for c in batch.schema.names if c != "features"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(places, pa.list_(pa.int64()))], [*others, "features"])

    kinds = ", ".join(f"y{i} int" for i in range(n_cat))
    ordered = ["fold", *(f"y{i}" for i in range(n_cat)), "form", "features"]
    sample = rows.select(*ordered).mapInArrow(keep, f"fold int, {kinds}, form array<double>, features array<bigint>").collect()
    sample.sort(key=lambda r: (r["fold"], tuple(r["features"]), tuple(r["form"])))
    fold = np.array([r["fold"] for r in sample], np.int64)
    dense = np.array([r["form"] for r in sample], float).reshape(len(sample), 2)
    lengths = [len(r["features"]) for r in sample]
    row = np.repeat(np.arange(len(sample)), lengths)
    col = np.array([f for r in sample for f in r["features"]], np.int64)
    models, threshold = [], 1.1
    for i in range(n_cat):
        y = np.array([r[f"y{i}"] for r in sample], float)
        use = [np.array([r[f"use{i}_{f}"] for r in found], bool) for f in range(FOLDS + 1)]

        def trained(out: int):
            rows_in = fold != out
            new = np.cumsum(rows_in) - 1
            pick = rows_in[row] & use[out][col]
            return Logistic(new[row[pick]], col[pick], dense[rows_in], y[rows_in], len(known))

        apart = np.zeros(len(sample))
        for f in range(FOLDS):
            held = np.flatnonzero(fold == f)
            if len(held):
                place = np.full(len(sample), -1)
                place[held] = np.arange(len(held))
                pick = (place[row] >= 0) & use[f][col]
                apart[held] = trained(f).predict(place[row[pick]], col[pick], dense[held])
        models.append((use[FOLDS], trained(FOLDS)))
        dense = np.c_[dense, apart]
        threshold = _best_threshold(apart, y) if len(y) else 1.1
    return Chain(list(categories), known, models, threshold)


# ----------------------------------------------------------------- predict
def predict_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> ..., and the verdict named as the last category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                p, verdict = chain.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(verdict)],
                    ["doc_id", *names, chain.names[-1]],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "".join(f", {n} double" for n in names)
    return rows.mapInArrow(run, f"doc_id bigint{kinds}, {chain.names[-1]} boolean")


def toxicity(docs: DataFrame, labels: DataFrame, categories=None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit the chain on the labelled rows and judge every document."""
    return predict_toxicity(docs, fit(docs, labels, categories, train_rows))
