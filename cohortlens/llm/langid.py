"""Language identification by Kneser-Ney character models (operator 1).

One interpolated Kneser-Ney model of character 5-grams per language.  A
model is a pair of sorted arrays per order: 64-bit hashes of the n-grams with
their interpolated log probabilities, and hashes of the contexts with their
back-off weights.  A text gets the language with the lowest cross-entropy
per character of its *whole* text.

Learning uses text and ``lang`` of rows whose crc32(doc_id) mod 3 is not 1:
remainder 0 is counted, remainder 2 calibrates rejection.  Copies count as
one text.  All distinct texts of remainder 0 are counted (counts are summed by
Spark, the driver gets the distinct n-grams with their counts), and all distinct
texts of remainder 2 calibrate unless they were counted; their means and
quantile are taken by Spark.  Only where a caller gives ``sample_chars``, each
language takes texts in the order of a hash until so many characters are full,
but ``MIN_TEXTS`` texts at least.  Prediction reads every text.

Rejection: a text is rejected when it holds no letter, or when its excess
cross-entropy over its language's mean, in units that widen for short texts,
is beyond ``REJECT_MARGIN`` times the ``REJECT_QUANTILE`` of the calibration
texts (the smallest excess that this share of them doesn't exceed).  The margin
makes the rejected share of ordinary texts much smaller than the quantile's.

Texts are lower-cased; everything but letters and marks is white space, and
runs of white space are one blank.

Defined results
    * null text, or text without a letter: ``und``, score 0, rejected;
    * nothing learned (no row with a language): ``und`` for all, not rejected
      when there is a letter;
    * ties go to the language that sorts first; repeated rows get a row each;
    * rows with a null ``doc_id`` count as remainder 0; an empty table gives
      an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortlens.llm.common import staged
from cohortlens.llm.pretokens import text_slices

ORDER = 5
MIN_TEXTS = 50
SLICE_CHARS = 100_000  # what a worker scores at once; its arrays take about 250 bytes a character
KNOWN_GRAMS = 300_000  # n-grams whose log probabilities a worker keeps: 8 bytes each and 4 per language
REJECT_QUANTILE = 0.999
REJECT_MARGIN = 2.0
SPREAD = 1 / 20  # variance that does not vanish with length: texts mix languages, codes and names
UNDETERMINED = "und"
_MULTIPLIER = 0x9E3779B97F4A7C15
_LETTER, _MARK, _GAP, _UNKNOWN = range(4)
_DRAW_BITS, _EXCESS_BITS, _ROUND_BITS = 60, 30, 10
_KINDS = np.full(0x110000, _UNKNOWN, np.uint8)


# -------------------------------------------------------------- characters
def _kinds(points: np.ndarray) -> np.ndarray:
    kinds = _KINDS[points]
    if (kinds == _UNKNOWN).any():
        for p in np.unique(points[kinds == _UNKNOWN]).tolist():
            _KINDS[p] = {"L": _LETTER, "M": _MARK}.get(unicodedata.category(chr(p))[0], _GAP)
        kinds = _KINDS[points]
    return kinds


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with ORDER - 1 blanks before each; owner of each (-1: those blanks); letters per text."""
    pad = ORDER - 1
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer((" " * pad + (" " * pad).join(lowered)).encode("utf-32-le"), np.uint32)
    owner = np.full(len(points), -1, np.int64)
    begin = np.cumsum(lengths + pad) - lengths
    inside = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    owner[inside] = np.repeat(np.arange(len(texts)), lengths)
    kinds = _kinds(points)
    gap = kinds == _GAP
    letters = np.bincount(owner[(owner >= 0) & (kinds == _LETTER)], minlength=len(texts))
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep |= owner < 0
    return np.where(gap, np.uint32(0x20), points)[keep], owner[keep], letters


def _values(points: np.ndarray) -> np.ndarray:
    v = (points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    return v ^ (v >> np.uint64(32))


def _window_hashes(points: np.ndarray) -> list[np.ndarray]:
    """[k]: hash of the k characters that end at each place (too short ones wrap and are never asked for)."""
    values = _values(points)
    out = [np.zeros(len(points), np.uint64)]
    for k in range(1, ORDER + 1):
        power = np.uint64(pow(_MULTIPLIER, k - 1, 1 << 64))
        out.append(np.roll(values, k - 1) * power + out[-1])
    return out


# ------------------------------------------------------------------- model
class Arrays:
    """A sorted hash array and the values beside it."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its value (0 where it isn't)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.float32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        here = self.hashes[at] == hashes
        return here, np.where(here, self.values[at], np.float32(0))


class KneserNey:
    """Interpolated Kneser-Ney over n-grams given with their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        """``grams``: distinct rows of ORDER code points; ``alphabet``: characters that could occur."""
        self.floor = np.float32(-np.log2(alphabet))
        levels = {ORDER: (grams, counts.astype(np.float64))}
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
            shorter, n = np.unique(levels[k + 1][0][:, 1:], axis=0, return_counts=True)
            levels[k] = shorter, n.astype(np.float64)
        self.grams: list[Arrays | None] = [None]
        self.backoff: list[Arrays | None] = [None]
        for k in range(1, ORDER + 1):
            rows, n = levels[k]
            hashes, contexts, lower = self._hash(rows), self._hash(rows[:, :-1]), self._hash(rows[:, 1:])
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context, where = np.unique(contexts, return_inverse=True)
            total, followers = np.bincount(where, weights=n), np.bincount(where)
            weight = discount * followers / total
            if k == 1:
                below = np.full(len(rows), 2.0**self.floor)
            else:
                below = np.exp2(self.grams[k - 1].get(lower)[1].astype(np.float64))  # a suffix is always there
            p = np.maximum(n - discount, 0) / total[where] + weight[where] * below
            self.grams.append(Arrays(hashes, np.log2(p)))
            self.backoff.append(Arrays(context, np.log2(weight)))

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            out = out * np.uint64(_MULTIPLIER) + _values(column)
        return out

    def log2(self, windows: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """log2 p of characters by the hashes of the windows that end at them, and just before them."""
        out = np.zeros(len(windows[1]), np.float32)
        open_ = np.arange(len(out))
        for k in range(ORDER, 0, -1):
            here, value = self.grams[k].get(windows[k][open_])
            out[open_[here]] += value[here]
            open_ = open_[~here]
            if not len(open_):
                return out
            out[open_] += self.backoff[k].get(before[k - 1][open_])[1]
        out[open_] += self.floor
        return out


class Identifier:
    """The models of all languages, and when to reject."""

    def __init__(self, models: dict[str, KneserNey]):
        self.languages = sorted(models)
        self.models = [models[x] for x in self.languages]
        self.means: dict[str, float] = {}  # bits per character of calibration texts
        self.limit = np.inf  # largest excess over them
        self._forget()

    def _forget(self):
        self._hashes = np.zeros(0, np.uint64)
        self._logs = np.zeros((0, len(self.models)), np.float32)

    def _scores(self, hashes: np.ndarray, ending: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """log2 p (n-grams x languages) of distinct n-grams in the order of their hashes; those met before are looked up."""
        out = np.zeros((len(hashes), len(self.models)), np.float32)
        at = np.searchsorted(self._hashes, hashes)
        met = at < len(self._hashes)
        met[met] = self._hashes[at[met]] == hashes[met]
        out[met] = self._logs[at[met]]
        new = np.flatnonzero(~met)
        for m, model in enumerate(self.models):
            out[new, m] = model.log2([w[new] for w in ending], [w[new] for w in before])
        if len(self._hashes) + len(new) > KNOWN_GRAMS:
            self._forget()
        if len(new) <= KNOWN_GRAMS:
            at = np.searchsorted(self._hashes, hashes[new])
            self._hashes, self._logs = np.insert(self._hashes, at, hashes[new]), np.insert(self._logs, at, out[new], axis=0)
        return out

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per character (texts x languages), characters, letters of each text."""
        points, owner, letters = normalised(texts)
        chars = np.bincount(owner[owner >= 0], minlength=len(texts))
        windows = _window_hashes(points)
        place = np.flatnonzero(owner >= 0)
        hashes, first, inverse = np.unique(windows[ORDER][place], return_index=True, return_inverse=True)
        at = place[first]
        logs = self._scores(hashes, [w[at] for w in windows], [w[at - 1] for w in windows])
        out = np.zeros((len(texts), len(self.models)))
        for m in range(len(self.models)):
            out[:, m] = -np.bincount(owner[place], weights=logs[inverse, m], minlength=len(texts))
        return out / np.maximum(chars, 1)[:, None], chars, letters

    @staticmethod
    def excess(bits: np.ndarray, mean: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Excess over the mean in units that widen for short texts."""
        return (bits - mean) / np.sqrt(1 / np.maximum(chars, 1) + SPREAD)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per character and rejection of each text."""
        if not self.models:
            letters = normalised(texts)[2] if texts else np.zeros(0, int)
            none = np.zeros(len(texts))
            return [UNDETERMINED] * len(texts), none, none, letters == 0
        bits, chars, letters = self.bits(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        score = 1 / np.exp2(-(bits - least[:, None]) * np.minimum(chars, 50)[:, None]).sum(axis=1)
        named = letters > 0
        mean = np.array([self.means.get(x, np.inf) for x in self.languages])[best]
        rejected = ~named | (self.excess(least, mean, chars) > self.limit)
        languages = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, named)]
        return languages, np.where(named, score, 0.0), np.where(named, least, 0.0), rejected


# --------------------------------------------------------------------- fit
def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in sorted(set(batch.column(0).to_pylist())):
            for _, _, texts in text_slices(batch.filter(pc.equal(batch.column(0), lang)).column(1), SLICE_CHARS):
                points, owner, _ = normalised(texts)
                place = np.flatnonzero(owner >= 0)
                _, first, n = np.unique(_window_hashes(points)[ORDER][place], return_index=True, return_counts=True)
                line = points.tobytes().decode("utf-32-le")
                grams = [line[i - ORDER + 1 : i + 1] for i in place[first].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())],
                    ["lang", "gram", "n"],
                )


def _code_points(grams: pa.ChunkedArray) -> np.ndarray:
    """Rows of ORDER code points, without a Python object for each n-gram."""
    lines = []
    for chunk in grams.chunks:
        chunk = pa.concat_arrays([chunk.cast(pa.large_string())])
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int64)
        line = data[int(at[0]) : int(at[-1])].to_pybytes().decode() if len(chunk) else ""
        lines.append(np.frombuffer(line.encode("utf-32-le"), np.uint32).reshape(-1, ORDER))
    return np.concatenate(lines) if lines else np.zeros((0, ORDER), np.uint32)


def key_cuts(rows: DataFrame, bits: int, budget: float, least: int) -> dict[str, int]:
    """Of each lang, the largest key taken when rows are taken by rising key until ``budget`` chars are full, ``least`` rows at least.

    ``rows``: lang, key (not negative, of so many bits), chars.  Each round looks into the one cell of 2 **
    ``_ROUND_BITS`` where the budget runs out, so the driver gets as many sums of each language at most.
    """
    spark, cuts = rows.sparkSession, {}
    open_ = {r["lang"]: (0, 0, 0) for r in rows.select("lang").distinct().collect()}  # prefix of the cell, chars and rows before it
    shift = bits
    while open_:
        width, shift = shift, max(0, shift - _ROUND_BITS)
        cells = spark.createDataFrame([(lang, at[0]) for lang, at in sorted(open_.items())], "lang string, prefix bigint")
        sums = (
            rows.join(F.broadcast(cells), "lang").where(F.shiftright("key", width) == F.col("prefix"))
            .groupBy("lang", F.shiftright("key", shift).alias("cell"))
            .agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.max("key").alias("last"))
        )
        found = sorted((r["lang"], r["cell"], r["chars"], r["n"], r["last"]) for r in sums.collect())
        before, open_ = open_, {}
        done = set()
        for lang, cell, chars, n, last in found:
            _, c, t = before[lang]
            if lang in done or (c >= budget and t >= least):
                continue
            if n > 1 and shift and c + chars >= budget and t + n > least:
                open_[lang] = cell, c, t
                done.add(lang)
                continue
            cuts[lang] = last
            before[lang] = 0, c + chars, t + n
    return cuts


def fit(docs: DataFrame, sample_chars: int | None = None, calibration_chars: int | None = None) -> Broadcast:
    """Learn an ``Identifier`` from doc_id, text and lang; of all texts to learn from unless a number of characters is given."""
    # a hash of the text tells copies and orders the texts, the same at every run and partitioning
    draw = F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 64 - _DRAW_BITS)
    known = docs.select(F.col("text").cast("string").alias("text"), "lang", remainder().alias("part"))
    known = known.where("text IS NOT NULL AND lang IS NOT NULL AND part <> 1").withColumn("key", draw)
    texts = known.groupBy("part", "lang", "key").agg(F.max(F.length("text")).cast("bigint").alias("chars"))
    texts = staged(texts, "labelled-texts")

    def taker(part: int, chars: int | None):
        """Takes the rows of that part, from ``known`` or from ``texts``."""
        if chars is None:
            return lambda rows: rows.where(F.col("part") == part)
        cuts = key_cuts(texts.where(F.col("part") == part).drop("part"), _DRAW_BITS, chars, MIN_TEXTS)
        cuts = F.broadcast(docs.sparkSession.createDataFrame(sorted(cuts.items()), "lang string, cut bigint"))
        return lambda rows: rows.where(F.col("part") == part).join(cuts, "lang").where("key <= cut")

    take = taker(0, sample_chars)
    sample = take(known).dropDuplicates(["lang", "key"])
    counted = sample.select("lang", "text").mapInArrow(_count_grams, "lang string, gram string, n bigint")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    langs = table["lang"].combine_chunks().dictionary_encode()
    grams, counts = _code_points(table["gram"]), table["n"].to_numpy()
    alphabet = len(np.unique(grams)) + 1
    of = langs.indices.to_numpy()
    names = enumerate(langs.dictionary.to_pylist())
    found = Identifier({x: KneserNey(grams[of == i], counts[of == i], alphabet) for i, x in names})
    del table, grams, counts, of
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(found)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = shared.value
        for batch in batches:
            langs, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, texts in text_slices(batch.column(1), SLICE_CHARS):
                bits, chars, letters = identifier.bits(texts)
                own = [identifier.languages.index(x) if x in identifier.languages else -1 for x in langs[a:b]]
                use = [i for i, m in enumerate(own) if m >= 0 and letters[i]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([langs[a + i] for i in use], pa.string()),
                        pa.array([keys[a + i] for i in use], pa.int64()),
                        pa.array([float(bits[i, own[i]]) for i in use], pa.float64()),
                        pa.array([int(chars[i]) for i in use], pa.int64()),
                    ],
                    ["lang", "key", "bits", "chars"],
                )

    if found.models:
        held = taker(2, calibration_chars)(known)
        scored = held.select("lang", "text", "key").mapInArrow(score, "lang string, key bigint, bits double, chars bigint")
        distinct = scored.groupBy("lang", "key").agg(F.max("bits").alias("bits"), F.max("chars").alias("chars"))
        taken = take(texts).select("key")
        rows = staged(distinct.join(taken, "key", "left_anti"), "calibration")
        micro = F.sum(F.round(F.col("bits") * F.col("chars") * 1e6).cast("decimal(38,0)"))  # whole numbers: the same in any order
        sums = rows.groupBy("lang").agg(micro.alias("micro"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n")).collect()
        if sums:
            found.means = {r["lang"]: float(r["micro"]) / 1e6 / r["chars"] for r in sums}
            means = F.broadcast(docs.sparkSession.createDataFrame(sorted(found.means.items()), "lang string, mean double"))
            excess = (F.col("bits") - F.col("mean")) / F.sqrt(1 / F.greatest(F.col("chars"), F.lit(1)) + SPREAD)
            zero = 1 << (_EXCESS_BITS - 1)
            key = F.least(F.greatest(F.round(excess * 1e6) + zero, F.lit(0)), F.lit(2 * zero - 1)).cast("bigint")
            keys = rows.join(means, "lang").select(F.lit("").alias("lang"), key.alias("key"), F.lit(1).cast("bigint").alias("chars"))
            rank = math.ceil(REJECT_QUANTILE * sum(r["n"] for r in sums))
            found.limit = max(1.0, (key_cuts(keys, _EXCESS_BITS, 0, rank)[""] - zero) / 1e6) * REJECT_MARGIN
        shared = context.broadcast(found)
    return shared


# ----------------------------------------------------------------- predict
def _predicted(rows: DataFrame, model: Broadcast, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``rows`` with what is predicted from column ``text``, which goes to the workers once."""
    is_text = isinstance(rows.schema["text"].dataType, StringType)
    column = "text" if is_text and "text" in keep else "__cl_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = model.value
        for batch in batches:
            for a, b, texts in text_slices(batch.column(column), SLICE_CHARS):
                languages, score, bits, rejected = identifier.predict(texts)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(languages, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)],
                    [*keep, *added],
                )

    added = ["__cl_lang", "__cl_score", "__cl_bits", "__cl_rejected"]
    schema = rows.select(*keep)
    for name, kind in zip(added, ("string", "double", "double", "boolean")):
        schema = schema.withColumn(name, F.lit(None).cast(kind))
    sent = rows.select(*keep) if column == "text" else rows.withColumn(column, F.col("text").cast("string")).select(*keep, column)
    return sent.mapInArrow(run, schema.schema)


def identify_languages(docs: DataFrame, sample_chars: int | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_char, rejected of every row."""
    model = fit(docs, sample_chars)
    rows = docs.select("doc_id", (remainder() == 1).alias("held_out"), "text")
    return _predicted(rows, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", F.col("__cl_lang").alias("lang_pred"), F.col("__cl_score").alias("score"),
        F.col("__cl_bits").alias("bits_per_char"), F.col("__cl_rejected").alias("rejected"),
    )


def drop_rejected(docs: DataFrame, sample_chars: int | None = None) -> DataFrame:
    """The rows whose language is accepted, with all their columns."""
    return _predicted(docs, fit(docs, sample_chars), docs.columns).where("NOT __cl_rejected").select(*docs.columns)
