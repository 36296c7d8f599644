"""Token counts from pre-token frequencies (operator 8).

A BPE tokenizer merges inside pre-tokens only, so a text has
``sum(frequency x pieces)`` tokens over its distinct pre-tokens:

1. every task reduces its texts to distinct pre-tokens, and one shuffle
   makes them distinct over the corpus;
2. the tokenizer library counts the pieces of each distinct pre-token once;
3. per-document frequencies are joined to these counts and summed.

Pre-tokens are as skewed as words.  The ``HOT`` most frequent ones are
looked up on the map side (a fixed bound: 65 536 keys of 8 bytes with their
counts), which both removes the hot keys from the join and leaves only the
rare ones to shuffle; every other pre-token is joined by its string.

Defined results
    * null text counts as empty: 0 bytes, 0 tokens;
    * special strings inside a text count as the library takes them;
    * each input row gives one row, repeated rows included;
    * an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged
from cohortlens.llm.pretokens import cutter, slices

HOT = 1 << 16
LIMIT = 512
SLICE_CHARS = 4_000_000
FLUSH = 500_000


def distinct_pretokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """pretoken, n (occurrences in all texts), pieces (tokens of one occurrence)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(tokenizer_path).cut
        keys, counts, strings = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(counts)], ["pretoken", "n"])

        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(np.array([len(t) for t in texts]), SLICE_CHARS):
                found = cut(texts[a:b])
                if not len(found.key):
                    continue
                k, where, n = np.unique(found.key, return_index=True, return_counts=True)
                at = np.searchsorted(keys, k)
                new = at == len(keys)
                new[~new] = keys[at[~new]] != k[~new]
                counts[at[~new]] += n[~new]
                keys, counts = np.insert(keys, at[new], k[new]), np.insert(counts, at[new], n[new])
                strings = np.insert(strings, at[new], np.array(found.strings(where[new]), object))
                if len(keys) >= FLUSH:
                    yield out()
                    keys, counts, strings = keys[:0], counts[:0], strings[:0]
        yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = cutter(tokenizer_path).ids
        for batch in batches:
            pieces = [len(x) for x in ids(batch.column("pretoken").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], ["pretoken", "n", "pieces"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(collect, "pretoken string, n bigint")
    total = found.groupBy("pretoken").agg(F.sum("n").alias("n"))
    return total.mapInArrow(count, "pretoken string, n bigint, pieces bigint")


def _most_frequent(pieces_of: DataFrame, most: int) -> list:
    """At most ``most`` rows: all pre-tokens above a frequency, found from a histogram of its logarithm."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    levels = pieces_of.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    lowest, held = None, 0
    for r in levels:  # 1 008 levels at most
        held += r["n"]
        if held > most:
            break
        lowest = r["level"]
    return [] if lowest is None else pieces_of.where(level >= lowest).select("pretoken", "pieces").collect()


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    pieces_of = staged(distinct_pretokens(docs, tokenizer_path), "pretokens")
    top = _most_frequent(pieces_of, hot)
    hot_keys = cutter(tokenizer_path).cut([r["pretoken"] for r in top]).key
    order = np.argsort(hot_keys)
    shared = docs.sparkSession.sparkContext.broadcast(
        (hot_keys[order], np.array([r["pieces"] for r in top], np.int64)[order])
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, (keys, pieces) = cutter(tokenizer_path).cut, shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(np.array([len(t) for t in texts]), SLICE_CHARS):
                found = cut(texts[a:b])
                unique, where, inverse = np.unique(found.key, return_index=True, return_inverse=True)
                at = np.searchsorted(keys, unique)
                known = at < len(keys)
                known[known] = keys[at[known]] == unique[known]
                each = np.zeros(len(unique), np.int64)
                each[known] = pieces[at[known]]
                tokens = np.bincount(found.text, weights=each[inverse], minlength=b - a).astype(np.int64)
                rare = ~known[inverse]
                pair, freq = np.unique(found.text[rare] * len(unique) + inverse[rare], return_counts=True)
                text, word = np.divmod(pair, max(1, len(unique)))
                rows = np.arange(row, row + b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows),
                        batch.column(0).slice(a, b - a),
                        pa.array(size[a:b].astype(np.int64)),
                        pa.array(tokens),
                        pa.nulls(b - a, pa.string()),
                        pa.nulls(b - a, pa.int64()),
                    ],
                    names,
                )
                n = len(pair)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[text]),
                        *(pa.nulls(n, pa.int64()) for _ in range(3)),
                        pa.array(found.strings(where[word]), pa.string()),
                        pa.array(freq.astype(np.int64)),
                    ],
                    names,
                )
                row += b - a

    names = ["row", "doc_id", "n_bytes", "known", "pretoken", "freq"]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(
        frequencies, "row bigint, doc_id bigint, n_bytes bigint, known bigint, pretoken string, freq bigint"
    )
    # a row's own record has no pre-token; a key of its own keeps these records from meeting in one task
    own = F.concat(F.lit("\0"), F.col("row").cast("string"))
    joined = rows.withColumn("pretoken", F.coalesce("pretoken", own)).join(
        pieces_of.select("pretoken", "pieces"), "pretoken", "left"
    )
    tokens = F.sum(F.coalesce("known", F.lit(0)) + F.coalesce(F.col("freq") * F.col("pieces"), F.lit(0)))
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
