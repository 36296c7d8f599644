"""Best-fit packing with dominance reduction (operator 4).

Documents become token pieces of at most ``capacity`` tokens, and pieces are
packed into as few sequences as possible.  Only piece *lengths* decide a
packing, so the plan is made on the histogram of lengths (``capacity``
counts, exact over all pieces) and then applied to every piece by its rank
among the pieces of its length:

1. Martello-Toth reduction.  For the longest remaining length, a set of at
   most three pieces that dominates every other set holding that piece is
   fixed for good: the piece alone when nothing fits beside it, with a piece
   that fills it exactly, with the longest that fits when no two fit, or with
   two when no three fit and every other pair is no longer piece by piece.
   The instance shrinks, and the rules are tried again until none applies.
2. Best-fit decreasing packs what remains, in bulk per length.

Ranks come from per-(length, salt) counts and a window inside each salt, so
a length that holds most pieces is spread over ``SALTS`` tasks.

Defined results
    * null text counts as empty: one piece holding the end token;
    * a document of more than ``capacity`` tokens is cut from its end, so the
      first piece may be shorter and the rest are full;
    * repeated rows are packed as often as they occur;
    * an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged
from cohortlens.llm.pretokens import forget_ids, id_cache, text_slices

CAPACITY = 1024
END_ID = 2
SALTS = 256
SLICE_CHARS = 500_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# ------------------------------------------------------------------ pieces
def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = id_cache(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0)
            for a, b, texts in text_slices(batch.column(1), SLICE_CHARS):
                ids, counts = cache.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = counts - (n - 1) * capacity
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                at = (np.cumsum(counts) - counts)[doc] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(at.tolist(), length.tolist())]
                cols = [
                    doc_ids.slice(a, b - a).take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[i : i + k].astype("i4") for i, k in zip(at.tolist(), length.tolist())], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        forget_ids()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


# -------------------------------------------------------------------- plan
Group = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...), sequences packed so


def _dominating(left: np.ndarray, length: int, capacity: int) -> tuple[int, ...] | None:
    """Companions of ``length`` in a dominating set, or None when no rule decides."""
    room = capacity - length
    left = left.copy()
    left[length] -= 1
    present = np.flatnonzero(left[: room + 1])
    if not len(present):
        return ()
    if left[room]:
        return (room,)
    smallest: list[int] = []
    for k in present[:3].tolist():
        smallest += [k] * int(min(left[k], 3 - len(smallest)))
    longest = int(present[-1])
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (longest,)
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    left[longest] -= 1
    beside = np.flatnonzero(left[: room - longest + 1])
    if not len(beside):
        return None
    second = int(beside[-1])
    above = np.flatnonzero(left[second + 1 : room + 1])[:2] + second + 1
    pair = np.repeat(above, np.minimum(left[above], 2))[:2]
    return (longest, second) if len(pair) < 2 or pair.sum() > room else None


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> tuple[list[Group], np.ndarray]:
    """Fix dominating sets; returns them and the counts that remain."""
    left, fixed = counts.astype(np.int64).copy(), []
    changed = True
    while changed:
        changed = False
        for length in range(capacity, 0, -1):
            while left[length]:
                found = _dominating(left, length, capacity)
                if found is None:
                    break
                members = [length, *found]
                need = {k: members.count(k) for k in members}
                times = min(int(left[k]) // m for k, m in need.items())
                if len(found) == 2 or (found and found[0] + length != capacity):
                    times = 1 if len(found) == 2 else times
                for k, m in need.items():
                    left[k] -= m * times
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                changed = True
    return fixed, left


def best_fit(left: np.ndarray, capacity: int) -> list[Group]:
    """Best-fit decreasing on counts, whole groups of equal sequences at a time."""
    open_: dict[int, list[Group]] = {}
    for length in range(capacity, 0, -1):
        remaining = int(left[length])
        while remaining:
            room = min((r for r in open_ if r >= length), default=None)
            fresh = room is None
            pattern, times = ((), remaining) if fresh else open_[room].pop()
            if not fresh and not open_[room]:
                del open_[room]
            room = capacity if fresh else room
            each = room // length
            full = min(times, remaining // each)
            if full:
                open_.setdefault(room - each * length, []).append((pattern + ((length, each),), full))
                remaining -= full * each
                used = full
            else:
                open_.setdefault(room - remaining * length, []).append((pattern + ((length, remaining),), 1))
                remaining, used = 0, 1
            if not fresh and times > used:
                open_.setdefault(room, []).append((pattern, times - used))
    return [g for groups in open_.values() for g in groups]


def packing_plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, sequences, copies, first sequence, offset).

    ``counts[k]`` is the number of pieces of k tokens.  Ranks of a row run
    over its sequences, ``copies`` at a time.
    """
    fixed, left = reduce_by_dominance(counts, capacity)
    rows, sequence = [], 0
    rank = np.zeros(capacity + 1, np.int64)
    for pattern, times in fixed + best_fit(left, capacity):
        offset = 0
        for length, copies in pattern:
            rows.append((length, rank[length], times, copies, sequence, offset))
            rank[length] += times * copies
            offset += length * copies
        sequence += times
    return np.array(rows, np.int64).reshape(-1, 6)


# -------------------------------------------------------------------- pack
def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece (any columns beside ``length``) its sequence_id and offset."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("__cl_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = np.zeros((capacity + 1, SALTS), np.int64)
    for row in salted.groupBy("length", "__cl_salt").agg(F.count(F.lit(1)).alias("n")).collect():  # <= capacity * SALTS
        counts[row["length"], row["__cl_salt"]] = row["n"]
    plan = packing_plan(counts.sum(axis=1), capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast((np.cumsum(counts, axis=1) - counts, plan))
    schema = pieces.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, plan = shared.value
        first = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, salt, nth = (batch.column(c).to_numpy() for c in ("length", "__cl_salt", "__cl_nth"))
            rank = base[length, salt] + nth - 1
            row = plan[np.searchsorted(first, (length << 44) + rank, side="right") - 1]
            step = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(row[:, 4] + step // row[:, 3]), pa.array(row[:, 5] + step % row[:, 3] * length)],
                [*names, "sequence_id", "offset"],
            )

    names = pieces.columns
    nth = F.expr("row_number() OVER (PARTITION BY length, __cl_salt ORDER BY doc_id, piece, ids_crc32)")
    return salted.withColumn("__cl_nth", nth).mapInArrow(run, schema.replace(":", " ") + ", sequence_id bigint, offset bigint")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack ``docs``: one row per piece with its place."""
    return pack_pieces(staged(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids (a sequence is at most ``capacity`` ids)."""
    pieces = staged(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids=True), "pieces")
    placed = pack_pieces(pieces, capacity)
    members = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(members.alias("m")).select(
        "sequence_id", F.flatten("m.ids").alias("ids"), F.col("m.doc_id").alias("doc_ids")
    )
