"""SimHash near-duplicates by one-wildcard segment variants (operator 2).

A 64-bit fingerprint is cut into two halves.  Two fingerprints that differ
in at most three bits have a half in which they differ in at most one bit,
so they share that half, or share it once the differing bit is wild.  Each
*distinct* fingerprint is indexed under its two halves and their 64
one-wildcard variants; an equality join on these keys gives candidates, and
the distance of each candidate pair is checked.

A key with more than ``PAIR_LIMIT`` members (many near copies share a half)
is not expanded into pairs.  Its members meet instead at the points around
their *other* half, which links the same texts in a number of rows that is
linear in the members:

* halves equal: points within two bits of the other half; everybody at a
  point that somebody reaches with one bit is linked to that member (at most
  1 + 2 bits apart);
* halves differing in the wild bit: points within one bit; everybody at a
  point is linked to its smallest member (at most 1 + 1 + 1 bits apart).
  A pair that differs in the wild bit and in two bits of the other half
  meets half way.

Both ways find every link of a key up to connectivity, so components are
exact.

Defined results
    * null text and text without words have fingerprint zero and are linked
      like any other;
    * repeated rows get a row each; a null ``doc_id`` never is the smallest
      unless all of its component are null;
    * an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortlens.llm.common import staged
from cohortlens.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 3
PAIR_LIMIT = 64
_SLICE = 1 << 16
_HALF = 0xFFFFFFFF


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = 42) -> int:
    """64 majority bits of the shingle hashes of one text, as a signed integer."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    bits, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SLICE):
        part = zip(starts[at : at + _SLICE], ends[at : at + _SLICE])
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(starts), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, keep: Sequence[str], name: str = "__cl_fp", words: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the fingerprint of ``text`` (bigint); the text goes to the workers once."""
    keep = list(keep)
    column = "text" if "text" in keep and isinstance(docs.schema["text"].dataType, StringType) else "__cl_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.int64())], [*keep, name])

    out = docs.select(*keep).withColumn(name, F.lit(0).cast("bigint")).schema
    sent = docs.select(*keep) if column == "text" else docs.withColumn(column, F.col("text").cast("string")).select(*keep, column)
    return sent.mapInArrow(run, out)


def _halves(fp: str) -> tuple[Column, Column]:
    return F.col(fp).bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(F.col(fp), 32)


def _variants() -> Column:
    """The 66 keys of a fingerprint: (half, wild bit) above 2^32, the half's value below."""
    keys = []
    for half, value in enumerate(_halves("fp")):
        for wild in range(33):
            mask = _HALF if wild == 0 else _HALF & ~(1 << (wild - 1))
            keys.append(F.lit((half * 33 + wild) << 32) + value.bitwiseAND(F.lit(mask)))
    return F.array(*keys)


def _differs_as_keyed(max_bits: int) -> Column:
    """Whether a and b are linked and the key is the one that is to find them."""
    code = F.shiftrightunsigned(F.col("key"), 32)
    half, wild = F.expr("int(key >> 32) div 33"), (code % 33).cast("int")
    far = F.col("a").bitwiseXOR(F.col("b"))
    part = F.when(half == 0, far.bitwiseAND(F.lit(_HALF))).otherwise(F.shiftrightunsigned(far, 32))
    here = F.when(wild == 0, part == 0).otherwise(part == F.expr("shiftleft(1L, greatest(0, int((key >> 32) % 33) - 1))"))
    return here & (F.bit_count(far) <= max_bits)


def _hot_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links inside keys with many members; ``members``: key, fp."""
    around = [0, *(1 << i for i in range(32))]
    beyond = [(1 << i) | (1 << j) for i, j in combinations(range(32), 2)]
    low, high = _halves("fp")
    wild = F.expr("int((key >> 32) % 33)")
    masks = F.when(wild == 0, F.array(*map(F.lit, around + beyond)).cast("array<bigint>")).otherwise(
        F.array(*map(F.lit, around)).cast("array<bigint>")
    )
    other = F.when(F.expr("int(key >> 32) div 33") == 0, high).otherwise(low)
    spread = (
        members.withColumn("other", other)
        .withColumn("mask", F.explode(masks))
        .select("key", "fp", F.col("other").bitwiseXOR(F.col("mask")).alias("point"), (F.bit_count("mask") <= 1).alias("near"))
    )
    centre = spread.where("near").groupBy("key", "point").agg(F.min("fp").alias("b"))
    return (
        spread.join(centre, ["key", "point"])
        .where("fp <> b")
        .select(F.col("fp").alias("a"), "b")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )


def links(distinct: DataFrame, max_bits: int = MAX_BITS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that keep exact components."""
    if max_bits != 3:
        raise ValueError("two halves with one wildcard serve a distance of exactly 3 bits")
    # 66 rows per fingerprint go through one exchange, which counting and joining share;
    # both numbers of partitions are given, as the few bytes before it say nothing of the rows after
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = distinct.repartition(n).select("fp", F.explode(_variants()).alias("key")).repartition(n, "key")
    # distinct fingerprints: a key is shared when its smallest and largest differ (this reads fp, so both sides
    # of the join need the same exchange)
    ends = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    members = staged(index.join(ends.where("low < high").select("key", "n").hint("merge"), "key"), "simhash-members")
    few = members.where(F.col("n") <= pair_limit)
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where("a < b")
        .where(_differs_as_keyed(max_bits))
        .select("a", "b")
    )
    many = _hot_links(members.where(F.col("n") > pair_limit).select("key", "fp"), max_bits)
    return pairs.union(many).distinct()


def _classes(rows: DataFrame, max_bits: int, pair_limit: int) -> DataFrame:
    """fp, component_id, keep_fp for the staged ``rows`` (doc_id, fp)."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(staged(links(nodes.select("fp"), max_bits, pair_limit), "simhash-links"))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = staged(rooted, "simhash-roots")
    # the smallest id stays; a null id counts as largest
    first = F.struct(F.col("least").isNull().alias("no_id"), "least", "fp")
    top = rooted.groupBy("root").agg(F.min(first).alias("top"))
    return rooted.join(top, "root").select("fp", F.col("top.least").alias("component_id"), F.col("top.fp").alias("keep_fp"))


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS, pair_limit: int = PAIR_LIMIT
) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = staged(with_fingerprint(ids, ["doc_id"], "fp", words), "fingerprints")
    classes = _classes(rows, max_bits, pair_limit)
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS, pair_limit: int = PAIR_LIMIT
) -> DataFrame:
    """One row of each component (the smallest doc_id), with all its columns."""
    cols = docs.columns
    keyed = staged(with_fingerprint(docs, cols, words=words), "with-fingerprints")
    rows = keyed.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("__cl_fp").alias("fp"))
    stay = (
        _classes(rows, max_bits, pair_limit)
        .where("fp = keep_fp")
        .select(F.col("fp").alias("__cl_keep"), F.col("component_id").alias("__cl_id"))
    )
    same = (F.col("__cl_fp") == F.col("__cl_keep")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__cl_id"))
    return keyed.join(stay, same, "left_semi").dropDuplicates(["__cl_fp", "doc_id"]).select(*cols)
