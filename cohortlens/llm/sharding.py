"""Sharding by histogram sort: shards of near equal bytes (operator 5).

Rows are ordered by a 128-bit key, the hash of the text and then a hash of
``doc_id`` and row number, so equal texts stand together and yet can be
divided, also where they share their ``doc_id``.  The keys
where one shard ends and the next begins are found by counting: the exact
bytes below evenly spaced candidate boundaries (hexadecimal prefixes of the
key) are counted across all partitions, the cells that hold a wanted
splitter are divided further, and so on until every splitter is within
``tolerance`` of its target or no further division is possible.  Then rows
are exchanged once.

Each shard is itself ``PARTS`` key ranges found by the same counting; a range
is the unit of the exchange, and a row's slot is the number of rows in
earlier ranges of its shard plus its place in the range.  No task holds more
than a range, also when a third of all texts are equal.

Only DataFrame functions run.  To the driver go at most 4 096 counts first
and 256 per open cell in later rounds (shards * PARTS cells at most), and two
numbers per range at the end.

Defined results
    * a null text has 0 bytes and counts as empty; each row weighs 16 more;
    * repeated rows are kept, each in a slot of its own, and are divided as
      other rows are;
    * an empty table gives an empty result; extra columns are kept by
      ``shard_documents``, but names that begin with ``__cl_`` are its own and
      its folders are named by ``shard_col``, which ``docs`` must not hold.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import numbered, staged, text_or_empty

SHARDS = 40
PARTS = 16
TOLERANCE = 0.0005
KEY_DIGITS = 32
_FIRST, _NEXT = 3, 2  # digits added by the first and by later rounds


def _hex(col: Column) -> Column:
    """A bigint as 16 hexadecimal digits that sort as the number does."""
    return F.lpad(F.hex(col.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def sort_key(row: str = "__cl_row") -> Column:
    return F.concat(_hex(F.xxhash64(text_or_empty("text"))), _hex(F.xxhash64("doc_id", row)))


def find_splitters(rows: DataFrame, targets: list[float], tolerance: float) -> tuple[list[str], list[int]]:
    """Key prefixes with about ``targets`` bytes below them, and rounds' counts.

    ``rows``: key, size.  A splitter ``s`` puts keys ``< s`` below it (string
    order, so a prefix stands before every key that extends it).
    """
    found: dict[int, str] = {}
    cells = {"": (0, list(range(len(targets))))}  # open prefix -> (bytes below it, targets inside)
    digits, counts = 0, []
    while cells and digits < KEY_DIGITS:
        step = _FIRST if digits == 0 else _NEXT
        inside = rows if digits == 0 else rows.where(F.substring("key", 1, digits).isin(list(cells)))
        histogram = (
            inside.groupBy(F.substring("key", 1, digits + step).alias("cell"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
            .orderBy("cell")
            .collect()
        )
        counts.append(len(histogram))
        by_cell: dict[str, list] = {}
        for r in histogram:
            by_cell.setdefault(r["cell"][:digits], []).append(r)
        refined: dict[str, tuple[int, list[int]]] = {}
        for prefix, (below, wanted) in cells.items():
            here = by_cell.get(prefix, [])
            ends, total = [], below
            for r in here:
                total += r["bytes"]
                ends.append(total)
            for t in wanted:
                i = min(bisect.bisect_left(ends, targets[t]), len(here) - 1)
                low, high = (ends[i - 1] if i else below), ends[i]
                near_high = high - targets[t] <= targets[t] - low
                last = digits + step >= KEY_DIGITS or here[i]["n"] == 1
                if last or min(high - targets[t], targets[t] - low) <= tolerance:
                    # a prefix ends where its last key does: "g" stands after every hexadecimal digit
                    found[t] = here[i]["cell"] + "g" if near_high else here[i]["cell"]
                else:
                    refined.setdefault(here[i]["cell"], (low, []))[1].append(t)
        cells, digits = refined, digits + step
    return sorted(found.values()), counts


def assign(rows: DataFrame, shards: int = SHARDS, parts: int = PARTS, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` (key, size and others, staged) with shard and slot.

    ``tolerance`` is the error of a splitter as a share of a shard's bytes.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("bigint"))
    ranges = shards * parts
    splitters, _ = find_splitters(rows, [total * i / ranges for i in range(1, ranges)], tolerance * total / shards)
    # splitters by the cell of their first digits: at most 4 096 rows, so a broadcast is bounded
    cells = [f"{c:0{_FIRST}x}".upper() for c in range(16**_FIRST)]
    inside: dict[str, list[str]] = {c: [] for c in cells}
    for s in splitters:
        inside[s[:_FIRST]].append(s)
    lookup = spark.createDataFrame(
        [(c, bisect.bisect_left(splitters, c), inside[c]) for c in cells], "__cl_cell string, __cl_base int, __cl_split array<string>"
    )
    passed = F.size(F.filter("__cl_split", lambda s: s <= F.col("key")))
    ranged = (
        rows.join(F.broadcast(lookup), F.substring("key", 1, _FIRST) == F.col("__cl_cell"))
        .withColumn("__cl_range", F.col("__cl_base") + passed)
        .drop("__cl_cell", "__cl_base", "__cl_split")
    )
    sizes = {r["__cl_range"]: r["n"] for r in ranged.groupBy("__cl_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, before = [], 0
    for i in range(ranges):
        before = 0 if i % parts == 0 else before
        offsets.append((i, i // parts, before))
        before += sizes.get(i, 0)
    places = spark.createDataFrame(offsets, "__cl_range int, shard int, __cl_before bigint")
    nth = F.expr("row_number() OVER (PARTITION BY __cl_range ORDER BY key)")
    return (
        ranged.withColumn("__cl_nth", nth)
        .join(F.broadcast(places), "__cl_range")
        .withColumn("slot", F.col("__cl_before") + F.col("__cl_nth") - 1)
        .drop("__cl_range", "__cl_before", "__cl_nth")
    )


def histogram_shards(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = staged(
        numbered(docs.select("doc_id", "text")).select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 16).alias("size"),
            F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
            sort_key().alias("key"),
        ),
        "shard-keys",
    )
    return assign(rows, shards, parts, tolerance).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_documents(docs: DataFrame, path: str, shards: int = SHARDS, parts: int = PARTS, shard_col: str = "shard") -> None:
    """Write ``docs`` with all columns to ``path``: a folder per shard, ``parts`` files in it, each sorted by key."""
    if shard_col in docs.columns:
        raise ValueError(f"docs hold a column {shard_col!r}: name another shard_col")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 16
    # staged: a row keeps its number, and so its shard, when a lost task is run again
    keyed = staged(numbered(docs).withColumn("__cl_key", sort_key()).withColumn("__cl_size", size).drop("__cl_row"), "shard-rows")
    slim = keyed.select(F.col("__cl_key").alias("key"), F.col("__cl_size").alias("size"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    if not total:
        keyed.drop("__cl_key", "__cl_size").withColumn(shard_col, F.lit(0)).write.partitionBy(shard_col).parquet(path)
        return
    splitters, _ = find_splitters(slim, [total * i / shards for i in range(1, shards)], TOLERANCE * total / shards)
    shard = F.size(F.filter(F.array(*map(F.lit, splitters)), lambda s: s <= F.col("__cl_key")))
    placed = keyed.drop("__cl_size").withColumn(shard_col, shard)
    part = F.pmod(F.xxhash64("__cl_key"), F.lit(parts))
    dealt = placed.withColumn("__cl_part", part).repartition(shards * parts, shard_col, "__cl_part")
    dealt.sortWithinPartitions(shard_col, "__cl_key").drop("__cl_key", "__cl_part").write.partitionBy(shard_col).parquet(path)
