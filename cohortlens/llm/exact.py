"""Exact de-duplication against a persistent digest index (operator 3).

The index is a table bucketed and sorted by the SHA-256 digest of the text.
A batch is reduced to one row per digest (partial aggregation, only
digests and ids are shuffled), sort-merge anti-joined with the index, and
the new digests are appended; the index side is never shuffled because its
buckets already are the join's partitioning, and not sorted again while a
bucket is one file (``compact`` brings it back to that).

A whole table goes through the index in ``BATCHES`` batches of falling
``doc_id``, so that the text's largest id is indexed first and the later
batches lose their copies of it to the anti-join.

Defined results
    * null text counts as the empty text;
    * of equal texts in a batch the row with the largest ``doc_id`` stays
      (a null ``doc_id`` is smallest); of repeated rows with the same id and
      text exactly one stays;
    * a text that the index already holds is a duplicate of the indexed
      row: nothing of the batch stays, ``keep_id`` is the indexed id;
    * an index has one writer at a time; an append that fails leaves only
      uncommitted files, which are never read, so the batch can be added again;
    * an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import numbered, shared_path, staged, text_or_empty

BUCKETS = 16
BUCKET_ROWS = 2_000_000  # some 80 MB of digests and ids
BATCHES = 2


def buckets_for(rows: int) -> int:
    """Buckets of an index over ``rows`` rows: a power of two of at most ``BUCKET_ROWS`` each, ``BUCKETS`` at least."""
    return max(BUCKETS, 1 << (max(rows, 1) // BUCKET_ROWS).bit_length())


def digest_of(text) -> F.Column:
    """SHA-256 of the text in UTF-8 (null as empty), 32 bytes."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


class DigestIndex:
    """Digests seen so far, at ``path`` (created when missing).

    ``path`` lives in a folder that all executors share.  Opening the same
    path again, also from another session, continues the same index as long
    as ``buckets`` is the same.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def _append(self, digests: DataFrame) -> None:
        (
            digests.repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .option("path", self.path)
            .saveAsTable(self.table)
        )

    def compact(self, path: str) -> DigestIndex:
        """The same index at a new ``path`` with one sorted file per bucket."""
        fresh = DigestIndex(self.spark, path, self.buckets)
        fresh._append(self.spark.read.parquet(self.path))  # by path: a bucketed scan would take the place of the exchange
        return fresh

    def admit(self, rows: DataFrame) -> DataFrame:
        """Compare ``rows`` (doc_id, digest, __cl_row; staged) with the index and append what is new.

        One row per digest: digest, group_size (rows of this batch), keep_id,
        keep_row (null: the index held the digest before).
        """
        groups = rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "__cl_row")).alias("top"), F.count(F.lit(1)).alias("group_size")
        )
        index = self.rows()
        fresh = groups.join(index.hint("merge"), "digest", "left_anti").select(
            "digest", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.__cl_row").alias("keep_row")
        )
        known = groups.join(index.hint("merge"), "digest").select(
            "digest", "group_size", "keep_id", F.lit(None).cast("bigint").alias("keep_row")
        )
        verdicts = staged(fresh.unionByName(known), "digest-verdicts")
        self._append(verdicts.where(F.col("keep_row").isNotNull()).select("digest", "keep_id"))
        return verdicts

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """De-duplicate ``docs`` within itself and against the index, then append.

        Returns one row per row of ``docs``: doc_id, keep_id, group_size
        (rows of this batch with the text), kept, text_sha256.
        """
        rows = _digests(docs, id_col, text_col)
        return _judged(rows, self.admit(rows))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest_of(text_col).alias("digest"))
    return staged(numbered(rows), "digests")


def _judged(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    return rows.join(verdicts, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("__cl_row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, buckets: int | None = None, batches: int = BATCHES) -> DataFrame:
    """All of ``docs`` through a new index, in ``batches`` batches of falling ``doc_id``; group_size counts all batches."""
    spark = docs.sparkSession
    rows = _digests(docs, "doc_id", "text")
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", F.array(*map(F.lit, shares))).alias("cuts")).first()
    index = DigestIndex(spark, shared_path(spark, "digest-index"), buckets or buckets_for(seen["n"]))
    id_, above, verdicts = F.col("doc_id"), None, []
    for cut in [*dict.fromkeys(seen["cuts"] or []), None]:
        batch = F.lit(True) if cut is None else id_ >= cut
        if above is not None:
            batch = batch & (id_.isNull() | (id_ < above))
        verdicts.append(index.admit(rows.where(batch)))
        above = cut
    total = reduce(DataFrame.unionByName, verdicts).groupBy("digest").agg(
        F.sum("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row")
    )
    return _judged(rows, total)


def drop_exact_duplicates(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    cols = docs.columns
    kept = (
        exact_duplicates(docs, buckets)
        .where("kept")
        .select(F.col("doc_id").alias("__cl_id"), F.unhex("text_sha256").alias("__cl_sha"))
    )
    keyed = docs.withColumn("__cl_digest", digest_of("text"))
    return (
        keyed.join(
            kept,
            (F.col("__cl_digest") == F.col("__cl_sha")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__cl_id")),
            "left_semi",
        )
        .dropDuplicates(["__cl_digest", "doc_id"])
        .select(*cols)
    )
