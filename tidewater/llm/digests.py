"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm.common import keep_rows, shared_folder, text_key, written

#: Characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def digest(text) -> F.Column:
    """Lowercase hex SHA-256 of the text without blanks; a missing text counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256)


class DigestIndex:
    """A table of the digests seen so far, bucketed and sorted by digest.

    A batch is reduced to one row per digest (partial counts before the shuffle, so a text that fills a third of the
    batch is one row per task), compared with the index by a sort-merge anti-join that does not shuffle the index, and
    what is new is appended.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64, path: str | None = None):
        self.spark, self.table, self.buckets, self.path = spark, table, buckets, path
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], "digest string, keep_id long, keep_row long, batch string"))

    def _append(self, rows: DataFrame) -> None:
        out = rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        (out.option("path", self.path) if self.path else out).saveAsTable(self.table)

    def drop(self) -> None:
        """Take the table out of the catalog; results of :meth:`absorb` do not need it any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def absorb(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Decide which rows of ``docs`` (doc_id, text) stay, and add their digests to the index.

        Of equal texts the row with the most code points stays, then the smallest ``doc_id``, then any one of repeated
        rows; a row without ``doc_id`` yields to one with it. A text known from an earlier batch goes, and ``keep_id``
        names the document that brought it. Gives one row per row of ``docs``: doc_id, keep_id, group_size (rows of
        this batch with that text), kept, text_sha256. Other columns of ``docs`` are ignored. An empty batch gives no rows.

        A ``batch`` that has a name may be absorbed again, as after a failure: digests that it brought itself count as new,
        and none is added twice.
        """
        batch = batch or uuid.uuid4().hex
        rows = written(
            docs.select(
                "doc_id", digest(F.col("text")).alias("digest"),
                F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                F.monotonically_increasing_id().alias("row"), text_key().alias("text_key"),
            ), "digests")
        best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("low"), (-F.col("row")).alias("row")))
        groups = written(
            rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", "group_size", (-F.col("best.low")).alias("keep_id"), (-F.col("best.row")).alias("keep_row")),
            "digest-groups")
        dealt = groups.repartition(self.buckets, "digest")  # as the index lies, whatever the number of shuffle partitions
        fresh = dealt.join(self.spark.table(self.table).hint("merge"), "digest", "left_anti")
        self._append(fresh.select("digest", "keep_id", "keep_row", F.lit(batch).alias("batch")))
        known = self.spark.table(self.table).hint("merge").select("digest", F.col("keep_id").alias("known_id"), "batch")
        own = F.col("batch") == batch
        verdicts = written(
            dealt.join(known, "digest").select(
                "digest", "group_size", F.when(own, F.col("keep_id")).otherwise(F.col("known_id")).alias("keep_id"),
                F.when(own, F.col("keep_row")).alias("keep_row")), "digest-verdicts")
        return rows.join(verdicts, "digest").select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.col("digest").alias("text_sha256"), "text_key")


def open_index(spark: SparkSession, name: str = "digest_index", buckets: int | None = None) -> DigestIndex:
    """A new, empty index whose files lie in the shared folder.

    It has as many buckets as the session has shuffle partitions, and 64 at least: a batch dealt out to more tasks than there
    are buckets would leave a small file for each task and bucket.
    """
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return DigestIndex(spark, f"{name}_{uuid.uuid4().hex}", buckets, shared_folder(spark, name))


def drop_repeats(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows that repeat ``doc_id`` and text, one stays."""
    return keep_rows(docs, index.absorb(docs).where("kept"))
