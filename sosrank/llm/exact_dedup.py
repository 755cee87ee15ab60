"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a table of one row a distinct text: its SHA-256 digest and the id of the document that stays, bucketed
and sorted by digest. A batch of new documents is reduced to one row a digest (combined before the shuffle, so a
group of copies of any size is one row a task), anti-joined with the index by sort-merge join, and the digests that
are new are appended. Texts never travel: they leave the scan as 32-byte digests.

Results in odd cases: null text counts as empty, and empty texts are copies of each other; among rows of one text
the smallest id stays (a null id only if the text has no other); rows repeated with the same id are copies, and one
of them stays; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sosrank.llm.common import BLANKS, id_text, written

def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A bucketed, sorted table ``(digest binary, keep_id, batch)`` that grows by append.

    ``name`` is a table of the session's catalog (a persistent metastore keeps it over sessions); ``location``,
    where given, is the shared folder of its files. ``buckets`` is set for good with the first batch; by default it is
    the session's number of shuffle partitions, so that it fits the size that the session was set up for.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, location: str | None = None):
        self.spark, self.name, self.location = spark, name, location
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """One file a bucket: rows are dealt by the bucketing hash before they are sorted and written."""
        writer = (rows.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
                  .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append"))
        if self.location:
            writer = writer.option("path", self.location)
        writer.saveAsTable(self.name)

    def add(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Add a batch ``(doc_id, row_id, digest)``; returns its groups with what the index now keeps for each.

        Result: ``digest, keep_id, keep_row, group_size``; ``keep_row`` is null where an earlier batch holds the
        text, so that every copy in this batch goes. Under its name a batch can be added again, as after a job that
        failed later on: texts that it brought itself are still its own, and none is stored twice.
        """
        batch = batch or uuid.uuid4().hex
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
        groups = (digests.groupBy("digest")
                  .agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
                  .select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("keep_row"),
                          "group_size"))
        groups = written(groups, "groups")
        if not self.exists():
            self.append(groups.limit(0), batch)
        own = self.read().filter(F.col("batch") == batch).select("digest")
        held = self.read().filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("held_id"))
        # the survivors are written aside first: a table can't be read and appended to in one job
        fresh = written(groups.hint("merge").join(held.hint("merge"), "digest", "left_anti"), "fresh")
        known = (groups.hint("merge").join(held, "digest")
                 .select("digest", F.col("held_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"),
                         "group_size"))
        out = written(fresh.unionByName(known), "resolved")
        stored = written(fresh.hint("merge").join(own.hint("merge"), "digest", "left_anti"), "stored")
        self.append(stored, batch)
        return out

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row_id, digest)``, written once so that row numbers and digests are the same in every later use."""
    rows = id_text(docs, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias("row_id"), digest(F.col("text")).alias("digest"))
    return written(rows, "digests")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text",
                batch: str | None = None, batches: int = 1) -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    With an ``index`` the documents are one batch (``batch`` names it), held against all batches added before as well:
    ``kept`` is then false for every copy of an indexed text. Without one, a new index takes them in ``batches``
    batches of ascending ids, and is dropped.
    """
    spark = docs.sparkSession
    digests = digests_of(docs, id_col, text_col)
    if index is not None:
        groups = index.add(digests, batch)
    else:
        index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
        groups = reduce(DataFrame.unionByName, [index.add(part, str(i))
                                                for i, part in enumerate(_ascending(digests, batches))])
        if batches > 1:  # the batch that brought a text tells which row stays; the others only count its copies
            brought = F.col("keep_row").isNotNull()
            groups = groups.groupBy("digest").agg(
                F.max(F.when(brought, F.struct("keep_id", "keep_row"))).alias("k"),
                F.sum("group_size").alias("group_size")).select("digest", "k.keep_id", "k.keep_row", "group_size")
        index.drop()
    # both sides are shuffled, so that AQE can split the partition of a text with very many copies
    return (digests.join(groups.hint("merge"), "digest")
            .select("doc_id", "keep_id", F.col("group_size").cast("long"),
                    F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def _ascending(digests: DataFrame, batches: int) -> list[DataFrame]:
    """Batches of ascending ids (null ids come last), about equal: where exactly they are cut changes no result."""
    if batches == 1:
        return [digests]
    shares = F.array(*[F.lit(i / batches) for i in range(1, batches)])
    cuts = sorted(set(digests.agg(F.percentile_approx("doc_id", shares)).first()[0] or []))
    out, low = [], F.lit(True)
    for cut in cuts:
        below = F.coalesce(F.col("doc_id") < cut, F.lit(False))
        out.append(digests.filter(low & below))
        low = ~below
    return [*out, digests.filter(low)]


#: DuckDB: the same groups; rows are distinguished by their id.
ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept,
       text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
