"""Exact deduplication against a persistent digest index (DataFrame functions only)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import WHITE_SPACE, fresh, lookup, materialise, shared_dir, table


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, points`` of every row.

    The digest is SHA-256 of the text without white space; null counts as empty. ``points``
    counts the code points of the original text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, WHITE_SPACE, ""), 256)).alias("digest"),
        F.length(text).cast("long").alias("points"),
    )


class DigestIndex:
    """A table of the digests seen so far, bucketed and sorted by digest.

    One row a digest: ``digest binary, keep_id long, group_size long`` (rows with that digest
    in the batch that brought it: later batches change neither, as what they bring of it goes).
    Bucketing means that a new batch is shuffled once, by
    digest, and the index not at all: the anti-join is a merge of sorted buckets. The number
    of buckets is fixed when the index is made; it should follow the planned corpus size.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.path = path or f"{shared_dir(spark)}/{name}"
        if not spark.catalog.tableExists(name):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.sql(
                f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{self.path}'"
            )
            self.buckets = n
        else:
            described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
            self.buckets = int(described["Num Buckets"])

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> DataFrame:
        """Add the digests of ``batch`` (from ``digests``, materialised) that are not there yet.

        Within the batch the row with most code points stays, then the smallest doc_id (null
        last). Returns ``batch`` with ``keep_id, group_size`` from the index.
        """
        order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"))
        # written first: the optimizer would push the anti-join below the aggregate, and every
        # row of a large group of copies, not one a task, would be shuffled to the same place
        groups = materialise(batch.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
        new = groups.select("digest", F.col("best.i").alias("keep_id"), "group_size").join(
            self.entries().select("digest").hint("merge"), "digest", "left_anti"
        )
        (
            new.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)
        # a digest is hot by the rows of this batch, whenever it came into the index
        own = groups.select("digest", F.col("group_size").alias("n")).join(self.entries().hint("merge"), "digest")
        return lookup(batch, materialise(own, "entries"), "digest", "n").drop("n")

    def forget(self) -> None:
        """Drop the table from the catalog; its files stay in their folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_groups(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Empty and null texts form one group. Rows that repeat both text and doc_id are all marked
    kept, as the columns cannot tell them apart. An empty table gives no rows. Extra columns
    are ignored. With ``index``, texts that an earlier batch brought keep that batch's row.
    """
    spark = docs.sparkSession
    own = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    found = own.append(materialise(digests(docs), "digests"))
    if index is None:
        own.forget()
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    Of rows that repeat both text and doc_id any one stays.
    """
    own, digest, i = fresh(docs, "own", "digest", "i")
    kept = materialise(exact_groups(docs, index).filter("kept").select(F.col("doc_id").alias(i), F.unhex("text_sha256").alias(digest)), "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn(own, F.unhex(F.sha2(F.translate(text, WHITE_SPACE, ""), 256)))
    stay = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(digest)), "left_semi")
    if kept.groupBy(i, digest).count().filter("count > 1").limit(1).count():
        stay = stay.dropDuplicates([own])
    return stay.drop(own)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
