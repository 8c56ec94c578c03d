"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by the SHA-256 of the text.  A new batch is reduced to one
row per digest, anti-joined to the index by sort-merge, and what is new is appended; then what the index holds is
looked up by sort-merge too.  Neither join shuffles the index.  Texts never travel for this: only (id, digest) does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilstone.llm.store import columns, free_name, fresh_path, partitions, written

COLUMNS = "digest BINARY, keep_id {id}, batch STRING"


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """Digests of all texts seen so far, with the id of the row that stays for each.

    path: folder of the index, kept between sessions; buckets: number of buckets, fixed when the
    index is made.  Reopening needs the same number of buckets and the same type of ids.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "BIGINT"):
        self.spark, self.path, self.buckets = spark, path or fresh_path(spark, "digest-index"), buckets or partitions(spark)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.schema = COLUMNS.format(id=id_type)
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {self.table} ({self.schema}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def rows(self) -> DataFrame:
        """The index as its files have it, without its buckets."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def known(self, groups: DataFrame) -> DataFrame:
        """``groups`` (one row a digest) with held_id and batch of those that the index holds.

        Both sides have a row a digest, so no key is common; only ``groups`` is shuffled, to the index's buckets.
        """
        held = self.spark.table(self.table).withColumnRenamed("keep_id", "held_id")
        return groups.join(held.hint("merge"), "digest")

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_id: str | None = None) -> DataFrame:
        """Takes in a batch; returns a row for each of its rows.

        Result: ``id_col``, digest, keep_id, group_size, kept.  Of equal texts in a batch the row with
        the largest id stays (null is smaller than any id; of rows that repeat the id as well, one);
        if an earlier batch held the text, its row stays.  group_size counts the equal texts of the
        batch.  Texts are hashed whole where they are read, however long.  A batch that comes again with
        its ``batch_id`` (a run that failed after appending, say) gets the same decisions and appends
        what is missing only.  An empty batch gives no rows.
        """
        name = batch_id or uuid.uuid4().hex
        d = written(batch.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
        groups = written(
            d.groupBy("digest").agg(F.max("id").alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("keep_row"), F.count(F.lit(1)).alias("group_size")),
            "digest-groups",
        )
        index = self.spark.table(self.table)
        fresh = groups.join(index.hint("merge"), "digest", "left_anti").select("digest", "keep_id", F.lit(name).alias("batch"))
        fresh.repartition(self.buckets, "digest").write.insertInto(self.table)
        own = F.col("batch") == name
        stays = self.known(groups).select("digest", "group_size", F.when(own, F.col("keep_id")).otherwise(F.col("held_id")).alias("keep_id"), F.when(own, F.col("keep_row")).alias("keep_row"))
        stays = written(stays, "digest-decisions")
        return d.join(stays, "digest").select(F.col("id").alias(id_col), "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))

    def drop(self) -> None:
        """Forgets the table's name in this session; the files stay, and so do results of ``add``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch_id: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one for each text that the index lacked.

    Which one stays is told in ``DigestIndex.add``.  Null texts are empty ones; of repeated rows one
    stays; any other columns are kept, whatever their names and types.  The join deals rows by
    (digest, id), so that a large group of copies doesn't meet in one task.  No rows in, no rows out.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession, id_type=docs.schema[id_col].dataType.simpleString())
    d, k, n = free_name(docs, "digest_key", "id_key", "copy_no")
    stay = index.add(docs, id_col, text_col, batch_id).where("kept").select(F.col("digest").alias(d), F.xxhash64(id_col).alias(k))
    if own:
        index.drop()
    w = Window.partitionBy(d, k).orderBy(d)
    return (
        docs.withColumns({d: digest(F.col(text_col)), k: F.xxhash64(id_col)})
        .join(stay, [d, k], "left_semi")
        .withColumn(n, F.row_number().over(w))
        .where(F.col(n) == 1)
        .select(*columns(docs))
    )
