"""Exact de-duplication against a persistent index of text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import materialise

#: The characters that do not count, [\x20\x09-\x0D].
IGNORED = " \t\n\x0b\x0c\r"
INDEX_SCHEMA = "digest binary, keep_id long, chars long"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def open_index(spark: SparkSession, table: str, path: str, buckets: int = 64) -> None:
    """Registers the index at ``path``, bucketed and sorted by digest; keeps what is there."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({INDEX_SCHEMA.replace(' binary', ' BINARY')}) "
        f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS "
        f"LOCATION '{path}'"
    )


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), chars (code points of the text)."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"),
    )


def append_new(docs: DataFrame, table: str, id_col: str = "doc_id", text_col: str = "text"):
    """Adds the texts that the index lacks; one row per row of ``docs`` with the decision.

    Of equal texts the index's row stays; else the row with the most code points,
    then the smallest id. Columns: doc_id, keep_id, group_size (rows of this batch
    with the text), kept, digest. Null texts count as empty; a null id stays only if
    its text has no other; of rows with equal ids and texts all are kept or none.
    An empty table adds nothing.

    Equal digests are grouped before any join, so a group of copies is one row
    on the index's side; the join back is left to the skew handling of the
    adaptive planner.
    """
    spark = docs.sparkSession
    batch = materialise(digest_rows(docs, id_col, text_col), "digests")
    groups = batch.groupBy("digest").agg(
        F.max(F.struct("chars", (-F.col("doc_id")).alias("back"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = materialise(groups, "digest-groups")
    fresh = groups.hint("merge").join(spark.table(table), "digest", "left_anti")
    fresh = materialise(
        fresh.select(
            "digest", (-F.col("best.back")).alias("keep_id"), F.col("best.chars").alias("chars")
        ),
        "digest-new",
    )
    fresh.write.insertInto(table)
    known = materialise(
        groups.select("digest", "group_size").join(spark.table(table).hint("merge"), "digest"),
        "digest-known",
    )
    known = known.select("digest", "group_size", "keep_id")
    return batch.join(known, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )
