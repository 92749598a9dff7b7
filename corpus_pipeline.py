"""A corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, all but the
last with the columns of documents. ``run`` writes every stage to the shared folder
and reads it back, so a lost executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontaminate, jaccard, language, lines, packing
from faultline.llm import text as tx
from faultline.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Mean over the words of their most probable language's probability, below which a text is in none.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or in no known language; ``lang`` becomes the predicted one.

    Learned from the given labels of the stage's own input; without labels every
    document is in no known language.
    """
    tx.small_batches(spark)
    model = language.fit(docs)
    found = language.identify(docs, model, prefix="crf_")
    kept = (F.col("crf_lang_pred") != language.UNKNOWN) & (F.col("crf_certainty") >= LEAST_SCORE)
    return found.where(kept).withColumn("lang", F.col("crf_lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs; documents of which nothing is left go."""
    tx.small_batches(spark)
    found = lines.drop_repeated_lines(docs)
    left = F.regexp_like(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))
    cut = F.col("n_deleted") > 0
    return (
        found.where(~cut | left)
        .withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*COLUMNS)
    )


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicate documents."""
    tx.small_batches(spark)
    groups = jaccard.link_documents(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item."""
    tx.small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_windows(docs, items).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids."""
    tx.small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("documents", dedup_documents),
    ("benchmark", drop_contaminated),
    ("packing", pack_sequences),
]
#: Language model, tokeniser and packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
