"""Corrections, the repository manifest, and the output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline import schemas
from faultline.functions import text as t

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**_CSV).schema(schemas.CORRECTIONS).csv(path)


def corrections_as_issues(corrections: DataFrame) -> DataFrame:
    """Usable corrections in the shape of labelled issues."""
    c = {n: t.strip(F.coalesce(F.col(n), F.lit(""))) for n in ("corrected_component", "title", "bug_text")}
    first_line = F.left(F.split_part(c["bug_text"], F.lit("\n"), F.lit(1)), F.lit(120))
    return corrections.filter((c["corrected_component"] != "") & (c["bug_text"] != "")).select(
        F.concat(F.lit("CORRECTION-"), F.coalesce("bug_hash", F.lit(""))).alias("key"),
        F.coalesce(t.blank_to_null(c["title"]), first_line).alias("summary"),
        c["bug_text"].alias("description"),
        c["corrected_component"].alias("component"),
        F.lit(None).cast("string").alias("assignee"),
        F.lit("Unknown").alias("priority"),
        F.col("timestamp").alias("created"),
    )


def correction_rows(reviews: DataFrame, catch_all: str = lx.CATCH_ALL) -> DataFrame:
    """Component overrides worth learning from, one row each, ready to append."""
    text = F.concat_ws("\n\n", "title", "description", "actual_result")
    return reviews.filter(
        (F.col("edited_component") != F.col("predicted_component"))
        & (F.col("edited_component") != catch_all)
    ).select(
        F.col("timestamp").cast("string").alias("timestamp"),
        F.substring(F.md5(text), 1, 12).alias("bug_hash"),
        "predicted_component",
        F.col("edited_component").alias("corrected_component"),
        F.format_string("%.3f", F.col("confidence")).alias("confidence_at_prediction"),
        "title",
        text.alias("bug_text"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per repository of the manifest."""
    rows = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)
    return rows.select(F.inline("repos")).withColumn(
        "owns_features", F.coalesce("owns_features", F.array().cast("array<string>"))
    )


def repos_by_team(repos: DataFrame, team: str = "team", name: str = "name") -> DataFrame:
    """Repositories numbered within their team, in order of name."""
    order = Window.partitionBy(team).orderBy(name)
    return repos.select(team, name).withColumn("place", F.row_number().over(order))


def repos_for_team(repos: DataFrame, team: str) -> DataFrame:
    return repos.filter(F.col("team") == team)


# --- outputs -----------------------------------------------------------------


def write_drafts(drafts: DataFrame, path: str, run: Column) -> None:
    """One JSON document per report, below the date of the run."""
    drafts.withColumns({"generated_at": run.cast("string"), "run_date": run.cast("date")}).write.mode(
        "append"
    ).partitionBy("run_date").json(path)


def write_index(index: DataFrame, path: str) -> None:
    """The vector index. Rows of one label are spread over several tasks, so a
    frequent label does not become one long write."""
    index.repartition("label", F.pmod(F.xxhash64("key"), F.lit(16))).write.mode("overwrite").partitionBy(
        "label"
    ).parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").options(**_CSV).csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**_CSV).schema(schemas.TICKET_EVENTS).csv(path)


def snapshot(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("media_paths", F.array_join("media_paths", ";"))


def write_snapshot(tickets: DataFrame, path: str) -> None:
    snapshot(tickets).write.mode("overwrite").options(**_CSV).csv(path)


def append_corrections(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").options(**_CSV).csv(path)
