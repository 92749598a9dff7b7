"""Report text from files, folders and form rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.functions import text as t

_FOLDER = r"([^/]+)/[^/]+$"
_NAME = r"([^/]+)$"


def media_files(files: DataFrame) -> DataFrame:
    """Image and video files of a listing with a ``path``: ``kind`` and folder added."""
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    kind = F.when(suffix.isin(lx.IMAGE_SUFFIXES), "image").when(suffix.isin(lx.VIDEO_SUFFIXES), "video")
    return files.withColumns({"kind": kind, "label": F.regexp_extract("path", _FOLDER, 1)}).filter(
        F.col("kind").isNotNull()
    )


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """Image and video files below ``path``; only file metadata is read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return media_files(listing.select("path", "modificationTime", "length"))


def write_files(files: DataFrame, root: str) -> None:
    """Writes ``path`` (below ``root``), ``content`` (binary) rows as files, each by the task that has it.

    A file is written under another name first, so a task that is run again leaves whole files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(root) if "://" in root else (LocalFileSystem(), root.removeprefix("file:"))
        done = 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                place = f"{base}/{path}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                part = f"{place}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, place)
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    files.select("path", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """``report_id, raw_text, attachments`` from text files and report folders.

    A folder with an ``email.txt`` is one report with the folder's media; any
    other text file is a report of its own.
    """
    texts = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.txt")
        .text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    name = F.regexp_extract("path", _NAME, 1)
    in_folder = name == "email.txt"
    reports = texts.select(
        F.when(in_folder, F.regexp_extract("path", _FOLDER, 1))
        .otherwise(F.regexp_replace(name, r"\.txt$", ""))
        .alias("report_id"),
        F.col("value").alias("raw_text"),
        F.when(in_folder, F.regexp_extract("path", r"^(?:file:)?/*(.*)/[^/]+$", 1)).alias("_folder"),
    )
    media = (
        attachments(spark, path)
        .select(F.regexp_extract("path", r"^(?:file:)?/*(.*)/[^/]+$", 1).alias("_folder"), "path")
        .groupBy("_folder")
        .agg(F.array_sort(F.collect_list("path")).alias("attachments"))
    )
    return reports.join(media, "_folder", "left").select(
        "report_id", "raw_text", F.coalesce("attachments", F.array().cast("array<string>")).alias("attachments")
    )


def form_reports(forms: DataFrame) -> DataFrame:
    """Form rows to report text; ``raw_text`` is empty without title and summary."""
    title, summary, reporter = (
        t.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "summary", "reporter")
    )
    entered = F.filter(
        F.transform(t.lines(F.coalesce("steps", F.lit(""))), t.strip), lambda s: s != ""
    )
    numbered = F.transform(
        entered,
        lambda s, i: F.concat(
            (i + 1).cast("string"),
            F.lit(". "),
            F.regexp_replace(s, r"(?U)^\s*(?:\d+[\.\)]\s*|[-*]\s*)", ""),
        ),
    )
    parts = F.array_compact(
        F.array(
            F.when(reporter != "", F.concat(F.lit("From: "), reporter)),
            F.when(title != "", F.concat(F.lit("Subject: "), title)),
            F.when((reporter != "") | (title != ""), F.lit("")),
            F.when(
                (F.col("platform") != "") & (F.col("platform") != "Unknown"),
                F.concat(F.lit("Platform: "), F.col("platform"), F.lit("\n")),
            ),
            F.when(summary != "", F.concat(F.lit("Description:\n"), summary, F.lit("\n"))),
            F.when(
                F.size(entered) > 0,
                F.concat(F.lit("Steps to Reproduce:\n"), F.array_join(numbered, "\n"), F.lit("\n")),
            ),
        )
    )
    text = F.concat(F.regexp_replace(F.array_join(parts, "\n"), r"(?U)\s+$", ""), F.lit("\n"))
    return forms.select(
        "report_id",
        F.when((title == "") & (summary == ""), "").otherwise(text).alias("raw_text"),
    )
