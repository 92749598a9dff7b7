"""Line de-duplication: a suffix array over line numbers by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import text as tx
from faultline.session import materialise

LINE_SCHEMA = "doc_id long, line int, hash long, words int, before long"
RUN = "struct<first:int,lines:int,source_id:long,source_line:int>"


def line_rows(docs: DataFrame) -> DataFrame:
    """Every line with a word: its place among those of its text, hash, words, words before it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for row, _, data, offsets in tx.text_slices(batch, "text"):
                starts, ends, words, text = _lines(data, offsets)
                first = np.searchsorted(text, np.arange(len(offsets)))
                place = np.arange(len(text)) - first[text]
                total = np.concatenate([[0], np.cumsum(words)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row + text]),
                        pa.array(place, pa.int32()),
                        pa.array(tx.span_hashes(data, starts, ends).view(np.int64)),
                        pa.array(words, pa.int32()),
                        pa.array(total[:-1] - total[first[text]], pa.int64()),
                    ],
                    ["doc_id", "line", "hash", "words", "before"],
                )

    return docs.mapInArrow(cut, LINE_SCHEMA)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, word counts and text numbers of the lines with a word."""
    breaks = data == 10
    cut = np.union1d(np.flatnonzero(breaks) + 1, offsets)
    starts, ends = cut[:-1], cut[1:].copy()
    ends -= breaks[np.maximum(ends - 1, 0)] & (ends > starts)
    word, _, _ = tx.word_bounds(data, offsets, tx.NOT_SPACE)
    words = np.searchsorted(word, ends) - np.searchsorted(word, starts)
    some = words > 0
    starts, ends, words = starts[some], ends[some], words[some]
    return starts, ends, words, np.searchsorted(offsets, starts, "right") - 1


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, line, size, first): windows that repeat an earlier one; they cover all such runs.

    ``rank`` numbers the distinct windows in their sorted order, so sorting suffixes by it
    is the suffix array to that depth; the members of a rank are the interval whose common
    prefix has at least ``size`` lines. A round pairs the rank of a window with that of
    the window after it, groups the pairs, and sorts what occurs twice. Windows that
    occur once are dropped; so a round has only what is still repeated. Doubling ends
    when all of those have ``min_words`` words. Between two rounds, a window of any other
    length is the pair of the ranks at its start and at its end, which overlap. Only those
    are made that are too short without their first or their last line: each line of a
    repeated run is in one of these, and they have at most ``min_words`` lines.
    """
    lines = materialise(line_rows(docs), "lines")
    place = F.struct("doc_id", "line")
    classes = lines.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    # written, so that both sides of the join are dealt out and a common line can be split
    classes = materialise(classes.where("n > 1").select("hash", "first"), "line-classes")
    level = materialise(
        lines.join(classes, "hash").withColumnRenamed("hash", "rank"), "windows"
    )
    size, found = 1, []
    while True:
        enough = F.col("words") >= min_words
        later = F.struct("doc_id", "line") > F.col("first")
        found.append(
            level.where(enough & later).select("doc_id", "line", F.lit(size).alias("size"), "first")
        )
        if not level.where(~enough).take(1):
            break
        for other in range(size + 1, min(2 * size - 1, min_words) + 1):
            found.append(_between(level, size, other, min_words))
        after = level.select(
            "doc_id",
            (F.col("line") - size).alias("line"),
            F.col("rank").alias("next"),
            F.col("words").alias("more"),
        )
        pairs = materialise(
            level.drop("first")
            .join(after, ["doc_id", "line"])
            .withColumn("words", F.col("words") + F.col("more"))
            .drop("more"),
            "window-pairs",
        )
        classes = (
            pairs.groupBy("rank", "next")
            .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .drop("n")
        )
        ranked = materialise(
            classes.orderBy("rank", "next").withColumn("new", F.monotonically_increasing_id()),
            "window-ranks",
        )
        level = materialise(
            pairs.join(ranked, ["rank", "next"]).drop("rank", "next").withColumnRenamed("new", "rank"),
            "windows",
        )
        size *= 2
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _between(level: DataFrame, size: int, other: int, min_words: int) -> DataFrame:
    """Repeated windows of ``other`` lines, from ``size`` to twice that, with a part that is too short."""
    tail = level.select(
        "doc_id",
        (F.col("line") - (other - size)).alias("line"),
        F.col("rank").alias("next"),
        F.col("words").alias("more"),
        F.col("before").alias("behind"),
    )
    words = F.col("behind") + F.col("more") - F.col("before")
    short = (F.col("words") < min_words) | (F.col("more") < min_words)
    pairs = materialise(
        level.drop("first")
        .join(tail, ["doc_id", "line"])
        .where(short & (words >= min_words))
        .select("doc_id", "line", "rank", "next"),
        "window-pairs",
    )
    classes = pairs.groupBy("rank", "next").agg(
        F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    classes = materialise(classes.where("n > 1").drop("n"), "window-classes")
    later = F.struct("doc_id", "line") > F.col("first")
    return (
        pairs.join(classes, ["rank", "next"])
        .where(later)
        .select("doc_id", "line", F.lit(other).alias("size"), "first")
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5
) -> DataFrame:
    """Replaces the text by what is left of it; adds n_lines, n_deleted and runs.

    A line goes if it lies in a run of lines of any length that has at least
    ``min_words`` words and occurred before, by id and line. ``runs`` are the stretches
    deleted (place among the lines with a word, number of lines) with the place of the
    earlier copy of their first line. Lines without a word are not counted and stay.
    A null text stays null with no lines. Rows with a null id stay as they are. Rows of
    one id are one document: they do not delete each other's lines at the same place.
    Columns named like the new ones are replaced. An empty table gives no rows.
    """
    names = ["n_lines", "n_deleted", "runs"]
    kept = [c for c in docs.columns if c not in names]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    windows = repeated_windows(own.where("doc_id is not null and text is not null"), min_words)
    deleted = (
        windows.select(
            "doc_id",
            F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k"),
            "line",
            "first",
        )
        .groupBy("doc_id", (F.col("line") + F.col("k")).cast("int").alias("line"))
        .agg(F.min(F.struct("first.doc_id", (F.col("first.line") + F.col("k")).alias("line"))).alias("first"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("line", "first"))).alias("found"))
        .withColumnRenamed("doc_id", "_id")
    )
    rows = docs.select(*kept).join(
        deleted.withColumnRenamed("found", "_found"),
        F.col(id_col).cast("long") == F.col("_id"),
        "left",
    )
    run = pa.list_(
        pa.struct(
            [("first", pa.int32()), ("lines", pa.int32()), ("source_id", pa.int64()), ("source_line", pa.int32())]
        )
    )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone, runs = [], [], [], []
            for text, found in zip(batch.column(text_col), batch.column("_found"), strict=True):
                text, found = text.as_py(), found.as_py() or []
                lines = [] if text is None else text.split("\n")
                worded = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
                found = [x for x in found if x["line"] < len(worded)]
                if found:
                    drop = {worded[x["line"]] for x in found}
                    text = "\n".join(x for k, x in enumerate(lines) if k not in drop)
                texts.append(text)
                counts.append(len(worded))
                gone.append(len(found))
                runs.append(_runs(found))
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in kept]
            columns += [pa.array(counts, pa.int32()), pa.array(gone, pa.int32()), pa.array(runs, run)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    schema += ["n_lines int, n_deleted int", f"runs array<{RUN}>"]
    return rows.select(*kept, "_found").mapInArrow(clean, ", ".join(schema))


def _runs(found: list[dict]) -> list[dict]:
    runs: list[dict] = []
    for x in found:
        if runs and runs[-1]["first"] + runs[-1]["lines"] == x["line"]:
            runs[-1]["lines"] += 1
        else:
            runs.append(
                {
                    "first": x["line"],
                    "lines": 1,
                    "source_id": x["first"]["doc_id"],
                    "source_line": x["first"]["line"],
                }
            )
    return runs
