"""Search for plain text through a persisted trigram index.

Three tables below a path: the texts, sorted by id; the postings ``gram, id``, sorted by gram;
and the number of texts per gram. A search reads the statistics of its grams, intersects the
postings from the rarest gram on, fetches the candidates and tests them as the scan does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import materialise

#: Postings intersected at most; further grams of a long query rule out little more.
GRAMS = 6
#: Candidates fetched by their ids in the filter of the scan; more are joined.
LISTED = 2000


#: Characters whose grams are worked out at a time.
SLICE_CHARS = 1 << 20


def grams_of(docs: DataFrame, text: str) -> DataFrame:
    """``id, gram``: the trigrams of the lower-case text, each once a row; none of a shorter or null one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows, size = [], [], 0
            for row, value in enumerate(batch.column("low")):
                # a character is one number; three of them make one of 63 bits
                own.append(np.frombuffer(value.as_py().encode("utf-32-le"), "<u4").astype(np.uint64))
                rows.append(row)
                size += len(own[-1])
                if size >= SLICE_CHARS or row == batch.num_rows - 1:
                    yield _grams(batch.column("id"), own, rows)
                    own, rows, size = [], [], 0

    kind = docs.schema["id"]
    schema = T.StructType([T.StructField("id", kind.dataType), T.StructField("gram", T.StringType())])
    low = docs.select("id", F.lower(text).alias("low")).where("length(low) >= 3")
    return low.mapInArrow(cut, schema)


def _grams(ids: pa.Array, texts: list[np.ndarray], rows: list[int]) -> pa.RecordBatch:
    keys = [(x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:] for x in texts]
    names, code = np.unique(np.concatenate(keys), return_inverse=True)
    row = np.repeat(np.asarray(rows), [len(k) for k in keys])
    both = np.unique(row * len(names) + code)
    low = np.uint64((1 << 21) - 1)
    letters = np.stack([names >> np.uint64(42), (names >> np.uint64(21)) & low, names & low], axis=1).astype("<u4")
    plain = letters.tobytes().decode("utf-32-le")
    grams = pa.array([plain[k : k + 3] for k in range(0, len(plain), 3)], pa.string())
    columns = [ids.take(pa.array(both // len(names))), grams.take(pa.array(both % len(names)))]
    return pa.RecordBatch.from_arrays(columns, ["id", "gram"])


def build_index(docs: DataFrame, text: str, path: str, rows_per_file: int = 200_000) -> None:
    """Writes the index of ``docs`` (an ``id`` column, ``text`` and others) below ``path``.

    Null texts are kept and never found. Rows of one id are all found by it. Postings are
    dealt by ranges of gram and id, so a gram in every text lies in many files; repeats of a
    gram in a text are combined by the task that has the text, before anything is shuffled, and
    those of rows with one id where the ranges are sorted.
    """
    spark = docs.sparkSession
    docs.repartitionByRange("id").sortWithinPartitions("id").write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/texts")
    own = spark.read.parquet(f"{path}/texts")
    grams = materialise(grams_of(own, text), "grams")
    dealt = grams.repartitionByRange("gram", "id").distinct()
    dealt.select("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, words: list[str]) -> DataFrame | None:
    """Ids of the texts that hold all trigrams looked up for ``words``; None if they have none.

    The grams of the query are a short list, of which the rarest are read. Each join keeps
    the ids so far that are in the next list.
    """
    wanted = sorted({w.lower()[k : k + 3] for w in words for k in range(len(w.lower()) - 2)})
    if not wanted:
        return None
    counts = spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(wanted))
    known = {r["gram"]: r["n"] for r in counts.collect()}
    postings = spark.read.parquet(f"{path}/postings")
    rare = sorted(wanted, key=lambda g: (known.get(g, 0), g))[:GRAMS]
    if rare[0] not in known:
        return postings.select("id").limit(0)
    found = postings.where(F.col("gram") == rare[0]).select("id")
    for gram in rare[1:]:
        found = found.join(postings.where(F.col("gram") == gram).select("id"), "id", "left_semi")
    return materialise(found, "candidates")


def fetch(spark: SparkSession, path: str, ids: DataFrame | None) -> DataFrame:
    """The texts of the candidates; few ids go into the filter of the scan, which skips what it can."""
    texts = spark.read.parquet(f"{path}/texts")
    if ids is None:
        return texts
    few = [r["id"] for r in ids.limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return texts.where(F.col("id").isin(few))
    return texts.join(ids, "id", "left_semi")


def find_texts(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """The rows that may hold every one of ``words``, in any case: all that do, and few others.

    Pass them on to the exact test (:func:`faultline.sources.issues.text_search`,
    :func:`faultline.operators.mining.mine_grep`). Words of less than three characters rule
    nothing out; with no longer one every text is read. Lower-casing is Spark's on both sides.
    """
    low = [r["w"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.lower("w").alias("w")).collect()]
    return fetch(spark, path, candidates(spark, path, low))
