"""Similar issues from vectors: recall, two sources, rerank, relevance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.functions import text as t
from faultline.functions import vectors as v
from faultline.operators.blockjoin import DECIMALS, dense_cells, probes_for, search_cells, topk_dense
from faultline.session import materialise


def topk_per_query(scores: DataFrame, k: int, query: str = "query_id", key: str = "key") -> DataFrame:
    """The k highest similarities per query, ties by key."""
    best = Window.partitionBy(query).orderBy(F.desc("similarity"), key)
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def dense_matches(
    queries: DataFrame,
    index: DataFrame,
    k: int = lx.DENSE_TOP_K,
    similar: float | None = None,
    duplicate: float = lx.VECTOR_DUPLICATE,
    exclude_self: bool = False,
    normalise: bool = False,
) -> DataFrame:
    """``queries(query_id, vec)`` against ``index(key, vec)``.

    ``normalise`` scales both sides first; with ``similar=0.70`` and
    ``duplicate=0.88`` that is the stricter variant.
    """
    if normalise:
        queries = queries.withColumn("vec", v.unit(F.col("vec")))
        index = index.withColumn("vec", v.unit(F.col("vec")))
    found = topk_dense(queries, index, k, min_similarity=similar, exclude_self=exclude_self)
    return found.withColumn("is_duplicate_candidate", F.col("similarity") >= duplicate)


def with_attributes(matches: DataFrame, index: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attributes joined back onto the few rows that survived top-k.

    Where both sides carry a ``source``, keys are looked up within it.
    """
    on = ["source", "key"] if "source" in matches.columns and "source" in index.columns else ["key"]
    return matches.join(index.select(*on, *columns), on, "left")


def union_candidates(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("index", "tickets")) -> DataFrame:
    """One pool from two sources, each row tagged with its source."""
    return first.withColumn("source", F.lit(names[0])).unionByName(
        second.withColumn("source", F.lit(names[1])), allowMissingColumns=True
    )


def two_source_recall(
    queries: DataFrame, index: DataFrame, tickets: DataFrame, recall_k: int = lx.RECALL_K
) -> DataFrame:
    """The best ``recall_k`` of each source: ``query_id, key, similarity, source``."""
    asked = queries.select("query_id", "vec")
    return union_candidates(
        topk_dense(asked, index.select("key", "vec"), recall_k).drop("rank"),
        topk_dense(asked, tickets.filter(F.col("vec").isNotNull()).select("key", "vec"), recall_k).drop("rank"),
    )


def word_set(text: Column) -> Column:
    return F.array_distinct(t.tokens(text))


def overlap_score(query: Column, candidate: Column) -> Column:
    """Default pair scorer, of two word sets: shared over all words, spread around zero."""
    shared = F.size(F.array_intersect(query, candidate))

    def share(n: Column) -> Column:
        either = F.size(query) + F.size(candidate) - n
        return F.when(either > 0, n / either * 8 - 2).otherwise(-2.0)

    return t.let(shared, share)


overlap_score.prepare = word_set  # worked out once per text, not per pair


def rerank_two_stage(
    queries: DataFrame,
    index: DataFrame,
    tickets: DataFrame,
    pair_scorer: Callable[[Column, Column], Column] = overlap_score,
    top_k: int = lx.RERANK_K,
    recall_k: int = lx.RECALL_K,
    duplicate: float = lx.VECTOR_DUPLICATE,
) -> DataFrame:
    """Recall by cosine, rescore the pairs, keep the best.

    Inputs carry ``text`` besides the vector. Queries with at most ``top_k``
    candidates keep the cosine order and are not rescored. The duplicate flag
    always looks at the cosine. A scorer with a ``prepare`` function gets what that
    makes of each text, once per text.
    """
    prepare = getattr(pair_scorer, "prepare", lambda text: text)
    pool = two_source_recall(queries, index, tickets, recall_k).withColumnRenamed("similarity", "cosine")
    pool = pool.withColumn("pool", F.count("*").over(Window.partitionBy("query_id")))
    texts = union_candidates(
        index.select("key", prepare(F.col("text")).alias("text")),
        tickets.select("key", prepare(F.col("text")).alias("text")),
    )
    asked = queries.select("query_id", prepare(F.col("text")).alias("query_text"))
    pairs = pool.join(asked, "query_id").join(texts, ["source", "key"])
    squashed = v.sigmoid(pair_scorer(F.col("query_text"), F.col("text")))
    scored = pairs.withColumn(
        "similarity",
        F.round(F.when(F.col("pool") <= top_k, F.col("cosine")).otherwise(squashed), DECIMALS),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("cosine"), "source", "key")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top_k)
        .select(
            "query_id", "rank", "source", "key", "similarity", "cosine",
            (F.col("cosine") >= duplicate).alias("is_duplicate_candidate"),
        )
    )


def relevance_summary(queries: DataFrame, matches: DataFrame, threshold: float = lx.RELEVANCE) -> DataFrame:
    """How much of each query's retrieval counts as signal; queries without matches stay."""
    per = matches.groupBy("query_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("similarity") >= threshold).alias("kept"),
        F.max("similarity").alias("top"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        queries.select("query_id")
        .join(per, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("kept", zero).alias("kept"),
            F.coalesce("total", zero).alias("total"),
            F.coalesce("top", F.lit(0.0)).alias("top_relevance_score"),
            (F.coalesce("top", F.lit(0.0)) < threshold).alias("is_low_confidence"),
        )
    )


def gate_relevance(matches: DataFrame, threshold: float = lx.RELEVANCE) -> DataFrame:
    return matches.filter(F.col("similarity") >= threshold)


def top_match(matches: DataFrame) -> DataFrame:
    """The first match per query, by a map-side combined maximum."""
    best = F.struct(
        -F.col("rank"), F.col("key"), F.col("similarity"), F.col("is_duplicate_candidate")
    )
    return (
        matches.groupBy("query_id")
        .agg(F.max(best).alias("b"))
        .select(
            "query_id",
            F.col("b.key").alias("key"),
            F.col("b.similarity").alias("similarity"),
            F.when(F.col("b.is_duplicate_candidate"), F.col("b.key")).alias("duplicate_of"),
        )
    )


def approximate_join(
    queries: DataFrame,
    index: DataFrame,
    k: int = lx.RECALL_K,
    probes: int | None = None,
    min_similarity: float | None = None,
    recall: float = 0.9,
    sample: int = 256,
    pivots: int | None = None,
) -> DataFrame:
    """Top k among the nearest cells of a query, as many as the recall asks for.

    Locality hashing by nearest pivot with several probes. Their number is measured on
    ``sample`` queries answered exactly, so it follows the data and the number of cells instead
    of being set; ``probes`` sets it nevertheless. A crowded cell is split into blocks
    instead of being paired with itself. Every similarity reported is exact; the share
    ``recall`` of the true matches is found, the others lie in cells not visited.
    """
    cells = dense_cells(index, k, pivots)
    if cells is None:
        return topk_dense(queries, index, k)
    if probes is None:
        probes = probes_for(cells, queries, k, recall, min_similarity, sample)
    return search_cells(cells, queries, k, min_similarity, probes=probes)


def cached_matches(matches: DataFrame) -> DataFrame:
    """Matches read by several branches, written once."""
    return materialise(matches, "matches")
