"""Exact top-k similarity join by routed block products.

The join never pairs single rows. The corpus is split into cells around a few
pivot rows and each cell into blocks of bounded size. A query is multiplied only with
the cells whose best possible similarity can still reach its top k; the bound
is exact, so nothing is lost. Packed blocks and packed chunks of queries are written once and
meet as a cross product of their files: no query is copied for each block. A task reads its
chunks one after the other, takes each through its blocks, and emits at most k rows per query.

What reaches the driver are the pivot rows and one summary row per cell, whose number
grows with the root of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import materialise

ENTRIES = 4_000_000  # numbers of an intermediate product held at a time
PARTITION = 64 << 20  # bytes of blocks that a task has in memory
SLACK = 1e-6  # covers float32 storage when bounds are compared
DECIMALS = 6  # similarities are ranked after rounding, ties by key


# --- inside tasks -------------------------------------------------------------


def _reachable(
    to_pivots: np.ndarray, bounds: np.ndarray, k: int, floor: float | None, probes: int | None = None
) -> list:
    """Cells per query whose bound reaches the k-th best similarity known so far.

    With ``probes`` only the most promising of them, which is no longer exact.
    """
    n = to_pivots.shape[1]
    known = np.partition(to_pivots, n - k, axis=1)[:, n - k] if n >= k else np.full(len(to_pivots), -np.inf)
    if floor is not None:
        known = np.maximum(known, floor)
    out = []
    for row, near, low in zip(bounds, to_pivots, known):
        cells = np.flatnonzero(row >= low - SLACK)
        if probes is not None and len(cells) > probes:
            cells = np.sort(cells[np.argsort(-near[cells], kind="stable")[:probes]])
        out.append(cells.astype(np.int32))
    return out


def _dense(values) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


def _rows_of(column: pa.Array, i: int):
    """Flat values and row offsets of the i-th packed list of lists."""
    lists = column[i].values
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _matrix(column: pa.Array, i: int) -> np.ndarray:
    flat, offsets = _rows_of(column, i)
    return flat.astype(np.float64).reshape(len(offsets) - 1, -1)


def _directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one (zero stays zero), and their lengths."""
    sizes = np.linalg.norm(rows, axis=1)
    return rows / np.maximum(sizes, 1e-300)[:, None], sizes


def _best(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int, floor, exclude_self: bool):
    """At most k pairs per query: highest rounded score first, then lowest key."""
    q, c, s = _best_places(scores, q_ids, c_ids, k, floor, exclude_self)
    return q_ids[q], c_ids[c], s


def _best_places(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int, floor, exclude_self: bool):
    """As :func:`_best`, by the numbers of row and column; ``floor`` may be one for each query.

    Only scores that can be among them are rounded and sorted: k groups of columns have a
    score of ``least`` or more, and rounding keeps the order.
    """
    n = scores.shape[1]
    by_key = np.argsort(c_ids, kind="stable")
    if exclude_self:
        low, high = (np.searchsorted(c_ids, q_ids, side, sorter=by_key) for side in ("left", "right"))
        scores = scores.copy()
        for q in np.flatnonzero(high > low):
            scores[q, by_key[low[q] : high[q]]] = -np.inf
    least = np.full(len(scores), -np.inf)
    groups = n // 16
    if groups >= k:
        most = scores[:, : groups * 16].reshape(-1, 16, groups).max(axis=1)
        least = np.partition(most, groups - k, axis=1)[:, groups - k]
    elif n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
    if floor is not None:
        floor = np.broadcast_to(floor, len(scores))
        least = np.maximum(least, floor)
    q, c = np.nonzero((scores >= least[:, None] - 2 * 10.0**-DECIMALS) & (scores > -np.inf))
    s = np.round(scores[q, c], DECIMALS)
    if floor is not None:
        q, c, s = (x[s >= floor[q]] for x in (q, c, s))
    place_of = np.empty(n, np.int64)
    place_of[by_key] = np.arange(n)
    keep = _first_of(q, s, place_of[c], k)
    return q[keep], c[keep], s[keep]


def _first_of(q: np.ndarray, s: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows of each ``q`` with the highest ``s``, then the lowest ``order``, sorted by all three."""
    found = np.lexsort((order, -s, q))
    place = np.arange(len(found)) - np.searchsorted(q[found], q[found])
    return found[place < k]


class _Chunk:
    """A packed chunk of queries and the best it has found so far."""

    def __init__(self, batch: pa.RecordBatch, i: int, reach: Callable, k: int, floor: float | None) -> None:
        self.ids = batch.column("q_id")[i].values.to_numpy(zero_copy_only=False)
        self.vec = _matrix(batch.column("q_vec"), i)
        self.bounds, cells = reach(self.vec)
        self.reached = np.zeros(self.bounds.shape, bool)
        for row, own in zip(self.reached, cells):
            row[own] = True
        self.k = k
        self.known = np.full(len(self.ids), -np.inf if floor is None else floor)
        self.q, self.keys, self.s = np.empty(0, np.int64), None, np.empty(0)

    def meet(self, cell: int, keys: np.ndarray, vec: np.ndarray, exclude_self: bool) -> None:
        """Takes in the rows of a block of the cell."""
        rows = np.flatnonzero(self.reached[:, cell] & (self.bounds[:, cell] >= self.known - SLACK))
        step = max(1, ENTRIES // max(len(keys), 1))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            scores = self.vec[own] @ vec.T
            q, c, s = _best_places(scores, self.ids[own], keys, self.k, self.known[own], exclude_self)
            if len(q):
                self._keep(own[q], keys[c], s)

    def _keep(self, q: np.ndarray, keys: np.ndarray, s: np.ndarray) -> None:
        if self.keys is not None:
            q, keys, s = (np.concatenate(x) for x in ((self.q, q), (self.keys, keys), (self.s, s)))
        order = np.unique(keys, return_inverse=True)[1] if keys.dtype == object else keys
        best = _first_of(q, s, order, self.k)
        self.q, self.keys, self.s = q[best], keys[best], s[best]
        full = np.bincount(self.q, minlength=len(self.ids)) == self.k
        last = np.searchsorted(self.q, np.flatnonzero(full), "right") - 1
        self.known[full] = self.s[last]

    def found(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = ([], [], []) if self.keys is None else (self.ids[self.q], self.keys, self.s)
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, schema)], schema=schema)


def _multiply(
    batches: Iterator[pa.RecordBatch], reach: Callable, k: int, floor, exclude_self: bool, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk and a block, those of one chunk together."""
    last, chunk = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            number = batch.column("chunk")[i].as_py()
            if chunk is None or number != last:
                if chunk is not None:
                    yield chunk.found(schema)
                last, chunk = number, _Chunk(batch, i, reach, k, floor)
            keys = batch.column("c_id")[i].values.to_numpy(zero_copy_only=False)
            chunk.meet(batch.column("cell")[i].as_py(), keys, _matrix(batch.column("c_vec"), i), exclude_self)
    if chunk is not None:
        yield chunk.found(schema)


# --- copies -------------------------------------------------------------------


def _size_and_copies(rows: DataFrame, features: list[str]) -> tuple[int, bool]:
    """Number of rows, and whether equal vectors are a noticeable part of them."""
    n, distinct = rows.agg(
        F.count("*"), F.approx_count_distinct(F.xxhash64(*features), 0.02)
    ).first()
    return n, distinct < 0.95 * n


def _cells_for(n: int) -> int:
    """Cells grow with the root of the table, and so does what the driver holds of them."""
    return max(16, isqrt(n) // 8)


def _first_copies(corpus: DataFrame, features: list[str], keep: int) -> DataFrame:
    """At most ``keep`` rows of equal vectors, lowest keys first.

    Equal vectors tie for every query and ties go to the lower key, so the
    others can never be among the best. The limit is applied before the
    shuffle, so a vector that fills a third of the table is no hot group.
    """
    copies = Window.partitionBy("hash", *features).orderBy("key")
    ranked = corpus.withColumn("hash", F.xxhash64(*features)).withColumn("copy", F.row_number().over(copies))
    return ranked.filter(F.col("copy") <= keep).drop("hash", "copy")


def _per_distinct_query(queries: DataFrame, features: list[str], join: Callable) -> DataFrame:
    """``join`` for one query of each set of equal ones, its result given to all of them."""
    hashed = queries.select("query_id", *features).withColumn("hash", F.xxhash64(*features))
    speakers = materialise(
        hashed.groupBy("hash", *features).agg(F.min("query_id").alias("speaker")), "speakers"
    )
    members = hashed.join(speakers, ["hash", *features]).select("query_id", "speaker")
    found = join(speakers.select(F.col("speaker").alias("query_id"), *features))
    return members.join(found.withColumnRenamed("query_id", "speaker"), "speaker").select(
        "query_id", "key", "similarity"
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


# --- the join -----------------------------------------------------------------


def _arrow_type(t: T.DataType) -> pa.DataType:
    return pa.string() if isinstance(t, T.StringType) else pa.int32() if isinstance(t, T.IntegerType) else pa.int64()


def _numbers(counts: list[int], most: int) -> tuple[list[int], list[int]]:
    """For each cell its first chunk and the number of its chunks; small cells next to each other share one."""
    first, split, free, room = [], [], 0, 0
    for n in counts:
        if n > room:
            first.append(free)
            split.append(max(1, ceil(n / most)))
            free += split[-1]
            room = most - n if n <= most else 0
        else:
            first.append(max(free - 1, 0))
            split.append(1)
            room -= n
    return first, split


def _join_blocks(
    queries: DataFrame,
    cells: DenseCells,
    near: Callable,
    reach: Callable,
    k: int,
    floor: float | None,
    exclude_self: bool,
    block_rows: int,
    chunk_rows: int,
) -> DataFrame:
    """``queries(query_id, vec)`` with the rows of the cells that ``reach`` names for each.

    Both are packed and written once. Queries of one cell are packed together, as most cells are out of
    reach for all of them. What comes out are k rows for each query and partition of blocks, of which
    there are no more than their memory asks for.
    """
    queries = materialise(queries.select("query_id", "vec", near("vec").alias("near")), "routed")
    count = len(cells.pivots)
    per_cell = {r["near"]: r["count"] for r in queries.groupBy("near").count().collect()}
    chunk_first, chunk_split = _numbers([per_cell.get(c, 0) for c in range(count)], chunk_rows)
    split = [ceil(cells.sizes.get(c, 0) / block_rows) for c in range(count)]
    first = np.concatenate([[0], np.cumsum(split)]).tolist()

    def number(name: str, cell: str, first: list[int], split: list[int]) -> Column:
        of = [F.get(F.array(*[F.lit(n) for n in x]), F.col(cell)) for x in (first, split)]
        return of[0] + F.pmod(F.xxhash64(name), of[1]).cast("int")

    blocks = (
        cells.rows.groupBy("cell", number("key", "cell", first, split).alias("block"))
        .agg(F.collect_list(F.struct("key", "vec")).alias("c"))
        .select("cell", F.col("c.key").alias("c_id"), F.col("c.vec").alias("c_vec"))
    )
    blocks = materialise(blocks, "blocks")
    packed = (
        queries.groupBy(number("query_id", "near", chunk_first, chunk_split).alias("chunk"))
        .agg(F.collect_list(F.struct("query_id", "vec")).alias("q"))
        .select("chunk", F.col("q.query_id").alias("q_id"), F.col("q.vec").alias("q_vec"))
    )

    @F.pandas_udf("array<int>")
    def together(vec: pd.Series) -> pd.Series:
        """All cells that queries of a chunk reach."""
        found = [reach(np.stack(list(v)).astype(np.float64))[1] for v in vec]
        return pd.Series([np.unique(np.concatenate(x)) for x in found])

    packed = materialise(packed.withColumn("cells", together("q_vec")), "chunks")
    size = sum(cells.sizes.values()) * cells.pivots.shape[1] * 8
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    parts = max(ceil(size / PARTITION), ceil(tasks / max(packed.rdd.getNumPartitions(), 1)))
    id_type, key_type = queries.schema["query_id"].dataType, cells.rows.schema["key"].dataType
    out = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("key", key_type),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    arrow = pa.schema(
        [("query_id", _arrow_type(id_type)), ("key", _arrow_type(key_type)), ("similarity", pa.float64())]
    )
    # a nested loop keeps the order: all blocks of a partition for one chunk, then for the next
    met = packed.join(blocks.coalesce(parts).hint("shuffle_replicate_nl"), F.expr("array_contains(cells, cell)"))
    return met.drop("cells").mapInArrow(
        partial(_multiply, reach=reach, k=k, floor=floor, exclude_self=exclude_self, schema=arrow), out
    )


def sample_by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    """A fixed number of rows, the same on every run, spread by a hash of the key.

    The keys are chosen from the key column alone; only the chosen rows are read.
    """
    chosen = rows.select(key).orderBy(F.md5(F.col(key).cast("string")), key).limit(n).collect()
    return rows.filter(F.col(key).isin([r[key] for r in chosen])).orderBy(key).limit(n)


def _empty(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    return queries.select("query_id").join(corpus.select("key"), F.lit(False)).select(
        "query_id", "key", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("rank")
    )


def _answer(queries: DataFrame, features: list[str], join: Callable, k: int, exclude_self: bool) -> DataFrame:
    """Top k per query; equal queries are answered once."""
    if not _size_and_copies(queries, features)[1]:
        return _ranked(join(queries, k, exclude_self), k)
    found = _per_distinct_query(
        queries, features, lambda speakers: join(speakers, k + 1 if exclude_self else k, False)
    )
    return _ranked(found.filter(F.col("query_id") != F.col("key")) if exclude_self else found, k)


@dataclass
class DenseCells:
    """A corpus of vectors dealt to cells: ``key, vec, cell`` rows, the pivots, and per cell its
    radius, longest row and number of rows."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    sizes: dict[int, int]

    @property
    def centre(self) -> np.ndarray:
        return _directions(self.pivots)[0]


def dense_cells(corpus: DataFrame, keep: int, pivots: int | None = None) -> DenseCells | None:
    """The cells of ``corpus(key, vec)``, None without a vector.

    A pivot's cell are the rows nearer to it than to the others. Of equal vectors the ``keep``
    lowest keys are kept. Pivots are ``pivots`` rows, or as many as the root of the table.
    """
    corpus = corpus.filter(F.col("vec").isNotNull()).select("key", "vec")
    size, copied = _size_and_copies(corpus, ["vec"])
    if copied:
        corpus = _first_copies(corpus, ["vec"], keep)
    picked = sample_by_hash(corpus, "key", pivots or _cells_for(size)).toPandas()
    if picked.empty:
        return None
    chosen = _dense(picked["vec"])
    centre = _directions(chosen)[0]

    @F.pandas_udf("cell int, near double, size double")
    def assign(vec: pd.Series) -> pd.DataFrame:
        directions, sizes = _directions(_dense(vec))
        sims = directions @ centre.T
        return pd.DataFrame({"cell": sims.argmax(axis=1).astype(np.int32), "near": sims.max(axis=1), "size": sizes})

    rows = materialise(
        corpus.select("key", "vec", assign("vec").alias("a")).select("key", "vec", "a.cell", "a.near", "a.size"), "cells"
    )
    per_cell = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near"), F.max("size").alias("size"))
    stats = {r["cell"]: r for r in per_cell.collect()}
    radius = np.array([np.arccos(np.clip(stats[c]["near"], -1, 1)) if c in stats else 0.0 for c in range(len(centre))])
    longest = np.array([stats[c]["size"] if c in stats else 0.0 for c in range(len(centre))])
    return DenseCells(rows, chosen, radius, longest, {c: r["n"] for c, r in stats.items()})


def search_cells(
    cells: DenseCells,
    queries: DataFrame,
    k: int,
    min_similarity: float | None = None,
    exclude_self: bool = False,
    block_rows: int = 4096,
    chunk_rows: int = 1024,
    probes: int | None = None,
) -> DataFrame:
    """Top k of the cells' rows for each of ``queries(query_id, vec)``."""
    centre, pivots, radius, longest = cells.centre, cells.pivots, cells.radius, cells.longest
    wanted = k + 1 if exclude_self else k

    @F.pandas_udf("int")
    def near(vec: pd.Series) -> pd.Series:
        return pd.Series((_directions(_dense(vec))[0] @ centre.T).argmax(axis=1).astype(np.int32))

    def reach(rows: np.ndarray) -> tuple[np.ndarray, list]:
        """What a query can have at most in each cell, and the cells it is multiplied with."""
        directions, sizes = _directions(rows)
        best = np.cos(np.clip(np.arccos(np.clip(directions @ centre.T, -1, 1)) - radius, 0, None))
        bounds = sizes[:, None] * np.maximum(best * longest, 0)  # a shorter member may do better below 0
        return bounds, _reachable(rows @ pivots.T, bounds, wanted, min_similarity, probes)

    def join(asked: DataFrame, best: int, skip: bool) -> DataFrame:
        return _join_blocks(asked, cells, near, reach, best, min_similarity, skip, block_rows, chunk_rows)

    return _answer(queries.filter(F.col("vec").isNotNull()), ["vec"], join, k, exclude_self)


def topk_dense(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    min_similarity: float | None = None,
    exclude_self: bool = False,
    pivots: int | None = None,
    block_rows: int = 4096,
    chunk_rows: int = 1024,
    probes: int | None = None,
) -> DataFrame:
    """Top k of ``corpus(key, vec)`` for each row of ``queries(query_id, vec)``.

    Similarities are inner products, for vectors of any length. Cells are pruned by
    the triangle inequality on angles: no member of a cell is closer to the query
    than the angle to the pivot minus the cell's radius, and none is longer than the
    cell's longest. ``probes`` limits the cells a query visits and makes the join
    approximate. A query without a vector has no result, a row of the corpus
    without one is never found.
    """
    cells = dense_cells(corpus, k + 1 if exclude_self else k, pivots)
    if cells is None:
        return _empty(queries, corpus)
    return search_cells(cells, queries, k, min_similarity, exclude_self, block_rows, chunk_rows, probes)


def probes_for(
    cells: DenseCells, queries: DataFrame, k: int, recall: float, min_similarity: float | None = None, sample: int = 256
) -> int:
    """The least number of cells, nearest first, that hold the share ``recall`` of the true matches.

    Measured: ``sample`` queries, chosen by a hash, are answered exactly, and the cells of
    their matches looked up. The share asked of the sample is higher by two standard
    errors of a share among its queries. Without a match in the sample, all cells.
    """
    asked = sample_by_hash(queries.filter(F.col("vec").isNotNull()).select("query_id", "vec"), "query_id", sample)
    exact = search_cells(cells, asked, k, min_similarity).select("query_id", "key")
    pivots = cells.pivots

    @F.pandas_udf("array<int>")
    def places(vec: pd.Series) -> pd.Series:
        """For each cell its place in the order of a query with limited probes."""
        order = np.argsort(-(_dense(vec) @ pivots.T), axis=1, kind="stable")
        return pd.Series(list(np.argsort(order, axis=1, kind="stable").astype(np.int32)))

    placed = asked.select("query_id", places("vec").alias("places"))
    needed = exact.join(cells.rows.select("key", "cell"), "key").join(placed, "query_id")
    needed = needed.select("query_id", (F.get("places", F.col("cell")) + 1).alias("probes"))
    counts = dict(needed.groupBy("probes").count().orderBy("probes").collect())
    total, seen = sum(counts.values()), 0
    n = needed.select("query_id").distinct().count()
    if not n:
        return len(pivots)
    wanted = min(1.0, recall + 2 * (recall * (1 - recall) / n) ** 0.5) * total
    for probes, count in counts.items():
        seen += count
        if seen >= wanted - 1e-9:
            return probes
    return len(pivots)
