"""Jaccard join of documents by a blocked product of their n-gram incidence matrix.

Rows of the matrix are documents, columns are n-grams. The matrix is cut into
column blocks by the hash of the n-gram and transposed into row blocks by the
document; a tile travels as one row of packed numbers. A column block drops the
columns of one document; a row block adds up what is left of each document and
drops those that no other can overlap enough. Products are only taken of pairs
that the size bounds let through, and never of all pairs of a group: a group is
first joined through single members, and only what stays apart is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import text as tx
from faultline.llm.graph import components
from faultline.session import materialise

KEY_BYTES = 5
TILE_BYTES = 1 << 21  # text whose shingles share tiles
TILE_SCHEMA = "block int, ids binary, counts binary, sizes binary, keys binary, freq binary"
TILE_NAMES = ["block", "ids", "counts", "sizes", "keys", "freq"]
TILE_KINDS = [pa.int32()] + [pa.binary()] * 5
ROW_SCHEMA = "id long, n int, lack int, keys binary, prefix array<struct<key:long,rest:int>>"
PERCENT = 75
PIVOTS = 4
FEW = 128  # pairs left for each entry at which all of them are compared


def shingle_facts(docs: DataFrame, size: int) -> DataFrame:
    """id, n (distinct shingles) and a digest of the set, null if empty."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tx.text_slices(batch, "text"):
                words, first = tx.word_hashes(data, offsets, tx.NOT_SPACE)
                values, bounds = tx.shingle_sets(words, first, size)
                digests = [
                    hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[row:end],
                        pa.array(np.diff(bounds)),
                        pa.array(digests, pa.binary()),
                    ],
                    ["id", "n", "digest"],
                )

    return docs.mapInArrow(facts, "id long, n long, digest binary")


def planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers with all first bytes first, then all second ones: small or sorted ones compress."""
    size = np.dtype(kind).itemsize
    return values.astype(kind).view(np.uint8).reshape(-1, size).T.tobytes()


def from_planes(data, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack(block: int, ids, counts, sizes, keys: bytes, freq: bytes = b"") -> tuple:
    return (block, planes(ids, "<i8"), planes(counts, "<u4"), planes(sizes, "<u4"), keys, freq)


def _tiles(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, TILE_KINDS, strict=True)], TILE_NAMES
    )


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Entry by entry: document, size of its set; packed keys; frequencies."""

    def join(name: str, kind: str) -> np.ndarray:
        return np.concatenate([from_planes(x, kind) for x in table[name].to_pylist()])

    counts = join("counts", "<u4")
    ids = np.repeat(join("ids", "<i8"), counts)
    sizes = np.repeat(join("sizes", "<u4"), counts)
    return ids, sizes, counts, table["keys"].to_pylist(), join("freq", "u1")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of stretches of equal values."""
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return start, np.diff(np.append(start, len(values)))


def incidence_tiles(docs: DataFrame, size: int, blocks: int) -> DataFrame:
    """The incidence matrix by column block, one row per block and stretch of texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for row, end, data, offsets in tx.text_slices(batch, "text", TILE_BYTES):
                words, first = tx.word_hashes(data, offsets, tx.NOT_SPACE)
                values, bounds = tx.shingle_sets(words, first, size)
                n = np.diff(bounds)
                text = np.repeat(np.arange(row, end), n)
                block = ((values >> np.uint64(40)) * np.uint64(blocks)) >> np.uint64(24)
                order = np.argsort(block.astype(np.uint32), kind="stable")
                packed = values.astype("<u8").view(np.uint8).reshape(-1, 8)[order, :KEY_BYTES]
                text, block = text[order], block[order]
                edges = np.searchsorted(block, np.arange(blocks + 1))
                rows = []
                for b in np.flatnonzero(np.diff(edges)):
                    own = text[edges[b] : edges[b + 1]]
                    at, counts = _runs(own)
                    rows.append(
                        _pack(
                            int(b), ids[own[at]], counts, n[own[at] - row],
                            packed[edges[b] : edges[b + 1]].tobytes(),
                        )
                    )
                if rows:
                    yield _tiles(rows)

    return docs.mapInArrow(cut, TILE_SCHEMA)


def shared_tiles(tiles: DataFrame, blocks: int) -> DataFrame:
    """Columns of two documents or more, by row block, with their frequencies (255: or more)."""

    def share(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        ids, sizes, _, raw, _ = _unpack(table)
        keys = np.zeros((len(ids), 8), np.uint8)
        keys[:, :KEY_BYTES] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, KEY_BYTES)
        keys = keys.view("<u8").ravel()
        order = np.argsort(keys, kind="stable")
        at, counts = _runs(keys[order])
        many = np.repeat(counts > 1, counts)
        freq = np.repeat(np.minimum(counts, 255), counts)[many].astype(np.uint8)
        order = order[many]
        if not len(order):
            return pa.Table.from_batches([_tiles([])])
        ids, sizes = ids[order], sizes[order]
        keys = keys[order] | np.uint64(block << (8 * KEY_BYTES))
        target = (tx.mix(ids.astype(np.uint64)) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        order = np.lexsort((ids, target))
        ids, sizes, keys, freq, target = (x[order] for x in (ids, sizes, keys, freq, target))
        edges = np.searchsorted(target, np.arange(blocks + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            at, counts = _runs(ids[part])
            own = planes(keys[part], "<u8")
            rows.append(
                _pack(int(b), ids[part][at], counts, sizes[part][at], own, freq[part].tobytes())
            )
        return pa.Table.from_batches([_tiles(rows)])

    return tiles.groupBy("block").applyInArrow(share, TILE_SCHEMA)


def bounded_rows(tiles: DataFrame, percent: int) -> DataFrame:
    """Rows whose shared columns could make up the needed overlap, rarest columns as prefix.

    A partner overlaps at least ``percent`` of the row's size, and only in shared
    columns. So the row and any partner have a column in common among the rarest
    ``shared - needed + 1``; ``rest`` tells how many columns follow in that order.
    """

    def keep(table: pa.Table) -> pa.Table:
        ids, sizes, _, raw, freq = _unpack(table)
        keys = np.concatenate([from_planes(x, "<u8") for x in raw])
        order = np.lexsort((keys, freq, ids))
        ids, sizes, keys, freq = ids[order], sizes[order], keys[order], freq[order]
        new = np.ones(len(ids), bool)  # a document that occurs twice has its columns once
        new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
        ids, sizes, keys = ids[new], sizes[new], keys[new]
        at, counts = _runs(ids)
        needed = -(-percent * sizes[at].astype(np.int64) // 100)
        out: list[list] = [[], [], [], [], []]
        for a, c, need in zip(at.tolist(), counts.tolist(), needed.tolist(), strict=True):
            if c >= need:
                own = keys[a : a + c]
                out[0].append(int(ids[a]))
                out[1].append(int(sizes[a]))
                out[2].append(int(sizes[a]) - c)
                out[3].append(planes(np.sort(own), "<u8"))
                out[4].append(
                    [
                        {"key": k, "rest": c - 1 - i}
                        for i, k in enumerate(own[: c - need + 1].astype(np.int64).tolist())
                    ]
                )
        prefix = pa.list_(pa.struct([("key", pa.int64()), ("rest", pa.int32())]))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), prefix]
        return pa.table(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
            ["id", "n", "lack", "keys", "prefix"],
        )

    return tiles.groupBy("block").applyInArrow(keep, ROW_SCHEMA)


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (x.., y..) that sizes and the columns still to come allow."""
    small, large = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    most = F.least("x_rest", "y_rest") + 1
    return pairs.where(
        (small * 100 >= large * percent)
        & (most * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent)
    )


def verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose exact overlap reaches the similarity, with both similarity terms.

    Sort-merge joins at every size of the table of pairs, which grows with the input.
    """

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = np.empty(batch.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(batch.column("ka"), batch.column("kb"), strict=True)):
                x, y = from_planes(x.as_buffer(), "<u8"), from_planes(y.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common[k] = np.count_nonzero(y[at] == x)
            union = np.asarray(batch.column("na")) + np.asarray(batch.column("nb")) - common
            good = np.flatnonzero(common * 100 >= percent * union)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(pa.array(good)), batch.column("b").take(pa.array(good)),
                 pa.array(common[good]), pa.array(union[good])],
                ["a", "b", "common", "total"],
            )

    side = lambda x: rows.select(
        F.col("id").alias(x), F.col("n").cast("long").alias(f"n{x}"), F.col("keys").alias(f"k{x}")
    )
    return (
        pairs.select("a", "b")
        .join(side("a").hint("merge"), "a")
        .join(side("b").hint("merge"), "b")
        .mapInArrow(overlap, "a long, b long, common long, total long")
    )


def _members(own: DataFrame, side: str) -> DataFrame:
    columns = [F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "rest", "component")]
    return own.select("key", *columns)


def _pivots(own: DataFrame, step: int) -> DataFrame:
    """``PIVOTS`` members of each column with more than one component, by global orders.

    Half of them are those that lack the fewest of their shingles among the shared ones:
    the text that others are copies of is such a one.
    """
    member = F.struct("id", "n", "rest", "component").alias("m")
    firsts = []
    for q in range(PIVOTS):
        chance = F.xxhash64("id", F.lit(step * PIVOTS + q)).alias("h")
        order = [F.col("lack"), chance] if q % 2 else [chance]
        firsts.append(F.min(F.struct(*order, member)))
    columns = own.groupBy("key").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        *[first.alias(f"p{q}") for q, first in enumerate(firsts)],
    )
    chosen = F.array_distinct(F.array(*[F.col(f"p{q}.m") for q in range(PIVOTS)]))
    return columns.where("low <> high").select("key", F.explode(chosen).alias("m")).select(
        "key", *[F.col(f"m.{c}").alias(f"y_{c}") for c in ("id", "n", "rest", "component")]
    )


def _bin(n: Column) -> Column:
    return F.floor(F.log(n) * 16).cast("int")


def _size_bins(x: DataFrame, percent: int) -> DataFrame:
    """Members once for each size bin in which a partner by this column can lie."""
    low = F.col("x_n") * percent / 100 - 1e-6  # no partner is lost to rounding
    most = (F.col("x_rest") + 1) * (100 + percent) / percent - F.col("x_n")
    high = F.least(F.col("x_n") * 100 / percent, most)
    x = x.where(high >= low)
    return x.withColumn("bin", F.explode(F.sequence(_bin(F.ceil(low)), _bin(F.floor(high) + 1))))


def similar_rows(rows: DataFrame, percent: int = PERCENT, rounds: int = 6) -> DataFrame:
    """(node, component) of all rows that reach another through similar pairs.

    In each round every column names a few of its rows, and the others are compared
    with them; groups that hold together fall into one component and need no more
    comparison. When the pairs left, those of different components in one column,
    are few to an entry or no longer halve, all of them are compared: rows outside the
    largest component of a column with the others. So every pair that could
    connect two components has been compared in the end.
    """
    spark = rows.sparkSession
    entries = materialise(
        rows.select("id", "n", "lack", F.explode("prefix").alias("p")).select(
            "id", "n", "lack", "p.key", "p.rest"
        ),
        "prefix",
    )
    total = entries.count()
    labels = spark.createDataFrame([], "node long, component long")
    tried = spark.createDataFrame([], "a long, b long")
    before = None
    for step in range(rounds + 1):
        if step:
            own = entries.join(labels.withColumnRenamed("node", "id"), "id", "left")
            own = own.withColumn("component", F.coalesce("component", "id"))
            parts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
            columns = parts.groupBy("key").agg(
                F.sum("c").alias("all"),
                F.sum(F.col("c") * F.col("c")).alias("same"),
                F.max(F.struct("c", "component")).alias("most"),
            )
            columns = materialise(
                columns.select(
                    "key",
                    (F.col("all") * F.col("all") - F.col("same")).alias("apart"),
                    F.col("most.component").alias("major"),
                ).where("apart > 0"),
                "columns",
            )
            left = columns.agg(F.sum("apart")).first()[0] or 0
            if not left:
                break
            last = step == rounds or left <= FEW * total or (before and 2 * left > before)
            before = left
        else:
            own, last = entries.withColumn("component", F.col("id")), False
        x, on = _members(own, "x"), ["key"]
        if last:
            x = x.join(columns.select("key", "major"), "key").where("x_component <> major")
            x = _size_bins(x, percent)
            y = _members(own, "y").withColumn("bin", _bin(F.col("y_n")))
            on.append("bin")
        else:
            y = _pivots(own, step)
        near = _bounded(x.join(y, on).where("x_component <> y_component"), percent)
        pairs = near.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
        pairs = materialise(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        links = verified(pairs, rows, percent).select("a", "b")
        known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = components(links.unionByName(known))
        tried = tried.unionByName(pairs)
        if last:
            break
    return labels


def link_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = PERCENT,
    block_entries: int = 2_000_000,
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Words are runs of bytes other than ASCII white space, A-Z as a-z; the set of
    a document are its distinct runs of ``size`` words, or all its words as one if
    it has fewer. Documents link at a Jaccard similarity of ``percent`` / 100 or more;
    the component is the smallest id reachable. A null or empty text, or one
    without words, has no shingles and its own id. Rows with equal sets are one row
    of the matrix. A null id has a null component. Repeated rows give equal rows;
    rows of one id with different texts are compared by their columns together.
    Other columns are left out. An empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    facts = materialise(shingle_facts(own, size), "shingle-facts")
    total = facts.agg(F.sum("n")).first()[0] or 0
    blocks = min(max(64, -(-total // block_entries)), 1 << 23)
    first = materialise(
        facts.where("digest is not null and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("id")),
        "set-groups",
    )
    tiles = incidence_tiles(own.where("id is not null"), size, blocks)
    rows = bounded_rows(shared_tiles(tiles, blocks), percent)
    rows = materialise(rows.join(first.select("id").distinct(), "id", "left_semi"), "rows")
    labels = similar_rows(rows, percent)
    component = materialise(
        first.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
            "digest", F.coalesce("component", "id").alias("component_id")
        ),
        "set-components",
    )
    linked = facts.where("digest is not null").join(component, "digest", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
    alone = facts.where("digest is null").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")
    )
    return linked.unionByName(alone)
