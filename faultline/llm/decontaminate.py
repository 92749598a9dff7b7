"""Benchmark decontamination: a prefix-filtered join of item windows with documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import text as tx
from faultline.session import materialise

SHINGLE = 5
WINDOW_SCHEMA = "item_id string, size int, words binary"
MASK_BITS = 22


def item_windows(
    items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10
) -> DataFrame:
    """Windows of ``size`` consecutive words as packed word hashes.

    An item with fewer words is one window; one without words has none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tx.text_slices(batch, "text"):
                words, first = tx.word_hashes(data, offsets, tx.LETTERS_DIGITS)
                rows: list[tuple] = []
                for d, item in enumerate(batch.column(0)[row:end].to_pylist()):
                    own = words[first[d] : first[d + 1]]
                    n = min(len(own), size)
                    if n:
                        rows += [
                            (item, n, own[k : k + n].tobytes()) for k in range(len(own) - n + 1)
                        ]
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.string()),
                        pa.array(columns[1], pa.int32()),
                        pa.array(columns[2], pa.binary()),
                    ],
                    ["item_id", "size", "words"],
                )

    cast = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return cast.mapInArrow(cut, WINDOW_SCHEMA).distinct()


class WindowBlock:
    """Windows of one block, found through the rarest shingle of each."""

    def __init__(self, table: pa.Table):
        sizes = np.asarray(table["size"])
        words = table["words"].to_pylist()
        names = table["item_id"].to_pylist()
        self.items, item = np.unique(np.array(names, object), return_inverse=True)
        self.item = item
        self.size = sizes.astype(np.int64)
        width = int(self.size.max(initial=1))
        self.words = np.zeros((len(words), width), np.uint64)
        for k, packed in enumerate(words):
            self.words[k, : sizes[k]] = np.frombuffer(packed, np.uint64)
        self.width = np.minimum(self.size, SHINGLE)
        self.window, self.place, keys = self._shingles()
        self.keys, self.key = np.unique(keys, return_inverse=True)
        self.widths = [int(w) for w in np.unique(self.width)]

    def _shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place in it, hash) of every shingle."""
        out: list[tuple] = []
        for size in np.unique(self.size):
            rows = np.flatnonzero(self.size == size)
            width = min(int(size), SHINGLE)
            for place in range(int(size) - width + 1):
                table = self.words[rows, place : place + width]
                out.append((rows, np.full(len(rows), place), tx._rows_hash(table)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def choose(self, counts: np.ndarray) -> None:
        """Keeps the rarest shingle of each window: the prefix that any container must have."""
        order = np.lexsort((self.place, self.keys[self.key], counts[self.key], self.window))
        _, at = np.unique(self.window[order], return_index=True)
        chosen = order[at]
        chosen = chosen[np.argsort(self.key[chosen], kind="stable")]
        used, key = np.unique(self.key[chosen], return_inverse=True)
        self.keys = self.keys[used]
        self.window, self.place = self.window[chosen], self.place[chosen]
        self.first = np.searchsorted(key, np.arange(len(used) + 1))
        self.key = key

    def mask(self) -> np.ndarray:
        mask = np.zeros(1 << MASK_BITS, bool)
        mask[(self.keys & np.uint64((1 << MASK_BITS) - 1)).astype(np.int64)] = True
        return mask

    def occurrences(
        self, words: np.ndarray, first: np.ndarray, mask: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place among the words, number of the key) of every key shingle, width by width."""
        for width in self.widths:
            found = tx.run_hashes(words, width)
            low = (found & np.uint64((1 << MASK_BITS) - 1)).astype(np.int64)
            at = np.flatnonzero(mask[low])
            key = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
            same = self.keys[key] == found[at]
            at, key = at[same], key[same]
            text = np.searchsorted(first, at, "right") - 1
            inside = at + width <= first[text + 1]
            yield at[inside], key[inside]

    def match(
        self, words: np.ndarray, first: np.ndarray, mask: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, window) of every occurrence of a window, verified."""
        starts, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, key in self.occurrences(words, first, mask):
            count = self.first[key + 1] - self.first[key]
            entry = np.repeat(self.first[key], count) + tx.ranges(count)
            window = self.window[entry]
            start = np.repeat(at, count) - self.place[entry]
            text = np.searchsorted(first, np.repeat(at, count), "right") - 1
            fits = (start >= first[text]) & (start + self.size[window] <= first[text + 1])
            start, window = start[fits], window[fits]
            for size in np.unique(self.size[window]):
                own = np.flatnonzero(self.size[window] == size)
                table = words[start[own][:, None] + np.arange(size)]
                same = (table == self.words[window[own], :size]).all(axis=1)
                starts.append(start[own][same])
                windows.append(window[own][same])
        return np.concatenate(starts), np.concatenate(windows)


def _count_keys(docs: DataFrame, block: WindowBlock) -> np.ndarray:
    """Occurrences in all documents of every shingle of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        mask = block.mask()
        total = np.zeros(len(block.keys), np.int64)
        for batch in batches:
            for _, _, data, offsets in tx.text_slices(batch, "text"):
                words, first = tx.word_hashes(data, offsets, tx.LETTERS_DIGITS)
                for _, key in block.occurrences(words, first, mask):
                    total += np.bincount(key, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    rows = (
        docs.select(F.col("text"))
        .mapInArrow(count, "key long, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most one row per shingle of the block
    )
    out = np.zeros(len(block.keys), np.int64)
    out[np.asarray(rows["key"])] = np.asarray(rows["n"])
    return out


def find_windows(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    block_windows: int = 200_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: words, words hit, the hit spans, and the items with windows in it.

    Columns: doc_id, text, those in ``keep``, n_words, n_hit, spans (word positions, end
    not in), item_ids (strings in order). Null and empty texts have no words and no hits;
    items without words find nothing; repeated rows are answered one by one; other columns
    are left out, and one named in ``keep`` must not be named like a new one. Empty tables
    give no rows, or rows without hits.

    Windows are taken in blocks of at most ``block_windows``, each broadcast
    after its rows were bounded by a hash; a block's shingles are counted over all
    documents, each window is looked up by its rarest one, the place of the shingle
    gives the only possible alignment, and the whole window is compared there.
    """
    windows = materialise(item_windows(items, item_col, item_text_col, size), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        *keep,
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"),
        F.lit(None).cast("array<string>").alias("item_ids"),
    )
    carried = found.select("doc_id", "text", *keep).schema
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).toArrow()
        if rows.num_rows or not b:
            if b:
                found = materialise(found, "windows-found")
            found = _match_block(found, WindowBlock(rows) if rows.num_rows else None, kind)
    return found.select("doc_id", "text", *keep, "n_words", "n_hit", "spans", "item_ids")


def without_windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options):
    """The rows of ``docs`` in which no window of an item occurs, with their columns."""
    text_col = options.get("text_col", "text")
    keep = tuple(c for c in docs.columns if c not in (id_col, text_col))
    new = {"doc_id", "text", "n_words", "n_hit", "spans", "item_ids"}
    aside = {c: f"kept_{c}" for c in keep if c in new}
    found = find_windows(
        docs.withColumnsRenamed(aside), items, id_col, keep=tuple(aside.get(c, c) for c in keep), **options
    ).where(F.col("n_hit") == 0)
    back = {"doc_id": id_col, "text": text_col} | {new: old for old, new in aside.items()}
    return found.select(
        *[F.col({v: k for k, v in back.items()}.get(c, c)).alias(c) for c in docs.columns]
    )


def _match_block(found: DataFrame, block: WindowBlock | None, kind: str) -> DataFrame:
    if block is not None:
        block.choose(_count_keys(found, block))
    shared = found.sparkSession.sparkContext.broadcast(block)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        mask = block.mask() if block is not None else None
        for batch in batches:
            for row, end, data, offsets in tx.text_slices(batch, "text"):
                words, first = tx.word_hashes(data, offsets, tx.LETTERS_DIGITS)
                part = batch.slice(row, end - row)
                yield _answer(part, block, mask, words, first)

    schema = (
        f"{kind}, n_words long, n_hit long, "
        "spans array<struct<start:int,end:int>>, item_ids array<string>"
    )
    before = [c for c in found.columns if c not in ("n_words", "n_hit")]
    return found.select(*before).mapInArrow(match, schema)


def _answer(part: pa.RecordBatch, block, mask, words: np.ndarray, first: np.ndarray):
    n = part.num_rows
    steps = np.zeros(len(words) + 1, np.int64)
    pairs: list[set] = [set(x or ()) for x in part.column("item_ids").to_pylist()]
    for d, spans in enumerate(part.column("spans").to_pylist()):
        for span in spans or ():
            steps[first[d] + span["start"]] += 1
            steps[first[d] + span["end"]] -= 1
    if block is not None and len(words):
        start, window = block.match(words, first, mask)
        np.add.at(steps, start, 1)
        np.add.at(steps, start + block.size[window], -1)
        text = np.searchsorted(first, start, "right") - 1
        both = np.unique(text * len(block.items) + block.item[window])
        for x in both:
            pairs[x // len(block.items)].add(block.items[x % len(block.items)])
    covered = np.cumsum(steps)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    hit = total[first[1:]] - total[first[:-1]]
    spans = [[] for _ in range(n)]
    for d in np.flatnonzero(hit):
        own = np.diff(np.concatenate([[0], covered[first[d] : first[d + 1]], [0]]).astype(np.int8))
        spans[d] = [
            {"start": int(a), "end": int(b)}
            for a, b in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1), strict=True)
        ]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    carried = [c for c in part.schema.names if c not in ("spans", "item_ids")]
    return pa.RecordBatch.from_arrays(
        [
            *[part.column(c) for c in carried],
            pa.array(np.diff(first), pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array(spans, span),
            pa.array([sorted(x) for x in pairs], pa.list_(pa.string())),
        ],
        [*carried, "n_words", "n_hit", "spans", "item_ids"],
    )
