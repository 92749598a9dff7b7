"""Words and shingles of whole Arrow batches as 64-bit hashes, without Python strings.

A batch is read as one byte buffer. Words are runs of bytes of a class; their
hashes come from one cumulative sum, shingle hashes from the word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20  # text handled at a time; a longer text is a slice of its own
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2)
_BYTE += np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than the default of 10,000.

    Texts are long: a batch is held on both sides of the pipe to Python, by every task.
    A setting of the session, for the queries and the pipeline to make.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256: true outside the given byte ranges (both ends in)."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: [^\x20\x09-\x0D]+
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
LETTERS_DIGITS = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 2)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:
            _powers[name] = have
    return have


def text_slices(
    batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of stretches of up to ``limit`` bytes.

    A null text has no bytes.
    """
    values = batch.column(column).cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    if not len(values):
        return
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(values):
        end = int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(values))
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each text."""
    inside = word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    before[offsets] = False
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("p", _P, n)[:n], out=total[1:])
    inner = (total[ends] - total[starts]) * _power("i", _P_INVERSE, n)[starts]
    return mix(inner + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, word: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z as a-z, and the number of the first word of each text."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, word)
    return span_hashes(data, starts, ends), first


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, by the place of the first; text ends ignored."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    total = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        total *= np.uint64(0xA0761D6478BD642F)
        total += words[k : len(words) - size + 1 + k]
    return mix(total + np.uint64(size))


def starts_within(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask over n places: a run of ``size`` words from there stays in its text."""
    ok = np.zeros(max(n, 0), bool)
    lengths = np.maximum(np.diff(first) - size + 1, 0)
    places = np.repeat(first[:-1], lengths) + ranges(lengths)
    ok[places] = True
    return ok


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)


def shingle_sets(
    words: np.ndarray, first: np.ndarray, size: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and the place of the first of each text.

    A text with fewer than ``size`` words has all its words as one shingle; one
    without words has none.
    """
    counts = np.diff(first)
    lengths = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    values = np.empty(bounds[-1], np.uint64)
    long = np.flatnonzero(counts >= size)
    if len(long):
        n = lengths[long]
        inner = ranges(n)
        values[np.repeat(bounds[long], n) + inner] = run_hashes(words, size)[
            np.repeat(first[long], n) + inner
        ]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            table = words[first[short][:, None] + np.arange(n)]
            values[bounds[short]] = _rows_hash(table)
    for d in np.flatnonzero(lengths > 1):
        values[bounds[d] : bounds[d + 1]].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][lengths > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[bounds]


def _rows_hash(table: np.ndarray) -> np.ndarray:
    total = table[:, 0].copy()
    for k in range(1, table.shape[1]):
        total *= np.uint64(0xA0761D6478BD642F)
        total += table[:, k]
    return mix(total + np.uint64(table.shape[1]))
