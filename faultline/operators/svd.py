"""A learned text encoder: truncated SVD of the TF-IDF matrix by block power iteration.

The matrix stays in its rows. A round multiplies each batch of rows with the current basis and
back, and adds the products up in a tree of bounded fan-in. The basis has ``max_features`` times
the rank numbers whatever the corpus, so it may be on the driver and in every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.operators import tfidf
from faultline.session import materialise

#: Terms in a piece of a product: a piece is some 300 kB at a rank of 72.
PIECE = 512
FAN_IN = 32
#: Entries multiplied at a time, of one order and of the other: their products stay in a core's cache.
STEP, STEP_BACK = 1 << 11, 1 << 13


@dataclass
class SvdEncoder:
    """``vocab`` as in :mod:`tfidf`, ``basis`` (terms x rank) and singular values, largest first."""

    vocab: DataFrame
    basis: np.ndarray
    values: np.ndarray
    stop_words: tuple[str, ...]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of rows, columns and weights of the entries of a batch of sparse rows."""
    idx, w = (batch.column(c) for c in ("idx", "w"))
    counts = np.diff(idx.offsets.to_numpy())
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (idx, w)]
    return np.repeat(np.arange(len(counts)), counts), flat[0].astype(np.int64), flat[1]


def _times(batch: pa.RecordBatch, basis: np.ndarray) -> np.ndarray:
    row, col, w = _rows(batch)
    out = np.zeros((batch.num_rows, basis.shape[1]))
    for at in range(0, len(row), STEP):
        part = slice(at, at + STEP)
        products = basis[col[part]] * w[part, None]
        own = row[part]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] += np.add.reduceat(products, first, axis=0)
    return out


def _summed(parts: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sums of ``piece, task, data`` by piece, at most ``FAN_IN`` at a time in a task."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in table["data"]], axis=0)
        row = [table["piece"][0].as_py(), table["task"][0].as_py(), total.tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["piece", "task", "data"])

    tasks = max(tasks, 2)
    while tasks > 1:
        up = parts.select("piece", F.floor(F.col("task") / FAN_IN).cast("int").alias("task"), "data")
        parts = up.groupBy("piece", "task").applyInArrow(add, "piece int, task int, data binary")
        tasks = -(-tasks // FAN_IN)
    return {r["piece"]: np.frombuffer(r["data"]) for r in parts.toLocalIterator()}


def _products(rows: DataFrame, basis: np.ndarray, back: bool) -> np.ndarray:
    """``A' A B`` (``back``), or ``(A B)' (A B)``, for the matrix A of the rows and the basis B."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(own.shape if back else (own.shape[1],) * 2)
        for batch in batches:
            product = _times(batch, own)
            if back:
                row, col, w = _rows(batch)
                for at in range(0, len(row), STEP_BACK):
                    part = slice(at, at + STEP_BACK)
                    order = np.argsort(col[part], kind="stable")
                    c, r, x = col[part][order], row[part][order], w[part][order]
                    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                    total[c[first]] += np.add.reduceat(product[r] * x[:, None], first, axis=0)
            else:
                total += product.T @ product
        task = TaskContext.get().partitionId()
        for piece in range(0, len(total), PIECE):
            data = np.ascontiguousarray(total[piece : piece + PIECE]).tobytes()
            columns = [pa.array([v], t) for v, t in ((piece // PIECE, pa.int32()), (task, pa.int32()), (data, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "task", "data"])

    parts = rows.select("idx", "w").mapInArrow(multiply, "piece int, task int, data binary")
    found = _summed(parts, rows.select("idx").rdd.getNumPartitions())
    shape = basis.shape if back else (basis.shape[1],) * 2
    out = [found.get(k, np.zeros(0)) for k in range(-(-shape[0] // PIECE))]
    flat = np.concatenate(out) if out else np.zeros(0)
    return flat.reshape(shape) if flat.size else np.zeros(shape)


def truncated_svd(
    rows: DataFrame, width: int, rank: int, rounds: int = 6, extra: int = 8, seed: int = 11
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (width x rank) and values of the rows ``idx array<int>, w array<double>``.

    ``rounds`` of block power iteration from a random block of ``rank + extra`` columns, with a QR
    of that fixed width after each; then the values and vectors within the last block. ``rows``
    are read once a round and should be a written table. Of less than ``rank`` directions those
    there are are returned. The sign of a vector is such that its largest entry is positive.
    """
    size = min(width, rank + extra)
    if not size:
        return np.zeros((width, 0)), np.zeros(0)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_products(rows, basis, True))[0]
    squares, turn = np.linalg.eigh(_products(rows, basis, False))
    order = np.argsort(-squares)[:rank]
    order = order[squares[order] > 1e-12 * max(squares.max(initial=0.0), 1e-300)]
    vectors = basis @ turn[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else 1.0
    return vectors * signs, np.sqrt(squares[order])


def fit_svd_encoder(
    docs: DataFrame,
    rank: int = 64,
    max_features: int = lx.TFIDF_MAX_FEATURES,
    rounds: int = 6,
    stop_words: Sequence[str] = lx.STOP_WORDS,
) -> SvdEncoder:
    """An encoder learned from all of ``docs(doc_id, text)``."""
    words = tfidf.tokenised(docs.select("doc_id", "text"), stop_words)
    vocab = materialise(tfidf.vocabulary(tfidf.term_counts(words, stop_words, most=max_features), words, max_features), "vocab")
    rows = materialise(tfidf.vectors(words, vocab, stop_words), "tfidf-rows")
    basis, values = truncated_svd(rows, vocab.count(), rank, rounds)
    return SvdEncoder(vocab, basis, values, tuple(stop_words))


def embed_svd(docs: DataFrame, encoder: SvdEncoder) -> DataFrame:
    """``doc_id, vec``: unit vectors in the learned space; null without a known term.

    ``doc_id`` must be unique; a null id has no vector. Equal texts have equal vectors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(encoder.basis)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _times(batch, shared.value)
            length = np.linalg.norm(found, axis=1)
            found = found / np.maximum(length, 1e-300)[:, None]
            flat = pa.array(found.ravel())
            bounds = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
            vec = pa.ListArray.from_arrays(bounds, flat, mask=pa.array(length < 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), vec], ["doc_id", "vec"])

    rows = tfidf.vectors(docs.select("doc_id", "text"), encoder.vocab, list(encoder.stop_words))
    found = rows.mapInArrow(project, f"doc_id {kind}, vec array<double>")
    return docs.select("doc_id").join(found, "doc_id", "left")
