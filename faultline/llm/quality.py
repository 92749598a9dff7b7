"""Quality classifier: random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import text as tx

BUCKET_BITS = 14
DIMENSIONS = 32
WINDOW = 2
NONZERO = 4

#: Classes of bytes in the shape of a word: small, capital, digit, then each sign by itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_SHAPE[128:] = ord("a")


def index_vectors(salt: int) -> np.ndarray:
    """A sparse vector of +1 and -1 for each bucket, the same in every run."""
    rng = np.random.default_rng(salt)
    out = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.int32)
    rows = np.arange(len(out))
    for k in range(NONZERO):
        out[rows, rng.integers(0, DIMENSIONS, len(out))] += 1 if k % 2 else -1
    return out


_INDEX: dict[int, np.ndarray] = {}


def _index(salt: int) -> np.ndarray:
    if salt not in _INDEX:
        _INDEX[salt] = index_vectors(salt)
    return _INDEX[salt]


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Buckets of words and of their shapes, place of each text's first word, repeat flags.

    A shape has runs of one class as one sign, so "Xyz," and "Abcdef," are alike.
    The flags tell whether a word equals the one before and whether it occurred
    earlier in its text.
    """
    starts, ends, first = tx.word_bounds(data, offsets, tx.NOT_SPACE)
    words = tx.span_hashes(tx.LOWER[data], starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    inside = np.concatenate([[0], np.cumsum(keep)])
    shapes = tx.span_hashes(shape[keep], inside[starts], inside[ends])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((words, text))
    known = np.zeros(len(words), bool)
    same = (words[order][1:] == words[order][:-1]) & (text[order][1:] == text[order][:-1])
    known[order[1:][same]] = True
    low = np.uint64(64 - BUCKET_BITS)
    return (words >> low).astype(np.int64), (shapes >> low).astype(np.int64), first, again, known


def context_sums(buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the sum of the index vectors of its neighbours in the same text."""
    vectors = _index(1)[buckets]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros_like(vectors)
    for step in range(1, WINDOW + 1):
        same = (text[step:] == text[:-step])[:, None]
        out[step:] += vectors[:-step] * same
        out[:-step] += vectors[step:] * same
    return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors (buckets x dimensions) summed over all texts, scaled to length one.

    A task adds up the contexts of its texts; the sums of all tasks meet in an
    ordinary grouped sum. What reaches the driver has one row per bucket.
    """
    names = [f"v{k}" for k in range(DIMENSIONS)]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.int64)
        for batch in batches:
            for _, _, data, offsets in tx.text_slices(batch, text_col):
                buckets, _, first, _, _ = word_units(data, offsets)
                if not len(buckets):
                    continue
                sums = context_sums(buckets, first)
                order = np.argsort(buckets.astype(np.uint16), kind="stable")
                at = np.flatnonzero(np.diff(buckets[order], prepend=-1))
                total[buckets[order][at]] += np.add.reduceat(sums[order], at, axis=0)
        some = np.flatnonzero(total.any(axis=1))
        columns = [pa.array(some)] + [pa.array(total[some, k]) for k in range(DIMENSIONS)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", *names])

    schema = "bucket long, " + ", ".join(f"{x} long" for x in names)
    rows = (
        docs.select(text_col)
        .mapInArrow(collect, schema)
        .groupBy("bucket")
        .agg(*[F.sum(x).alias(x) for x in names])
        .toArrow()
    )
    out = np.zeros((1 << BUCKET_BITS, DIMENSIONS))
    if rows.num_rows:
        out[np.asarray(rows["bucket"])] = np.stack([np.asarray(rows[x]) for x in names], axis=1)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean vector of each text: contexts of words, index vectors of shapes, repeat rates."""
    buckets, shapes, first, again, known = word_units(data, offsets)
    n = np.diff(first)
    flags = np.stack([again, known, np.ones(len(again))], axis=1)
    parts = [vectors[buckets], _index(2)[shapes].astype(np.float32), flags]
    out = []
    for part in parts:
        total = np.zeros((len(n), part.shape[1]))
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(part, first[some], axis=0, dtype=np.float64)
        out.append(total)
    scale = 1 / np.maximum(n, 1)[:, None]
    out[2][:, 2] = np.log1p(n) / np.maximum(scale[:, 0], 1e-300)
    return np.concatenate([x * scale for x in out], axis=1)


FEATURES = 2 * DIMENSIONS + 3


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    hidden: tuple[np.ndarray, np.ndarray]
    output: tuple[np.ndarray, float]
    temperature: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        logit = _forward(self, features)[0] / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _forward(model: Model, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = (features - model.centre) / model.spread
    hidden = np.tanh(x @ model.hidden[0] + model.hidden[1])
    return hidden @ model.output[0] + model.output[1], hidden, x


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 20_000,
    units: int = 24,
    epochs: int = 60,
    seed: int = 5,
) -> Model:
    """Word vectors from all of ``docs``, a network from a bounded sample of ``labels``.

    The sample are at most ``max_rows`` labelled ids by their hashes; ids or labels
    that are null are left out, of several labels of an id the highest counts. A tenth
    of the sample sets the temperature. Without labels every score is 0.5.
    """
    vectors = word_vectors(docs, text_col)
    pairs = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    share = min(1.0, 1.1 * max_rows / max(pairs.count(), 1))
    sample = (
        pairs.dropna()
        .where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    names = [f"f{k}" for k in range(FEATURES)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tx.text_slices(batch, "text"):
                found = pooled(shared.value, data, offsets)
                part = batch.slice(row, end - row)
                columns = [part.column("id"), part.column("label")]
                columns += [pa.array(found[:, k]) for k in range(FEATURES)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", *names])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = own.join(F.broadcast(sample), "id")  # at most max_rows pairs of numbers
    schema = f"id {own.schema[0].dataType.simpleString()}, label double, "
    rows = labelled.mapInArrow(features, schema + ", ".join(f"{x} double" for x in names))
    table = rows.orderBy(F.xxhash64("id"), *names[:4]).toArrow()
    x = np.stack([np.asarray(table[c]) for c in names], axis=1).reshape(-1, FEATURES)
    return train(vectors, x, np.asarray(table["label"]), units, epochs, seed)


def train(
    vectors: np.ndarray, x: np.ndarray, y: np.ndarray, units: int, epochs: int, seed: int
) -> Model:
    """Two layers by Adam on the logistic loss, then the temperature on a held-back tenth."""
    rng = np.random.default_rng(seed)
    centre = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    spread = x.std(axis=0) + 1e-3 if len(x) else np.ones(FEATURES)
    weights = [
        rng.normal(0, FEATURES**-0.5, (FEATURES, units)),
        np.zeros(units),
        rng.normal(0, units**-0.5, units) if len(x) else np.zeros(units),
        np.zeros(1),
    ]
    back = np.arange(len(x)) % 10 == 9
    own = np.flatnonzero(~back)
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        rng.shuffle(own)
        for at in range(0, len(own), 128):
            pick = own[at : at + 128]
            model = Model(vectors, centre, spread, (weights[0], weights[1]), (weights[2], weights[3][0]), 1.0)
            logit, hidden, scaled = _forward(model, x[pick])
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[pick]) / len(pick)
            inner = np.outer(error, weights[2]) * (1 - hidden**2)
            grads = [
                scaled.T @ inner + 1e-5 * weights[0],
                inner.sum(axis=0),
                hidden.T @ error + 1e-5 * weights[2],
                error.sum(keepdims=True),
            ]
            step += 1
            for w, g, a, b in zip(weights, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= 0.004 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, centre, spread, (weights[0], weights[1]), (weights[2], float(weights[3][0])), 1.0)
    if back.any():
        logit, truth = _forward(model, x[back])[0], y[back]
        tried = np.exp(np.linspace(0, 2.5, 81))  # never surer than the network
        loss = [np.logaddexp(0, -(2 * truth - 1) * logit / t).mean() for t in tried]
        model.temperature = float(tried[int(np.argmin(loss))])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds the calibrated probability of label 1 to every row.

    Null and empty texts have the pooled vector zero and get its score; repeated rows
    get equal scores; a column of the same name is replaced; an empty table stays so.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, end, data, offsets in tx.text_slices(batch, text_col):
                found = model.probability(pooled(model.vectors, data, offsets))
                part = batch.slice(row, end - row)
                columns = [part.column(c) for c in kept] + [pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, name])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    return docs.select(*kept).mapInArrow(add, ", ".join([*schema, f"`{name}` double"]))
