"""Leave-one-out predictions of the logistic model without fitting it once per row.

Without a row the optimum moves by about one Newton step. The Hessian of all rows is added up
once; a row's own part of it has the rank of the classes, so each row needs a small system only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.classify import class_weights
from faultline.operators.svd import PIECE, _summed
from faultline.session import materialise

#: Largest number of parameters; the Hessian has the square of it on the driver and in a task.
PARAMETERS = 4096


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors of a batch with a one behind each."""
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(batch.num_rows, -1)
    return np.hstack([rows, np.ones((len(rows), 1))])


def _probabilities(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    scores = z @ theta.T
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def hessian(rows: DataFrame, theta: np.ndarray, penalty: float) -> np.ndarray:
    """Second derivatives of the weighted loss over ``vec, weight`` and of the penalty.

    ``theta`` has a row of coefficients and an intercept for each class. Parameters are ordered
    class by class. Tasks add up their rows, and their sums are added in a tree.
    """
    k, m = theta.shape
    shared = rows.sparkSession.sparkContext.broadcast(theta)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, m, k, m))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _vectors(batch)
            p, w = _probabilities(z, shared.value), np.asarray(batch.column("weight"))
            for a in range(k):
                for b in range(a, k):
                    part = z.T @ (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None])
                    total[a, :, b] += part
                    if a != b:
                        total[b, :, a] += part.T
        flat, task = total.reshape(k * m, k * m), TaskContext.get().partitionId()
        for piece in range(0, k * m, PIECE):
            data = np.ascontiguousarray(flat[piece : piece + PIECE]).tobytes()
            columns = [pa.array([v], t) for v, t in ((piece // PIECE, pa.int32()), (task, pa.int32()), (data, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "task", "data"])

    parts = rows.select("vec", "weight").mapInArrow(second, "piece int, task int, data binary")
    found = _summed(parts, rows.rdd.getNumPartitions())
    out = np.concatenate([found[n] for n in sorted(found)]).reshape(k * m, k * m)
    free = np.tile(np.append(np.ones(m - 1), 0.0), k)  # intercepts are not penalised
    return out + np.diag(penalty * free)


def approximate_loo(
    index: DataFrame, model: LogisticRegressionModel, classes: Sequence, c: float = 1.0
) -> DataFrame:
    """``key, label, component, confidence`` of every row as if the model had not seen it.

    ``index(key, vec, label)``, ``model`` and ``classes`` as :func:`classify.train_component_lr` made
    them from it, with its ``c``. Class weights stay those of all rows. Rows without a
    vector or with a label the model does not know are left out; ties go to the first class.
    An empty table gives no rows.
    """
    theta = np.hstack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()[:, None]])
    k, m = theta.shape
    if k * m > PARAMETERS:
        raise ValueError(f"{k * m} parameters, more than {PARAMETERS}")
    usable = index.filter(F.col("vec").isNotNull())
    number = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col("label")) - 1
    weights = class_weights(usable).select("label", "weight")
    rows = usable.join(F.broadcast(weights), "label").select("key", "label", "vec", "weight", number.cast("int").alias("_class"))
    rows = materialise(rows.where("_class >= 0"), "leave-out")
    # balanced weights sum to the number of rows, and the fit's penalty per row is 1 / (c rows)
    inverse = np.linalg.pinv(hessian(rows, theta, 1.0 / c), hermitian=True).reshape(k, m, k, m)
    shared = index.sparkSession.sparkContext.broadcast((theta, inverse))
    names = [str(x) for x in classes]

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, inv = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z, w = _vectors(batch), np.asarray(batch.column("weight"))
            p, truth = _probabilities(z, own), np.asarray(batch.column("_class"))
            scores = z @ own.T
            for i in range(len(z)):
                spread = np.einsum("m,kmln,n->kl", z[i], inv, z[i], optimize=True)
                bend = w[i] * (np.diag(p[i]) - np.outer(p[i], p[i]))
                pull = w[i] * (p[i] - (np.arange(k) == truth[i]))
                scores[i] += spread @ np.linalg.solve(np.eye(k) - bend @ spread, pull)
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            scores /= scores.sum(axis=1, keepdims=True)
            best = scores.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array([names[b] for b in best], pa.string()),
                 pa.array(scores[np.arange(len(best)), best])],
                ["key", "label", "component", "confidence"],
            )

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("key", "label")]
    return rows.mapInArrow(leave, ", ".join([*kinds, "component string, confidence double"]))
