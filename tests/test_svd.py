"""The learned encoder against a dense decomposition, and against the hashed encoder."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.operators import classify, svd


@pytest.mark.parametrize("fan_in, piece", [(2, 7), (32, 512)])
def test_against_a_dense_decomposition(spark, monkeypatch, fan_in, piece):
    monkeypatch.setattr(svd, "FAN_IN", fan_in)
    monkeypatch.setattr(svd, "PIECE", piece)
    rng = np.random.default_rng(4)
    left, right = np.linalg.qr(rng.normal(size=(300, 12)))[0], np.linalg.qr(rng.normal(size=(40, 12)))[0]
    dense = left * np.array([9, 7, 6, 5, 4, 1, 0.9, 0.8, 0.5, 0.3, 0.2, 0.1]) @ right.T
    dense[np.abs(dense) < 0.01] = 0
    dense[250:] = 0
    rows = [(k, [int(i) for i in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for k, r in enumerate(dense)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, idx ARRAY<INT>, w ARRAY<DOUBLE>").repartition(9)
    vectors, values = svd.truncated_svd(df, 40, 5, rounds=8, extra=4)
    _, want, axes = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, want[:5], rtol=1e-6)
    # the same subspace: all angles between the two are zero
    assert np.allclose(np.linalg.svd(vectors.T @ axes[:5].T)[1], 1, atol=1e-6)
    assert np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-9)


def test_no_rows_and_few_directions(spark):
    schema = "doc_id BIGINT, idx ARRAY<INT>, w ARRAY<DOUBLE>"
    vectors, values = svd.truncated_svd(spark.createDataFrame([], schema), 6, 3)
    assert vectors.shape == (6, 0) and values.size == 0
    one = spark.createDataFrame([(1, [2], [3.0]), (2, [2], [4.0]), (3, [], [])], schema)
    vectors, values = svd.truncated_svd(one, 6, 3)
    assert np.allclose(values, [5]) and np.allclose(vectors[:, 0], np.eye(6)[2])


def test_learned_meaning_beats_the_hash(spark, sf):
    """Leave-one-out votes of the five nearest find the language more often."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = docs.select("doc_id", F.left("text", F.lit(60)).alias("text"), "lang")
    learned = svd.embed_svd(texts, svd.fit_svd_encoder(texts, rank=24, max_features=3000))
    hashed = classify.embed_text(texts, classify.fit_encoder(texts, 24)).select("doc_id", "vec")

    def accuracy(vectors):
        rows = vectors.join(texts.select("doc_id", "lang"), "doc_id").where("vec is not null")
        own = [(r.doc_id, np.array(r.vec, float), r.lang) for r in rows.collect()]
        m, lang = np.stack([v for _, v, _ in own]), np.array([x for *_, x in own])
        near = m @ m.T
        np.fill_diagonal(near, -9)
        best = np.argsort(-near, axis=1)[:, :5]
        votes = [max(set(lang[b]), key=lambda x: ((lang[b] == x) * near[i, b]).sum()) for i, b in enumerate(best)]
        return np.mean(np.array(votes) == lang), len(own)

    (good, n), (base, _) = accuracy(learned), accuracy(hashed)
    print(good, base, n)
    assert n > 500 and good > base + 0.02
    twice = texts.limit(20).select("doc_id", F.lit("the same words in here again").alias("text"))
    found = svd.embed_svd(twice.unionByName(texts.limit(1).select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit("").alias("text"))), svd.fit_svd_encoder(texts, rank=8, max_features=500))
    vecs = {r.doc_id: r.vec for r in found.collect()}
    assert vecs.pop(-1) is None and len({str(v) for v in vecs.values()}) == 1


def test_products_of_a_batch_stay_small():
    """Rows longer than a step are put together, and no more than some steps' products are held."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(9000, n, replace=False)).astype(np.int32) for n in [5000, 0, 1, 3000, *[400] * 100]]
    weights = [rng.random(len(r)) for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], ["idx", "w"])
    basis = rng.normal(size=(9000, 40))
    tracemalloc.start()
    found = svd._times(batch, basis)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.array([w @ basis[r] if len(r) else np.zeros(40) for r, w in zip(rows, weights)])
    assert np.allclose(found, want, atol=1e-9) and peak < 6 << 20
