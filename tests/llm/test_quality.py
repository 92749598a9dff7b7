"""Word vectors against a plain count, held-out accuracy, odd texts."""

import numpy as np
import pytest

from faultline.llm import quality
from faultline.llm import text as tx
from faultline.llm.queries import op4_quality

SF = "/root/testdata/sf0.01"


def test_word_vectors_are_sums_of_neighbours(spark):
    texts = ["a b c a", "b", None, "", "c c"]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, score int")
    got = quality.word_vectors(docs)

    def bucket(word):
        data = np.frombuffer(word.encode(), np.uint8)
        found = tx.span_hashes(data, np.array([0]), np.array([len(data)]))
        return int(found[0] >> np.uint64(64 - quality.BUCKET_BITS))

    index, want = quality.index_vectors(1), {}
    for text in texts:
        words = (text or "").split()
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if i != j:
                    want[bucket(w)] = want.get(bucket(w), 0) + index[bucket(words[j])]
    for b, vector in want.items():
        assert np.allclose(got[b], vector / np.linalg.norm(vector), atol=1e-6)
    assert set(np.flatnonzero(got.any(axis=1))) == set(want)


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op4_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(rows[x.doc_id], x.quality) for x in labels if rows[x.doc_id].held_out]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.93
    good = [r.score for r, y in held if y]
    bad = [r.score for r, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_odd_texts(spark, model):
    texts = [None, "", " \n", "x", "x", "w " * 200000, "🙂"]
    docs = spark.createDataFrame(
        [(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, score string"
    )
    rows = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in rows.values()) and len(rows) == len(texts)
    assert rows[0] == rows[1] == rows[2] and rows[3] == rows[4]
    assert quality.score(docs.limit(0), model).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).collect()[0].score == 0.5
