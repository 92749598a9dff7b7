"""The CRF: probabilities against brute force, held-out accuracy, switched texts."""

import itertools

import numpy as np
import pytest

from faultline.llm import language
from faultline.llm.queries import op5_language


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(7, 3)).astype(np.float32)
    transitions = rng.normal(size=(3, 3)).astype(np.float32)
    starts, lengths = language.sequences(np.array([0, 4, 4, 7]), 4)
    got, pairs = language.marginals(scores, transitions, starts, lengths)
    total = np.zeros((3, 3))
    for start, n in zip(starts, lengths, strict=True):
        weight, want, moves = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = sum(scores[start + t, y] for t, y in enumerate(path))
            s += sum(transitions[a, b] for a, b in itertools.pairwise(path))
            weight += np.exp(s)
            for t, y in enumerate(path):
                want[t, y] += np.exp(s)
            for a, b in itertools.pairwise(path):
                moves[a, b] += np.exp(s)
        assert np.allclose(got[start : start + n], want / weight, atol=1e-4)
        total += moves / weight
    assert np.allclose(pairs, total, atol=1e-3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return language.fit(documents.where("doc_id % 3 != 1"))


def test_held_out_accuracy(spark, documents):
    rows = op5_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_switched_text(spark, documents, model):
    parts = {}
    for r in documents.where("n_chars > 900").orderBy("doc_id").collect():
        if " | " not in r.text:
            parts.setdefault(r.lang, " ".join(r.text.split()[20:80]))
    text = " ".join([parts["en"], parts["de"], parts["es"]])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    runs = language.identify(docs, model).collect()[0].runs
    by_language = {}
    for run in runs:
        by_language[run.lang] = by_language.get(run.lang, 0) + run.words
    assert sum(by_language.values()) == sum(r.words for r in runs)
    assert set(by_language) >= {"en", "de", "es"} and len(runs) < 20
    assert min(by_language[x] for x in ("en", "de", "es")) > 40


def test_odd_texts(spark, model):
    texts = [None, "", "123 ... 🙂", "the", "the", "é" * 50000, "the of and " * 30000, "日本"]
    docs = spark.createDataFrame(
        [(k, t, 9) for k, t in enumerate(texts)], "doc_id long, text string, score int"
    )
    rows = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [rows[k].lang_pred for k in range(3)] == ["und"] * 3
    assert all(rows[k].score == 0 and rows[k].runs == [] for k in range(3))
    assert rows[3].lang_pred == "en" and rows[3][1:] != rows[5][1:]
    assert rows[6].lang_pred == "en" and sum(r.words for r in rows[6].runs) == 90000
    assert rows[7].lang_pred in model.languages
    assert language.identify(docs.limit(0), model).collect() == []


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert language.identify(docs, model).collect()[0].lang_pred == "und"
