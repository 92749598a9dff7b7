"""Similarity joins against brute force, with small blocks and hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import blockjoin, postings, retrieval, tfidf


def brute(q_ids, q, c_ids, c, k, floor=None, skip_self=False):
    scores = np.round(q @ c.T, blockjoin.DECIMALS)
    out = set()
    for i, row in zip(q_ids, scores):
        pairs = sorted((-s, j) for s, j in zip(row, c_ids) if not (skip_self and i == j) and (floor is None or s >= floor))
        out |= {(i, j, -s, r) for r, (s, j) in enumerate(pairs[:k], 1)}
    return out


def result(df):
    return {(r["query_id"], r["key"], r["similarity"], r["rank"]) for r in df.collect()}


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("floor,skip", [(None, True), (0.3, False)])
def test_dense_is_exact(spark, floor, skip):
    rng = np.random.default_rng(5)
    centres = unit(rng.normal(size=(6, 8)))
    vectors = unit(centres[rng.integers(0, 6, 300)] + 0.2 * rng.normal(size=(300, 8)))
    vectors[100:200] = vectors[100]  # a third of the rows are one vector
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "key BIGINT, vec ARRAY<DOUBLE>")
    got = blockjoin.topk_dense(
        df.withColumnRenamed("key", "query_id"), df, 4, min_similarity=floor, exclude_self=skip, pivots=7, block_rows=16, chunk_rows=32
    )
    ids = list(range(300))
    assert result(got) == brute(ids, vectors, ids, vectors, 4, floor, skip)


def test_copies_are_detected_and_collapsed(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, float(i)]) for i in range(300)], "key BIGINT, vec ARRAY<DOUBLE>")
    assert blockjoin._size_and_copies(df, ["vec"]) == (300, True)
    kept = blockjoin._first_copies(df, ["vec"], 4)
    assert kept.count() == 100 + 4 and kept.filter("vec[0] = 1").agg(F.max("key")).first()[0] == 5


def test_dense_prunes_cells():
    near = np.array([[0.99, 0.1]])
    assert [c.tolist() for c in blockjoin._reachable(near, np.array([[1.0, 0.2]]), 1, None)] == [[0]]
    assert [c.tolist() for c in blockjoin._reachable(near, np.array([[1.0, 1.0]]), 1, None)] == [[0, 1]]
    assert [c.tolist() for c in blockjoin._reachable(near, np.array([[1.0, 1.0]]), 1, None, probes=1)] == [[0]]


def sparse_rows(rng, n, width, longest=8):
    rows = []
    for i in range(n):
        low, high = (0, width // 2) if i % 2 else (width // 2, width)  # two vocabularies
        idx = np.sort(rng.choice(np.arange(low, high), size=rng.integers(1, longest), replace=False))
        w = rng.random(len(idx)) + 0.1
        rows.append((i, [int(x) for x in idx], [float(x) for x in w / np.linalg.norm(w)]))
    return rows


@pytest.mark.parametrize("parts, floor", [(1, None), (7, None), (40, 0.6)])
def test_index_is_exact(spark, parts, floor):
    rng = np.random.default_rng(6)
    docs, width = sparse_rows(rng, 300, 50), 50
    docs += [(300 + i, *docs[4][1:]) for i in range(60)]  # copies
    asked = [(i, idx, w) for i, idx, w in docs[:120]]
    df = spark.createDataFrame(docs, "key BIGINT, idx ARRAY<INT>, w ARRAY<DOUBLE>")
    m = np.zeros((len(docs), width))
    for i, idx, w in docs:
        m[i, idx] = w
    index = postings.build_index(df, parts=parts)
    got = postings.topk_index(
        spark.createDataFrame(asked, "query_id BIGINT, idx ARRAY<INT>, w ARRAY<DOUBLE>"), index, 3,
        min_similarity=floor, exclude_self=True,
    )
    ids = list(range(len(docs)))
    want = brute(ids[:120], m[:120], ids, m, 3, floor or 1e-6, True)
    assert result(got) == want
    assert index.count() <= parts and index.agg(F.sum(F.size("keys"))).first()[0] == len(docs)


def test_queries_are_not_copied_for_each_part(spark):
    """Parts are asked in rounds; no round sends a copy of a query to each part, and all rounds together are exact."""
    rng = np.random.default_rng(8)
    docs, width = sparse_rows(rng, 400, 60), 60
    df = spark.createDataFrame(docs, "key BIGINT, idx ARRAY<INT>, w ARRAY<DOUBLE>")
    m = np.zeros((len(docs), width))
    for i, idx, w in docs:
        m[i, idx] = w
    found = postings.topk_index(df.withColumnRenamed("key", "query_id"), postings.build_index(df, parts=25), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    ids = list(range(len(docs)))
    assert result(found) == brute(ids, m, ids, m, 2, 1e-6, False)


def test_bounds_leave_lists_early(spark):
    """A list is read only as far as its weights can still matter."""
    rows = [(k, [0, 1], [1.0 - k / 1000, 0.01]) for k in range(500)]
    df = spark.createDataFrame(rows, "key BIGINT, idx ARRAY<INT>, w ARRAY<DOUBLE>")
    batch = postings.build_index(df, parts=1).toArrow().to_batches()[0]
    part = postings._Part(batch, 0)
    read = []

    class Watched(np.ndarray):
        def __setitem__(self, where, value):
            read.append(len(np.atleast_1d(where)))
            super().__setitem__(where, value)

    part.total = np.zeros(500).view(Watched)
    keys, scores = part.best(np.array([0, 1]), np.array([1.0, 1.0]), 2, 0.98, None)
    assert part.keys[keys].tolist() == [0, 1] and scores.tolist() == [1.01, 1.009]
    assert read[0] < 40
    assert len(part.best(np.array([0]), np.array([1.0]), 2, 1.5, None)[0]) == 0


def test_empty_index(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id BIGINT, vec ARRAY<DOUBLE>")
    assert blockjoin.topk_dense(q, spark.createDataFrame([], "key BIGINT, vec ARRAY<DOUBLE>"), 3).count() == 0
    asked = spark.createDataFrame([(1, [0], [1.0])], "query_id BIGINT, idx ARRAY<INT>, w ARRAY<DOUBLE>")
    index = postings.build_index(asked.withColumnRenamed("query_id", "key").where("key > 1"))
    assert postings.topk_index(asked, index, 3).collect() == []


def test_tfidf_matches_and_decision(spark):
    docs = spark.createDataFrame([(1, "payment page crashes badly"), (2, "login screen flickers"), (3, "payment page crashes badly")], "doc_id BIGINT, text STRING")
    asked = spark.createDataFrame([(7, "payment page crashes badly"), (8, "unrelated words entirely"), (9, "")], "query_id BIGINT, text STRING")
    matches, decision = tfidf.tfidf_matches(asked, docs, stop_words=[])
    rows = sorted((r["query_id"], r["rank"], r["key"], round(r["similarity"], 3)) for r in matches.collect())
    assert rows == [(7, 1, 1, 1.0), (7, 2, 3, 1.0)]
    got = {r["query_id"]: (r["duplicate_of"], r["duplicate_confidence"]) for r in decision.collect()}
    assert got == {7: (1, 1.0), 8: (None, 0.0), 9: (None, 0.0)}


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    from faultline import lexicons as lx

    known = StopWordsRemover.loadDefaultStopWords("english")
    assert set(lx.STOP_WORDS) <= set(known)
    assert {w for w in known if len(w) > 1 and w.isalpha()} <= set(lx.STOP_WORDS) | {"cannot", "could", "ought", "would"}


def test_rerank_skipped_for_small_pools(spark):
    v = "vec ARRAY<DOUBLE>, text STRING"
    q = spark.createDataFrame([(1, [1.0, 0.0], "same words")], f"query_id BIGINT, {v}")
    index = spark.createDataFrame([("a", [0.6, 0.8], "same words"), ("b", [1.0, 0.0], "other")], f"key STRING, {v}")
    tickets = spark.createDataFrame([("t", [0.8, 0.6], "same words")], f"key STRING, {v}")
    plain = retrieval.rerank_two_stage(q, index, tickets, top_k=10).orderBy("rank").collect()
    assert [r["key"] for r in plain] == ["b", "t", "a"] and plain[0]["is_duplicate_candidate"]
    ranked = retrieval.rerank_two_stage(q, index, tickets, top_k=2).orderBy("rank").collect()
    assert [r["key"] for r in ranked] == ["t", "a"] and ranked[0]["is_duplicate_candidate"]


def test_relevance_keeps_queries_without_matches(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id BIGINT")
    m = spark.createDataFrame([(1, "a", 0.10), (1, "b", 0.09)], "query_id BIGINT, key STRING, similarity DOUBLE")
    got = {r["query_id"]: tuple(r)[1:] for r in retrieval.relevance_summary(q, m).collect()}
    assert got == {1: (1, 2, 0.10, False), 2: (0, 0, 0.0, True)}


def test_approximate_is_a_subset_of_exact(spark, sf):
    idx = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    q = idx.withColumnRenamed("key", "query_id")
    pairs = lambda df: {(r[0], r[1]) for r in df.select("query_id", "key").collect()}
    near = pairs(retrieval.approximate_join(q, idx, k=10, probes=6, min_similarity=0.3))
    exact = pairs(blockjoin.topk_dense(q, idx, 500, min_similarity=0.3))
    assert near <= exact and len(near) > 0.5 * len(exact)
    assert pairs(retrieval.approximate_join(q, idx, k=500, probes=16, min_similarity=0.3)) == exact


def test_recall_over_hundreds_of_cells(spark):
    """Probes follow the recall asked for, on a table with many cells, and stay few."""
    rng = np.random.default_rng(12)
    centres = unit(rng.normal(size=(60, 16)))
    vectors = unit(centres[rng.integers(0, 60, 8000)] + 0.18 * rng.normal(size=(8000, 16)))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "key BIGINT, vec ARRAY<DOUBLE>")
    asked = df.where("key < 1500").withColumnRenamed("key", "query_id")
    exact = np.round(vectors[:1500] @ vectors.T, 6)
    want = {(q, int(c)) for q in range(1500) for c in np.lexsort((np.arange(8000), -exact[q]))[:10]}
    shares = []
    for recall in (0.9, 0.98):
        cells = blockjoin.dense_cells(df, 10, pivots=300)
        probes = blockjoin.probes_for(cells, asked, 10, recall)
        found = {(r.query_id, r.key) for r in retrieval.approximate_join(asked, df, k=10, recall=recall, pivots=300).collect()}
        shares.append((len(found & want) / len(want), probes))
        assert len(found & want) >= recall * len(want) and probes < 120
    assert shares[0][1] < shares[1][1]


@pytest.mark.parametrize("k,floor", [(1, None), (4, None), (6, 2.0)])
def test_dense_takes_any_length_and_nulls(spark, k, floor):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(400, 6)) * rng.uniform(0.1, 10, size=(400, 1))
    vectors[::50] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, (900, None)], "key BIGINT, vec ARRAY<DOUBLE>")
    got = blockjoin.topk_dense(
        df.withColumnRenamed("key", "query_id"), df, k, min_similarity=floor, pivots=9, block_rows=32, chunk_rows=64
    )
    ids = list(range(400))
    assert result(got) == brute(ids, vectors, ids, vectors, k, floor)


def test_index_versions(spark, tmp_path):
    """Readers take the newest complete version; an older one stays as it was loaded."""
    docs = [(1, "payment page crashes badly", "Ada"), (2, "login screen flickers", "Bob")]
    schema = "doc_id BIGINT, text STRING, assignee STRING"
    asked = spark.createDataFrame([(7, "checkout button hidden")], "query_id BIGINT, text STRING")

    def best(index):
        matches, _ = tfidf.search_text_index(asked, index, stop_words=[])
        return [(r.query_id, r.key, r.rank) for r in matches.collect()]

    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        tfidf.load_text_index(spark, path)
    old = tfidf.build_text_index(spark.createDataFrame(docs, schema), stop_words=[], path=path)
    assert best(old) == [] and [r.assignee for r in old.facts.orderBy("key").collect()] == ["Ada", "Bob"]
    more = spark.createDataFrame([*docs, (3, "checkout button hidden", "Cem")], schema)
    new = tfidf.build_text_index(more, stop_words=[], path=path)
    assert best(new) == best(tfidf.load_text_index(spark, path)) == [(7, 3, 1)]
    assert best(old) == [] == best(tfidf.load_text_index(spark, path, 0))
    (tmp_path / "index/version=2/postings").mkdir(parents=True)  # half written
    assert best(tfidf.load_text_index(spark, path)) == [(7, 3, 1)]


def test_rare_terms_drop_out_before_they_are_counted(spark):
    rng = random.Random(3)
    rows = [(k % 50 if k % 7 else None, None if k % 11 == 0 else " ".join(
        f"w{min(int(rng.paretovariate(0.8)), 400)}" for _ in range(60))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = tfidf.term_counts(docs)
    for most in (5, 20):
        few = tfidf.term_counts(docs, most=most)
        assert few.count() < 0.9 * every.count()
        want, found = (sorted(map(tuple, tfidf.vocab_limit(c, most).collect())) for c in (every, few))
        assert len(want) == most and found == want
    # fewer words than asked for: nothing may be left out
    assert tfidf.term_counts(docs, most=100_000).count() == every.count()


@pytest.mark.parametrize("floor", [None, 0.1])
def test_best_of_a_block_with_ties_and_repeated_keys(floor):
    rng = np.random.default_rng(8)
    for n, k in ((3, 5), (40, 5), (400, 5), (400, 30)):
        scores = rng.normal(size=(30, n)).round(rng.choice([1, 3, 7])) / 3 + rng.choice([0, 4e-7], (30, n))
        keys, asked = rng.integers(0, 2 * n, n), rng.integers(0, 2 * n, 30)
        for skip in (False, True):
            want = []
            for i, row in enumerate(np.round(scores, blockjoin.DECIMALS)):
                pairs = [(-s, j) for s, j in zip(row, keys) if not (skip and asked[i] == j) and (floor is None or s >= floor)]
                want += [(asked[i], j, -s) for s, j in sorted(pairs)[:k]]
            assert list(zip(*blockjoin._best(scores, asked, keys, k, floor, skip))) == want


def test_few_scores_of_a_block_are_rounded(monkeypatch):
    rng, sizes, done = np.random.default_rng(9), [], np.round
    monkeypatch.setattr(np, "round", lambda x, *a: sizes.append(np.size(x)) or done(x, *a))
    blockjoin._best(rng.normal(size=(100, 4096)), np.arange(100), np.arange(4096), 5, None, True)
    assert sum(sizes) < 100 * 64


@pytest.mark.parametrize("floor,skip", [(None, False), (0.2, True)])
def test_vectors_are_not_copied_for_each_block(spark, floor, skip):
    """Queries meet the blocks as they were written; string keys, ties and repeated queries; exact over many blocks."""
    rng = np.random.default_rng(14)
    vectors = unit(rng.normal(size=(260, 5)).round(1) + 0.01)
    ids = [f"k{i:03d}" for i in range(260)]
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
    df = spark.createDataFrame(rows, "key STRING, vec ARRAY<DOUBLE>")
    cells = blockjoin.dense_cells(df, 4, pivots=5)
    asked = df.withColumnRenamed("key", "query_id")
    found = blockjoin.search_cells(cells, asked, 3, floor, skip, block_rows=8, chunk_rows=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert result(found) == brute(ids, vectors, ids, vectors, 3, floor, skip)
    twice = [tuple(r) for r in blockjoin.search_cells(cells, asked.unionAll(asked.limit(3)), 3, floor, skip).collect()]
    assert len(twice) == found.count()


def test_a_chunk_remembers_the_best_of_its_blocks(spark):
    """No more than k rows of a query leave a task, however many blocks it has met."""
    rng = np.random.default_rng(15)
    vectors = unit(rng.normal(size=(4000, 6)))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "key BIGINT, vec ARRAY<DOUBLE>").coalesce(2)
    cells = blockjoin.dense_cells(df, 2, pivots=9)
    queries = df.where("key < 200").withColumnRenamed("key", "query_id")
    near = F.pandas_udf(lambda vec: vec.map(lambda v: 0).astype("int32"), "int")
    every = lambda rows: (np.full((len(rows), 9), 9.0), [np.arange(9)] * len(rows))
    rows = blockjoin._join_blocks(queries, cells, near, every, 2, None, False, 50, 64).collect()
    best = {}
    for r in rows:
        best.setdefault(r.query_id, []).append((-r.similarity, r.key))
    exact = np.round(vectors[:200] @ vectors.T, 6)
    assert {q: sorted(b)[:2] for q, b in best.items()} == {
        q: [(-exact[q, c], c) for c in np.lexsort((np.arange(4000), -exact[q]))[:2]] for q in range(200)
    }
    # 80 blocks and more; two rows for each partition of them
    assert len(rows) <= 200 * 2 * spark.sparkContext.defaultParallelism


def test_small_cells_share_a_chunk():
    first, split = blockjoin._numbers([3, 4, 0, 2, 30, 5, 6], 10)
    assert (first, split) == ([0, 0, 0, 0, 1, 4, 5], [1, 1, 1, 1, 3, 1, 1])
