"""Votes, cascades, routing and duplicate rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import classify, dedup, drafts, priority, quality, routing


def neighbours(spark, rows):
    return spark.createDataFrame(rows, "query_id BIGINT, rank INT, key BIGINT, label STRING, similarity DOUBLE")


def test_vote_knn_ladder(spark):
    rows = [
        (1, 1, 10, "a", 0.85), (1, 2, 11, "b", 0.84),  # near copy decides
        (2, 1, 10, "a", 0.5), (2, 2, 11, "b", 0.4), (2, 3, 12, "b", 0.4),  # b outvotes a
        (3, 1, 10, "a", -0.1), (3, 2, 11, "b", -0.2),  # nothing positive
        (4, 1, 1, "a", 0.5), (4, 2, 2, "b", 0.5), (4, 3, 3, "c", 0.5),  # a third each
        (5, 1, 1, "a", 0.5), (5, 2, 2, "b", 0.5),  # tie goes to the better rank
    ]
    got = {r["query_id"]: (r["component"], r["method"]) for r in classify.vote_knn(neighbours(spark, rows)).collect()}
    assert got[1] == ("a", "k=1-exact-knn-fallback") and got[2] == ("b", "knn-weighted-vote")
    assert got[3] == ("bugs", "knn-no-positive") and got[4] == ("bugs", "knn-low-conf") and got[5][0] == "a"


def test_loo_proba_sums_to_one(spark):
    rows = [(1, 1, 10, "a", 0.5), (1, 2, 11, "b", 0.25), (2, 1, 10, "a", -0.3)]
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id BIGINT")
    got = classify.loo_proba(neighbours(spark, rows), q, spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "label STRING")).collect()
    for i in (1, 2, 3):
        assert sum(r["probability"] for r in got if r["query_id"] == i) == pytest.approx(1)
    assert {r["probability"] for r in got if r["query_id"] == 2} == {1 / 3}


def test_logistic_regression_learns(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0], "x" if i % 3 else "y") for i in range(60)]
    index = spark.createDataFrame(rows, "key BIGINT, vec ARRAY<DOUBLE>, label STRING")
    model, classes = classify.train_component_lr(index)
    out = classify.predict_component_lr(index.withColumnRenamed("key", "query_id"), model, classes)
    assert classes == ["x", "y"]
    joined = out.join(index.select(F.col("key").alias("query_id"), "label"), "query_id")
    assert joined.filter(F.col("component") != F.col("label")).count() == 0
    assert abs(sum(out.first()["probabilities"].values()) - 1) < 1e-9


def test_vote_priority_edges(spark):
    rows = [
        (1, 0.25, "P1"),  # weight exactly at the floor
        (2, 0.24, "P1"),
        (3, 0.3, "P0"), (3, 0.3, "P1"),  # mean 0.5 rounds to 0
        (4, 0.3, "P1"), (4, 0.3, "P2"),  # mean 1.5 rounds to 2
        (5, 0.3, "odd"),  # unknown counts as 2
        (6, 0.3, "P4"),  # clamped
        (7, 0.19, "P0"),
    ]
    m = spark.createDataFrame(rows, "query_id BIGINT, similarity DOUBLE, priority STRING")
    got = {r["query_id"]: r["vote"] for r in priority.vote_priority(m).collect()}
    assert got == {1: "P1", 2: None, 3: "P0", 4: "P2", 5: "P2", 6: "P3", 7: None}


PARSED = "report_id BIGINT, title STRING, description STRING, impact STRING, actual_result STRING, raw_text STRING, steps_to_reproduce ARRAY<STRING>, platform STRING, reproducibility STRING"
MATCH = "query_id BIGINT, rank INT, key STRING, summary STRING, similarity DOUBLE, priority STRING, is_duplicate_candidate BOOLEAN"


def score(spark, reports, matches=()):
    rows = [(i, "", "", impact, "", text, steps, "iOS", repro) for i, text, steps, impact, repro in reports]
    out = priority.score_priority(spark.createDataFrame(rows, PARSED), spark.createDataFrame(list(matches), MATCH))
    return {r["report_id"]: r for r in out.collect()}


def test_cascade_order(spark):
    long = " zz" * 150
    reports = [
        (1, "complete outage", [], "", "unknown"),
        (2, "we are blocked" + long, [], "", "100%"),
        (3, "quiet" + long, [], "", "unknown"),
        (4, "checkout payment flow completely broken blocked all customers", ["s"], "", "unknown"),
        (5, "wrong results and price mismatch", [], "", "unknown"),
        (6, "majority" + long, [], "", "unknown"),
        (7, "majority", [], "", "unknown"),
        (8, "quiet" + long, [], "", "unknown"),
        (9, "placeholder" + long, [], "", "unknown"),
        (10, "quiet" + long, [], "", "unknown"),
        (11, "short", [], "", "unknown"),
        (12, "weird" + long, [], "", "unknown"),
        (13, "quiet" + long, [], "zero people", "unknown"),
        (14, "quiet" + long, [], "who knows", "unknown"),
    ]
    matches = [
        (3, 1, "K-1", "old one", 0.9, "P0", True), (8, 1, "K-2", "old two", 0.9, "P1", True),
        (10, 1, "K-3", "old three", 0.3, "P2", False),
    ]
    got = score(spark, reports, matches)
    path = {i: (r["priority"], r["scoring_path"]) for i, r in got.items()}
    assert path[1] == ("P0", "L1-keyword: complete outage")
    assert path[2] == ("P0", r"L1-keyword: \bblocked\b")
    assert path[3] == ("P0", "L1-duplicate: K-1")
    assert path[4][0] == "P0" and path[4][1].startswith("L2-template: P0 (score=0.")
    assert path[5] == ("P1", "L1-keyword: wrong results")
    assert path[6] == ("P1", "L1-soft: majority")
    assert path[7][0] == "P1" and path[7][1].startswith("L2-template: P1")  # one soft hit in a vague report is not enough
    assert path[8] == ("P1", "L1-duplicate: K-2")
    assert path[9] == ("P2", "L1-keyword: placeholder")
    assert path[10] == ("P2", "L3-similar-weighted: P2")
    assert path[11] == ("P3", "L1-vague")
    assert path[12] == ("P3", "L1-keyword: weird")
    assert path[13] == ("P0", "L4-impact-fallback") and path[14] == ("P2", "L4-impact-fallback")
    assert got[1]["severity"] == "Blocker" and got[1]["priority_id"] == "10000"
    assert "K-1" in got[3]["justification"] and all(r["justification"] for r in got.values())


def test_three_tiers(spark):
    df = spark.createDataFrame([("P0",), ("P3",), ("odd",), (None,)], "priority STRING")
    assert [r["priority"] for r in priority.priority_three_tier(df).collect()] == ["P0", "P2", "P2", "P2"]


MATCHES = "query_id BIGINT, rank INT, key STRING, component STRING, assignee STRING, similarity DOUBLE"


def test_owner_cascade(spark):
    rows = [
        (1, 1, "K1", "UI", "eng1", 0.9), (1, 2, "K2", "UI", "eng2", 0.8), (1, 3, "K3", "UI", "eng2", 0.7),
        (2, 1, "K1", "UI", "boss", 0.6), (2, 2, "K2", "UI", "boss2", 0.9),
        (3, 1, "K1", "DS", "eng1", 0.9),  # other component
        (4, 1, "K1", "UI", "stranger", 0.9),  # not on the roster
        (6, 1, "K1", "UI", "eng1", 0.9), (6, 2, "K2", "UI", "eng2", 0.8),  # tie: better rank
    ]
    m = spark.createDataFrame(rows, MATCHES)
    routed = spark.createDataFrame([(1, "UI"), (2, "UI"), (3, "UI"), (4, "UI"), (5, "DS"), (6, "UI")], "query_id BIGINT, component STRING")
    roster = spark.createDataFrame([("UI", "eng1"), ("UI", "eng2")], "component STRING, name STRING")
    managers = spark.createDataFrame([("boss",), ("boss2",)], "manager STRING")
    team = spark.createDataFrame([("UI", "boss")], "component STRING, manager STRING")
    got = {r["query_id"]: (r["suggested_owner"], r["method"]) for r in routing.owner_routed(routed, m, roster, managers, team).collect()}
    assert got[1] == ("eng2", "frequency-fallback") and got[2] == ("boss2", "manager-from-similar-bug")
    assert got[3] == ("boss", "manager-escalation") and got[4] == ("boss", "manager-escalation")
    assert got[5] == (None, "no-candidates") and got[6] == ("eng1", "frequency-fallback")


def test_owner_frequency_tie(spark):
    m = spark.createDataFrame([(1, 1, "K", "UI", "x", 0.9), (1, 2, "K", "UI", "y", 0.8), (1, 3, "K", "UI", None, 0.7)], MATCHES)
    q = spark.createDataFrame([(1,), (2,)], "query_id BIGINT")
    got = {r["query_id"]: (r["suggested_owner"], r["owner_reason"]) for r in routing.owner_frequency(m, q).collect()}
    assert got[1][0] == "x" and "had 1 of 2 similar" in got[1][1]
    assert got[2] == (None, "No similar issue names anyone.")


def test_roster(spark):
    rows = [("UI", "a")] * 3 + [("UI", "b")] * 2 + [("UI", "once"), ("UI", ""), ("UI", "boss"), ("UI", "boss")]
    issues = spark.createDataFrame(rows, "component STRING, assignee STRING")
    managers = spark.createDataFrame([("boss",)], "manager STRING")
    got = [(r["name"], r["bug_count"], r["place"]) for r in routing.roster_build(issues, managers).orderBy("place").collect()]
    assert got == [("a", 3, 1), ("b", 2, 2)]


def test_owner_options_order(spark):
    roster = spark.createDataFrame([("UI", "zoe"), ("DS", "Adam"), ("DS", "zoe"), ("UI", "boss")], "component STRING, name STRING")
    managers = spark.createDataFrame([("boss",)], "manager STRING")
    suggested = spark.createDataFrame([("zoe",), ("new",), (None,)], "suggested_owner STRING")
    got = [(r["name"], r["team"]) for r in routing.owner_options(roster, managers, suggested).collect()]
    assert got == [("boss", "Manager"), ("Adam", "DS"), ("new", "?"), ("zoe", "DS")]


def test_verdict_checks(spark):
    m = spark.createDataFrame([(i, 1, "K", 0.5) for i in range(1, 6)], "query_id BIGINT, rank INT, key STRING, similarity DOUBLE")
    v = spark.createDataFrame([(1, "K", "0.80"), (2, "K", "0.79"), (3, "X", "0.99"), (4, "K", "sure")], "query_id BIGINT, key STRING, confidence STRING")
    q = m.select("query_id")
    got = {r["query_id"]: (r["duplicate_of"], r["duplicate_confidence"], r["method"]) for r in dedup.decide_duplicates(m, q, v).collect()}
    assert got == {1: ("K", 0.8, "verdict"), 2: (None, 0.79, "verdict"), 3: (None, 0.99, "verdict"), 4: (None, 0.0, "verdict"), 5: ("K", 0.5, "rule")}
    flags = dedup.reflag(m, dedup.candidate_key_check(v, m)).filter("is_duplicate_candidate").collect()
    assert [r["query_id"] for r in flags] == [1]


def test_media_rules(spark):
    f = spark.createDataFrame(
        [("r", 1, "/a/x.png", "home", "no"), ("r", 2, "/b/x.png", "home", "again"), ("r", 3, "/a/x.png", "cart", None), ("r", 4, None, None, "odd")],
        "report_id STRING, seq INT, path STRING, screen STRING, contradiction STRING",
    )
    got = {(r["image"], r["screen"], r["message"][-2:]) for r in quality.gate_media_contradiction(f).collect()}
    assert got == {("x.png", "home", "no"), ("attachment", "", "dd")}
    media = spark.createDataFrame([(60.0, 3), (60.5, 3), (5.0, 0)], "duration_seconds DOUBLE, frame_count INT")
    assert [r["state"] for r in quality.reject_long_media(media).collect()] == ["accepted", "rejected", "error"]


def test_labels(spark):
    df = spark.createDataFrame([("Android, iOS", "BE_Core"), ("iOS", "bugs")], "p STRING, t STRING")
    loose = [r[0] for r in df.select(drafts.draft_labels(F.col("p"), F.col("t"))).collect()]
    strict = [r[0] for r in df.select(drafts.draft_labels(F.col("p"), F.col("t"), strict=True)).collect()]
    assert loose == [["triage", "be-core", "android", "ios"], ["triage", "ios"]] and strict == [["triage"], ["triage", "ios"]]


def test_logistic_regression_is_the_balanced_optimum(spark, sf):
    import numpy as np

    index = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label")
    model, classes = classify.train_component_lr(index, tol=1e-9)
    rows = index.collect()
    x = np.array([r["vec"] for r in rows], dtype=float)
    y = np.array([classes.index(r["label"]) for r in rows])
    w = len(y) / (len(classes) * np.bincount(y))
    logits = x @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gradient = ((p - np.eye(len(classes))[y]) * w[y][:, None]).T @ x + model.coefficientMatrix.toArray()
    assert np.abs(gradient).max() < 1e-3
