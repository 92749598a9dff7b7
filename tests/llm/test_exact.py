"""The digest index against brute force, in one batch and in two."""

import re

from faultline.llm import exact
from faultline.session import fresh_path

TEXTS = [
    (1, "a b"),
    (2, "ab"),
    (3, "a  b"),
    (4, "a\tb\n"),
    (5, None),
    (6, " \r\n"),
    (7, "Ab"),
    (8, "a b"),
    (9, "x" * 100000),
    (9, "x" * 100000),
    (None, "ab"),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "z") for i, t in rows], "doc_id long, text string, digest string"
    )


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((i, t))
    out = []
    for members in groups.values():
        keep = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep) for i, _ in members]
    return sorted(map(str, out))


def decided(df):
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in df.collect())


def test_one_batch(spark):
    exact.open_index(spark, "index_one", fresh_path(spark, "index"), buckets=4)
    assert decided(exact.append_new(frame(spark, TEXTS), "index_one")) == brute(TEXTS)


def test_index_outlives_the_batch(spark):
    path = fresh_path(spark, "index")
    exact.open_index(spark, "index_two", path, buckets=4)
    exact.append_new(frame(spark, TEXTS[:3]), "index_two").collect()
    spark.sql("DROP TABLE index_two")
    exact.open_index(spark, "index_again", path, buckets=4)
    rows = exact.append_new(frame(spark, [(20, "a   b    "), (21, "new")]), "index_again")
    assert decided(rows) == sorted(map(str, [(20, 3, 1, False), (21, 21, 1, True)]))
    assert spark.table("index_again").count() == 2


def test_empty_table(spark):
    exact.open_index(spark, "index_empty", fresh_path(spark, "index"), buckets=4)
    assert exact.append_new(frame(spark, []), "index_empty").collect() == []
