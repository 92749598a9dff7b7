"""Benchmark windows against brute force."""

import re

from faultline.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(low)


def brute(docs, items, size=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            iw = words(it)
            n = min(size, len(iw))
            for k in range(len(iw) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == iw[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "short item"),
    (3, "Ünïcode wörd"),
    (4, None),
    (5, "..."),
    (6, "a a a a a a a a a a a a"),
    (10, "short item"),
    (11, "x y z w"),
]
DOCS = [
    (1, "zero ONE two,three four five six seven eight nine ten! eleven twelve"),
    (2, "one two three four five six seven eight nine"),
    (3, "a short-item; and ünïcode wörd"),
    (4, None),
    (5, ""),
    (6, "a " * 40),
    (7, "x y z w " * 3 + "short"),
    (8, "item ÜNÏCODE wörd"),
    (8, "short item"),
    (9, "filler " * 50000 + "two three four five six seven eight nine ten eleven"),
]


def frames(spark, docs, items):
    return (
        spark.createDataFrame(
            [(d, t, "q") for d, t in docs], "doc_id long, text string, n_hit string"
        ),
        spark.createDataFrame(
            [(i, t, "q") for i, t in items], "item_id long, text string, words string"
        ),
    )


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in df.collect())


def test_against_brute_force(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    want = sorted(brute(DOCS, ITEMS))
    assert rows(decontaminate.find_windows(docs, items)) == want
    assert rows(decontaminate.find_windows(docs, items, block_windows=3)) == want
    spans = {r.doc_id: r.spans for r in decontaminate.find_windows(docs, items).collect()}
    assert [tuple(s) for s in spans[1]] == [(1, 13)]


def test_empty_tables(spark):
    docs, items = frames(spark, DOCS[:2], [])
    assert [r[2:] for r in rows(decontaminate.find_windows(docs, items))] == [(0, [])] * 2
    docs, items = frames(spark, [], ITEMS)
    assert rows(decontaminate.find_windows(docs, items)) == []


def test_filter_keeps_columns(spark):
    docs, items = frames(spark, DOCS[:9], ITEMS)
    docs = docs.withColumnRenamed("doc_id", "spans").select("n_hit", "text", "spans")
    found = decontaminate.without_windows(docs, items, "spans")
    assert found.columns == docs.columns
    clean = {d for d, _, hit, _ in brute(DOCS[:9], ITEMS) if not hit}
    assert {r.spans for r in found.collect()} == clean
    assert all(r.n_hit == "q" for r in found.collect())
