"""Searches through the trigram index against the scan, and how much they read."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import mining, textindex
from faultline.session import fresh_path
from faultline.sources import issues as src


def make(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, text STRING, gram STRING, n BIGINT")


def bytes_read(spark, run):
    """Input bytes of the executors' scans while ``run`` works."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        found = store.executorList(True)
        return sum(found.apply(k).totalInputBytes() for k in range(found.size()))

    before = total()
    result = run()
    return result, total() - before


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(400))), "g", 1) for k in range(3000)]
    for k in range(0, 3000, 250):
        rows[k] = (k, rows[k][1] + "\nThe needle-word stands HERE é\nx", "g", 1)
    rows += [(5000, None, "g", 1), (5001, "", "g", 1), (5002, "ab", "g", 1), (7, "needle twice", "g", 1), (None, "a needle without id", "g", 1)]
    path = fresh_path(spark, "trigrams")
    textindex.build_index(make(spark, rows), "text", path, rows_per_file=300)
    return path, rows


@pytest.mark.parametrize("query", ["needle", "NEEDLE-word", "here é", "abc", "ab", "zzz", "é", "abcdefghijabc", "here needle", "jj ab"])
def test_same_rows_as_the_scan(spark, indexed, query):
    path, rows = indexed
    docs = make(spark, [r for r in rows if r[0] is not None])
    words = query.split()
    want = sorted(r.id for r in src.text_search(docs, "text", query, "id", "id", 10_000).collect())
    some = textindex.find_texts(spark, path, words).where("id is not null")
    assert sorted(r.id for r in src.text_search(some, "text", query, "id", "id", 10_000).collect()) == want

    def grep(df):
        files = df.select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("path"), F.col("text").alias("content"))
        return sorted(map(str, mining.mine_grep(files, query, 10**6, 10**6).collect()))

    assert grep(textindex.find_texts(spark, path, [query]).where("id is not null")) == grep(docs)


def test_many_candidates_are_joined(spark, indexed, monkeypatch):
    monkeypatch.setattr(textindex, "LISTED", 3)
    found = textindex.find_texts(spark, indexed[0], ["needle"])
    assert sorted(r.id for r in found.where("contains(text, 'needle')").collect()) == sorted([7, *range(0, 3000, 250)])


def test_reads_little(spark, indexed):
    path = indexed[0]
    texts = spark.read.parquet(f"{path}/texts")
    _, whole = bytes_read(spark, lambda: texts.where(F.lower("text").contains("needle-word")).count())
    found, few = bytes_read(spark, lambda: textindex.find_texts(spark, path, ["needle-word"]).where(F.lower("text").contains("needle-word")).count())
    assert found == 12 and whole > 0
    plan = textindex.find_texts(spark, path, ["needle-word"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan or "PushedFilters" in plan
    _, nothing = bytes_read(spark, lambda: textindex.find_texts(spark, path, ["needlezzz"]).count())
    assert nothing < whole / 4


def test_empty_table(spark):
    path = fresh_path(spark, "trigrams")
    textindex.build_index(make(spark, []), "text", path)
    assert textindex.find_texts(spark, path, ["abc"]).collect() == []


def test_grams_of_any_letters(spark, monkeypatch):
    """Each trigram of a text once a row, of characters beyond 16 bits and nulls inside too."""
    monkeypatch.setattr(textindex, "SLICE_CHARS", 4)
    texts = ["abcabcABC", "a\x00\x00\x00b", "x😀y😀z", "é\néÉ\n", "ab", "", None, "𝒜bc" * 5]
    docs = spark.createDataFrame([(k, s) for k, s in enumerate(texts)], "id BIGINT, text STRING")
    got = sorted(map(tuple, textindex.grams_of(docs, "text").collect()))
    low = ["" if s is None else s.lower() for s in texts]
    assert got == sorted((k, g) for k, s in enumerate(low) for g in {s[i : i + 3] for i in range(len(s) - 2)})
