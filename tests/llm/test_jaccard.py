"""The blocked Jaccard join against all pairs."""

import random
import re

import pytest

from faultline.llm import jaccard
from faultline.llm.graph import components
from faultline.llm.queries import op7_jaccard


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def roots(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    overlap = {}
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b:
                    overlap[a, b] = overlap.get((a, b), 0) + 1
    edges = [
        (a, b)
        for (a, b), n in overlap.items()
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)
    ]
    root = roots(sets, edges)
    return sorted((i, len(sets[i]), root[i]) for i, _ in rows)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string"
    )


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_tables(spark, folder):
    path = f"/root/testdata/{folder}"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert got(op7_jaccard(spark, path)) == brute([(r.doc_id, r.text) for r in docs])


def test_odd_texts(spark):
    long = " ".join(f"w{k % 977}" for k in range(40000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, long)]
    rows += [(8, long + " w"), (9, "é " * 9), (10, "É " * 9), (11, "a b c d e f g h")]
    rows += [(12, "a b c d e f g h")] * 2
    assert got(jaccard.link_documents(frame(spark, rows))) == brute(rows)
    assert jaccard.link_documents(frame(spark, [])).collect() == []


def test_null_id(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f")]
    found = jaccard.link_documents(frame(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(None, None), (3, 3)}


def test_chains_and_hot_groups(spark):
    """Edited copies of edited copies, one large group, and passages shared by many."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([8, 60, 120]) if group else 120)]
        for _ in range(150 if not group else 12):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8]) * len(copy) // 100 + rng.choice([0, 1])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                base = copy
    for _ in range(80):
        rows.append((len(rows), passage + " " + " ".join(word() for _ in range(40))))
    rng.shuffle(rows)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 100
    assert got(jaccard.link_documents(frame(spark, rows))) == want
    assert got(jaccard.link_documents(frame(spark, rows), block_entries=200)) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 180)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = {k: v for k, v in roots(nodes, [e for e in edges if e[0] != e[1]]).items()}
    df = components(spark.createDataFrame(edges, "a long, b long"))
    rows = df.collect()
    assert len(rows) == len(nodes) and {r.node: r.component for r in rows} == want
