"""Merkle manifests against a plain recursive hash tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row):
    doc_id, text, lang, source, n_chars = row[:5]
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Root, and the sibling sides of every node on the way there."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
    root, above = climb([h(*r) for r in runs])
    return root, [
        [("".join(run[:k]), "".join(run[k + 1 :])), *above[j]] for j, run in enumerate(runs) for k in range(len(run))
    ]


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault("-" if r[2] is None else "=" + r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    tops, out = [], []
    for name in sorted(trees, key=str.encode):
        tops.append((name, *climb([x[2] for x in sorted(trees[name], key=lambda x: x[:3])])))
    root, above = climb([sub for _, sub, _ in tops]) if tops else (None, [])
    for (name, sub, sides), more in zip(tops, above, strict=True):
        for (_, _, own, r), proof in zip(sorted(trees[name], key=lambda x: x[:3]), sides, strict=True):
            out.append((r[0], own, sub, root, [*proof, *more]))
    return sorted(out, key=str)


def got(found):
    return sorted(
        ((r.row_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in found.collect()), key=str
    )


@pytest.mark.parametrize(
    "sizes",
    [
        {"en": 1},
        {None: 8},
        {"en": 9},
        {"en": 530, None: 65, "de": 1, "é": 8, "": 2},
        {f"l{k}": 1 + k % 3 for k in range(70)},
    ],
)
def test_proofs(spark, sizes):
    rng = random.Random(len(sizes))
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "é ü", "Some Text", "x" * rng.randrange(3000)])
            rows.append((rng.choice([None, *range(60)]), text, lang, rng.choice([None, "a"]), rng.choice([None, 3]), "t", 7))
    rng.shuffle(rows)
    want = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    small = F.translate("text", "ST", "st")
    manifest = merkle.build_manifest(docs, keep={"told": merkle.leaf_digest(text=small), "was": F.col("text")})
    found = merkle.verify(manifest, F.col("leaf"))
    assert got(found) == want
    assert all(r.verified and r.folded_root == manifest.root for r in found.collect())
    told = merkle.verify(manifest, F.col("told")).collect()
    assert all(r.verified == ("S" not in (r.was or "")) for r in told)
    digests = {h("".join(a + b for a, b in proof)) for *_, proof in want}
    assert {r[0] for r in found.select(merkle.proof_digest(F.col("proof"))).collect()} == digests


def test_large_levels_shuffle(spark, monkeypatch):
    """Without any broadcast the jumps give the same paths."""
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 0)
    rows = [(k, f"text {k}", "en" if k % 3 else "de", "a", 1, "t", 7) for k in range(700)]
    manifest = merkle.build_manifest(spark.createDataFrame(rows, SCHEMA))
    assert got(merkle.proofs(manifest)) == brute(rows)


def test_empty_table(spark):
    manifest = merkle.build_manifest(spark.createDataFrame([], SCHEMA))
    assert manifest.root is None and merkle.proofs(manifest).collect() == []
    assert merkle.verify(manifest, F.col("leaf")).collect() == []
