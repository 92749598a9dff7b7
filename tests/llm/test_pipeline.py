"""The stages of the corpus pipeline: what goes, what stays, and that nothing is lost."""

import numpy as np

import corpus_pipeline
from faultline.session import materialise
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_packing import check_layout, ids_of

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    found = {r.doc_id: r for r in after["language"]}
    assert all(r.text == before[k].text for k, r in found.items())
    gone = [before[k].text or "" for k in before.keys() - found.keys()]
    assert len(gone) < 0.03 * len(before)
    want = brute_lines([(k, r.text) for k, r in found.items()])
    want = {k: t for k, t, _, n in want if not n or t.strip()}
    found = {r.doc_id: r.text for r in after["lines"]}
    assert found == want
    groups = brute_groups(list(found.items()))
    want = {i: found[i] for i, _, root in groups if i == root}
    found = {r.doc_id: r.text for r in after["documents"]}
    assert found == want
    hits = brute_windows(list(found.items()), items)
    want = {i: found[i] for i, _, hit, _ in hits if not hit}
    found = {r.doc_id: r.text for r in after["benchmark"]}
    assert found == want and 0.5 * len(before) < len(found) < len(before)
    by_doc = check_layout(after["packing"])
    assert by_doc.keys() == found.keys()
    for k, pieces in by_doc.items():
        got = b"".join(bytes(r.ids) for r in sorted(pieces, key=lambda r: r.start))
        assert np.frombuffer(got, "<u4").tolist() == ids_of(found[k])


def test_odd_documents(spark):
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "12345 ...", "en", "a", 9),
        (4, "the cat and the dog are in the house", "en", "a", None),
        (4, "the cat and the dog are in the house", "en", "a", None),
        (5, "der hund und die katze sind im haus", "de", "b", 36),
        (6, "the end " * 9000, "en", "b", 72000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"odd-{name}")
    assert {r.doc_id for r in docs.collect()} == {4, 5, 6}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"empty-{name}")
    assert docs.collect() == []


def test_text_of_several_languages_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    parts = {}
    for r in docs.where("n_chars > 900").orderBy("doc_id").collect():
        if " | " not in r.text:
            parts.setdefault(r.lang, " ".join(r.text.split()[20:80]))
    assert len(parts) >= 3
    texts = [" ".join(parts[x] for x in ("en", "de", "es")), " ".join(parts.values())]
    rows = [(10**9 + k, t, "en", "a", len(t)) for k, t in enumerate(texts)]
    more = spark.createDataFrame(rows, docs.schema)
    found = corpus_pipeline.identify_language(spark, docs.unionByName(more), SF)
    assert {r.doc_id for r in found.where("doc_id >= 1000000000").collect()} == {10**9, 10**9 + 1}
