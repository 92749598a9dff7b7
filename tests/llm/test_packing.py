"""Packing against the library tokenizer, and the layout of sequences."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from faultline.llm import packing
from faultline.llm.queries import op1_packing


def ids_of(text):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*own.encode(text or "", add_special_tokens=False).ids, 1]


def check_layout(rows, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_doc.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == pieces[0].doc_tokens
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0, "every sequence needs no padding"
    return by_doc


def test_query_against_library_tokenizer(spark, sf):
    rows = op1_packing(spark, sf).collect()
    by_doc = check_layout(rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = ids_of(texts[doc])
        assert pieces[0].doc_tokens == len(ids)
        for r in pieces:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())


def test_odd_texts(spark):
    texts = [None, "", "a <|endoftext|> b", "x" * 30000, "  \n\n \t", "é🙂" * 900, "same", "same"]
    docs = spark.createDataFrame(
        [(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, length string"
    )
    by_doc = check_layout(packing.pack_documents(docs).collect())
    for k, text in enumerate(texts):
        got = b"".join(bytes(r.ids) for r in sorted(by_doc[k], key=lambda r: r.start))
        assert np.frombuffer(got, "<u4").tolist() == ids_of(text)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).collect() == []


def test_lowest_cost_with_room():
    plan = packing.plan_group([5, 4, 3, 2, 1, 1], 8, 1.0, 0.0)
    assert sorted(map(len, plan)) == [3, 3]
    assert all(sum(n for _, _, n in s) == 8 for s in plan)
    costs = [sum(n for _, _, n in s) for s in packing.plan_group([3, 3, 2], 8, 1.0, 1.0)]
    assert costs == [8]
