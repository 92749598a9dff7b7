"""Counts through the cache against the tokenizer libraries."""

import random
import uuid

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from faultline.llm import tokens
from faultline.session import fresh_path

SCHEMA = "doc_id long, text string, digest string, n_tokens string, _id long"


def cache(spark):
    name = f"t_{uuid.uuid4().hex}"
    tokens.open_cache(spark, name, fresh_path(spark, "cache"), buckets=4)
    return name


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", "n", 1) for i, t in rows], SCHEMA)


def odd_rows():
    rng = random.Random(3)
    parts = ["The", "don't", "12345", "é", "é", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "  ", "\n"]
    parts += ["\t\x0b\x0c\r", " ", "̈", " ", "\x85", "\x00", "\x1c", "日本語", "🙂", "!!!", "it's", "", "naïve", "İ"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randrange(30)))) for k in range(200)]
    rows += [(k + 1000, t) for k, t in rows[:40]] + [(5, rows[5][1]), (5, rows[5][1]), (None, "a b"), (None, "a b"), (None, None)]
    return [*rows, (7000, None), (7001, ""), (7002, " \n"), (7003, "word " * 30000)]


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in df.collect()), key=str)


def test_counts_of_the_library(spark):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, name = odd_rows(), cache(spark)
    want = [(i, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    first = tokens.count_tokens(frame(spark, rows), name)
    assert got(first) == sorted(want, key=str) and not first.where("cached").take(1)
    stored = spark.table(name).count()
    assert stored == spark.table(name).select("digest").distinct().count() < len(rows)
    again = tokens.count_tokens(frame(spark, [*rows, (9, "a new text")]), name)
    assert [r.doc_id for r in again.where("not cached").collect()] == [9]
    assert got(again.where("cached")) == sorted(want, key=str) and spark.table(name).count() == stored + 1
    # another white space, the same count: found without encoding
    spaced = tokens.count_tokens(frame(spark, [(1, "a\t\n new   text")]), name).collect()
    assert spaced[0].cached and spaced[0].n_bytes == 14


def test_versions_do_not_mix(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, name = sentencepiece.SentencePieceProcessor(model_file=path), cache(spark)
    rows = [(k, t) for k, t in odd_rows() if "\x00" not in (t or "")]
    tokens.count_tokens(frame(spark, rows[:50]), name).collect()
    want = [(i, len((t or "").encode()), len(own.encode(t or ""))) for i, t in rows]
    assert got(tokens.count_tokens(frame(spark, rows), name, path)) == sorted(want, key=str)
    versions = [r.n for r in spark.sql(f"SELECT count(*) AS n FROM {name} GROUP BY tokenizer").collect()]
    assert len(versions) == 2


def test_empty_table(spark):
    name = cache(spark)
    assert tokens.count_tokens(frame(spark, []), name).collect() == []
    assert spark.table(name).count() == 0
