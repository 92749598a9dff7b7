"""TF-IDF tables: counts, vocabulary, weights, vectors and text retrieval."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.functions import text as t
from faultline.operators.postings import build_index, topk_index
from faultline.session import complete_folders, materialise

#: Groups that terms are counted in before they are counted one by one; at most so many numbers are broadcast.
TERM_BUCKETS = 1 << 20


def _terms(docs: DataFrame, stop_words: Sequence[str], bigrams: bool = True) -> DataFrame:
    """One row per term occurrence.

    The texts are shuffled by document once; all later grouping by document
    reuses that partitioning instead of shuffling the far larger term rows.
    """
    words = F.col("words")
    if "words" in docs.columns:
        # words have no blanks; as one text they are half as large on the way
        split = docs.select("doc_id", F.array_join("words", " ").alias("text")).repartition("doc_id")
        split = split.select("doc_id", F.when(F.col("text") != "", F.split("text", " ")).alias("words"))
    else:
        split = docs.select("doc_id", "text").repartition("doc_id")
        split = split.select("doc_id", t.words(F.col("text"), stop_words).alias("words"))
    # outer: for an inner explode Spark infers a filter on the list and computes it twice
    terms = F.explode_outer(t.with_bigrams(words) if bigrams else words).alias("term")
    return split.select("doc_id", terms).where("term is not null")


def tokenised(docs: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """``doc_id, words``, written once for the passes that count and weigh them."""
    words = t.words(F.col("text"), stop_words).alias("words")
    # dealt out first: a table of one file would be split into words by one task
    return materialise(docs.select("doc_id", "text").repartition("doc_id").select("doc_id", words), "words")


def term_counts(
    docs: DataFrame, stop_words: Sequence[str] = lx.STOP_WORDS, bigrams: bool = True, most: int | None = None
) -> DataFrame:
    """``doc_id, text`` to ``doc_id, term, tf``.

    With ``most`` terms that can't be among the ``most`` frequent of the corpus may be left out, see
    :func:`_frequent_buckets`; all counts of the others are there.
    """
    if most is None:
        return _terms(docs, stop_words, bigrams).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    if "words" not in docs.columns:
        docs = tokenised(docs, stop_words)
    terms = _terms(docs, stop_words, bigrams)
    buckets = _frequent_buckets(docs, most, bigrams)
    if buckets is not None:
        terms = terms.withColumn("bucket", _bucket()).join(F.broadcast(buckets), "bucket", "left_semi")
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int")


def _frequent_buckets(docs: DataFrame, most: int, bigrams: bool) -> DataFrame | None:
    """Buckets of terms that hold every term that can be among the ``most`` frequent; None: all.

    ``docs(doc_id, words)`` should be a written table; it is read twice. At least ``most`` terms are as
    frequent as the word of that place among the words alone, and the occurrences of a bucket are
    no fewer than those of any term in it. So a term in a bucket with fewer than that word has
    is out; ties stay. What is counted by term is words, by bucket a fixed number of rows for a task.
    """
    words = docs.select(F.explode_outer("words").alias("term")).where("term is not null")
    leading = words.groupBy("term").agg(F.count("*").alias("n")).select("n").orderBy(F.desc("n")).limit(most)
    found, least = leading.agg(F.count("*"), F.min("n")).first()
    if found < most:
        return None
    if bigrams:
        words = docs.select(F.explode_outer(t.with_bigrams(F.col("words"))).alias("term")).where("term is not null")
    counts = words.groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("n"))
    return materialise(counts.where(F.col("n") >= least).select("bucket"), "buckets")


def known_counts(docs: DataFrame, vocab: DataFrame, stop_words: Sequence[str] = lx.STOP_WORDS) -> DataFrame:
    """Counts of vocabulary terms only: ``doc_id, term_id, idf, tf``.

    Other terms, most of all rare pairs of words, drop out before anything is
    grouped. The vocabulary has a fixed bound, so it may be broadcast.
    """
    return (
        _terms(docs, stop_words)
        .join(F.broadcast(vocab.select("term", "term_id", "idf")), "term")
        .groupBy("doc_id", "term_id", "idf")
        .agg(F.count("*").alias("tf"))
    )


def vocab_limit(counts: DataFrame, max_features: int) -> DataFrame:
    """The most frequent terms of the corpus, ties by term: ``term, corpus_tf, df``."""
    return (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("corpus_tf"), F.count("*").alias("df"))
        .orderBy(F.desc("corpus_tf"), "term")
        .limit(max_features)
    )


def vocabulary(counts: DataFrame, docs: DataFrame, max_features: int = lx.TFIDF_MAX_FEATURES) -> DataFrame:
    """``term, term_id, df, idf``; never more than ``max_features`` rows, so the
    numbering window and later broadcasts have a fixed bound."""
    n_docs = docs.select(F.count("*")).scalar()
    return vocab_limit(counts, max_features).select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"),
        "df",
        (F.log((n_docs + 1) / (F.col("df") + 1)) + 1).alias("idf"),
    )


def _raw_weight() -> Column:
    return (1 + F.log("tf")) * F.col("idf")


def weights(docs: DataFrame, vocab: DataFrame, stop_words: Sequence[str] = lx.STOP_WORDS) -> DataFrame:
    """``doc_id, term, term_id, weight`` with rows of unit length per document."""
    raw = known_counts(docs, vocab, stop_words).select("doc_id", "term_id", _raw_weight().alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    scaled = raw.withColumn("weight", F.col("raw") / length).drop("raw")
    return scaled.join(F.broadcast(vocab.select("term_id", "term")), "term_id")


def tfidf_fit(
    docs: DataFrame,
    stop_words: Sequence[str] = lx.STOP_WORDS,
    max_features: int = lx.TFIDF_MAX_FEATURES,
) -> tuple[DataFrame, DataFrame]:
    """Long-form weights and the vocabulary of a corpus."""
    docs = tokenised(docs, stop_words)
    vocab = materialise(vocabulary(term_counts(docs, stop_words, most=max_features), docs, max_features), "vocab")
    return weights(docs, vocab, stop_words), vocab


def vectors(docs: DataFrame, vocab: DataFrame, stop_words: Sequence[str] = lx.STOP_WORDS) -> DataFrame:
    """``doc_id, idx, w``: one unit vector per document with known terms.

    Entries are in order of term and summed in that order, so equal texts have
    equal vectors to the last bit.
    """
    entry = F.struct("term_id", _raw_weight().alias("raw"))
    packed = known_counts(docs, vocab, stop_words).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(entry)).alias("e")
    )
    square = F.aggregate("e", F.lit(0.0), lambda acc, e: acc + e["raw"] * e["raw"])
    scaled = t.let(F.sqrt(square), lambda n: F.transform("e", lambda e: e["raw"] / n))
    return packed.select("doc_id", F.col("e.term_id").alias("idx"), scaled.alias("w"))


@dataclass
class TextIndex:
    """Vocabulary and inverted index of a corpus, and the attributes of its documents."""

    vocab: DataFrame
    postings: DataFrame
    facts: DataFrame | None = None


def build_text_index(
    docs: DataFrame,
    stop_words: Sequence[str] = lx.STOP_WORDS,
    max_features: int = lx.TFIDF_MAX_FEATURES,
    path: str | None = None,
) -> TextIndex:
    """The index of ``docs(doc_id, text)``, for this job or as the next version below ``path``.

    Other columns are kept as facts of the documents under ``key``. A version is complete
    when its last part, the inverted index, is; older ones are left as they are, so a reader
    keeps what it has loaded.
    """
    spark = docs.sparkSession
    words = tokenised(docs.select("doc_id", "text"), stop_words)
    vocab = vocabulary(term_counts(words, stop_words, most=max_features), words, max_features)
    facts = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select(F.col("doc_id").alias("key"), *facts)
    if path is None:
        vocab = materialise(vocab, "vocab")
        corpus = vectors(words, vocab, stop_words).withColumnRenamed("doc_id", "key")
        return TextIndex(vocab, build_index(corpus), own if facts else None)
    folder = f"{path}/version={max([-1, *complete_folders(spark, path, 'version=', 'postings/_SUCCESS')]) + 1}"
    vocab.write.mode("overwrite").parquet(f"{folder}/vocab")
    vocab = spark.read.parquet(f"{folder}/vocab")
    own.write.mode("overwrite").parquet(f"{folder}/facts")
    corpus = vectors(words, vocab, stop_words).withColumnRenamed("doc_id", "key")
    build_index(corpus, path=f"{folder}/postings")
    return load_text_index(spark, path)


def load_text_index(spark: SparkSession, path: str, version: int | None = None) -> TextIndex:
    """A version of the index, by default the newest complete one."""
    if version is None:
        found = complete_folders(spark, path, "version=", "postings/_SUCCESS")
        if not found:
            raise ValueError(f"no complete index below {path}")
        version = found[-1]
    parts = [spark.read.parquet(f"{path}/version={version}/{name}") for name in ("vocab", "postings", "facts")]
    return TextIndex(*parts)


def search_text_index(
    queries: DataFrame,
    index: TextIndex,
    k: int = lx.TFIDF_TOP_K,
    similar: float = lx.TFIDF_SIMILAR,
    duplicate: float = lx.TFIDF_DUPLICATE,
    stop_words: Sequence[str] = lx.STOP_WORDS,
    exclude_self: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Matches and decisions of ``queries(query_id, text)``, see :func:`tfidf_matches`."""
    asked = vectors(queries.select(F.col("query_id").alias("doc_id"), "text"), index.vocab, stop_words)
    asked = asked.withColumnRenamed("doc_id", "query_id")
    ranked = materialise(topk_index(asked, index.postings, k, exclude_self=exclude_self), "ranked")
    matches = ranked.filter(F.col("similarity") >= similar).withColumn(
        "is_duplicate_candidate", F.col("similarity") >= duplicate
    )
    top = ranked.filter(F.col("rank") == 1)
    decision = queries.select("query_id").join(top, "query_id", "left").select(
        "query_id",
        F.when((F.col("similarity") >= duplicate) & (F.col("similarity") >= similar), F.col("key")).alias("duplicate_of"),
        F.coalesce(F.round("similarity", 3), F.lit(0.0)).alias("duplicate_confidence"),
    )
    return matches, decision


def tfidf_matches(
    queries: DataFrame,
    docs: DataFrame,
    k: int = lx.TFIDF_TOP_K,
    similar: float = lx.TFIDF_SIMILAR,
    duplicate: float = lx.TFIDF_DUPLICATE,
    stop_words: Sequence[str] = lx.STOP_WORDS,
    max_features: int = lx.TFIDF_MAX_FEATURES,
    exclude_self: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Text retrieval over a whole table of queries.

    ``queries(query_id, text)``, ``docs(doc_id, text)``. Returns the matches at
    or above ``similar`` and one summary row per query with the duplicate
    decision; its confidence is the best score even below ``similar``.
    """
    index = build_text_index(docs.select("doc_id", "text"), stop_words, max_features)
    return search_text_index(queries, index, k, similar, duplicate, stop_words, exclude_self)
