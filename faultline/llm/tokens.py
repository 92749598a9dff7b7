"""Token counts through a cache of digests: a text is encoded once per tokenizer version."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import materialise

CACHE_SCHEMA = "digest BINARY, tokenizer BINARY, n_tokens BIGINT"
#: Steps of a vocabulary file.
FOLD = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
CUT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
PIECES = 1 << 19  # counts of pieces that a task remembers before it starts anew
LETTERS = 1 << 20  # of texts whose new pieces are encoded at once
#: Raised when the normal form or the way of counting changes; part of the version.
REVISION = b"1"

_tokenizers: dict[str, object] = {}


def vocabulary_path() -> str:
    """File of the 49k vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer_version(path: str) -> bytes:
    """Digest of what decides a count: the vocabulary file, its library and the normal form."""
    import sentencepiece
    import tokenizers

    library = sentencepiece if path.endswith(".model") else tokenizers
    sha = hashlib.sha256(f"{library.__name__} {library.__version__} ".encode() + REVISION + b"\0")
    with open(path, "rb") as file:
        sha.update(file.read())
    return sha.digest()


def _steps(path: str) -> tuple[list, list]:
    """The vocabulary's steps before the words and those that cut them."""
    if path.endswith(".model"):
        return [], []
    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    before, cut = own.get("normalizer") or {}, own.get("pre_tokenizer") or {}
    return before.get("normalizers", [before]), cut.get("pretokenizers", [cut])


def folds_space(path: str) -> bool:
    """True if the vocabulary's own steps make one space of a run of white space."""
    return FOLD in _steps(path)[0]


def cuts_at_space(path: str) -> bool:
    """True if no token reaches across a space, so a text has the tokens of its pieces.

    So it is where white space is folded, the other steps look at single characters or at
    what combines with a letter, and the words are the matches of a pattern without spaces.
    """
    before, cut = _steps(path)
    plain = all(s == FOLD or s.get("type") in ("NFC", "Lowercase") for s in before)
    return plain and FOLD in before and cut[:1] == [CUT]


def normal_form(text: Column, fold: bool) -> Column:
    """A text of the same count; null is empty.

    Runs of ASCII white space become one space where the tokenizer does the same before
    anything else. Case stays: a special string is only special as it is written.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.regexp_replace(whole, "[\\x20\\x09-\\x0D]+", " ") if fold else whole


def open_cache(spark: SparkSession, table: str, path: str, buckets: int = 64) -> None:
    """Registers the cache at ``path``, bucketed and sorted by digest; keeps what is there."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({CACHE_SCHEMA}) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )


def counter(path: str):
    """Function from a list of texts to their numbers of tokens, as the library counts them."""
    if path not in _tokenizers:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _tokenizers[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its core
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()

            def count(texts: list[str]) -> list[int]:
                return [len(x.ids) for x in own.encode_batch_fast(texts, add_special_tokens=False)]

            _tokenizers[path] = _by_pieces(count) if cuts_at_space(path) else count
    return _tokenizers[path]


def _by_pieces(count):
    """``count`` for folded texts, with each piece between spaces encoded once."""
    known: dict[str, int] = {}

    def total(texts: list[str]) -> list[int]:
        if len(known) > PIECES:
            known.clear()
        pieces = [text.split(" ") for text in texts]
        new = list(set().union(*pieces) - known.keys())
        known.update(zip(new, count(new), strict=True))
        return [sum(map(known.__getitem__, own)) for own in pieces]

    return total


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """``digest, body`` to ``digest, n_tokens``; rows of one digest in a row are encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = counter(path), None
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            fresh = [k for k, x in enumerate(digests) if x != (digests[k - 1] if k else last)]
            last = digests[-1] if digests else last
            body = batch.column("body")
            totals, texts, held = [], [], 0
            for k in fresh:  # some texts at a time as strings
                texts.append(body[k].as_py())
                held += len(texts[-1])
                if held > LETTERS:
                    totals += count(texts)
                    texts, held = [], 0
            totals += count(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[k] for k in fresh], pa.binary()), pa.array(totals, pa.int64())],
                ["digest", "n_tokens"],
            )

    return texts.select("digest", "body").mapInArrow(encode, "digest binary, n_tokens long")


def count_tokens(
    docs: DataFrame,
    table: str,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes (UTF-8), n_tokens, digest and cached.

    ``table`` is a cache made by :func:`open_cache`; ``path`` a vocabulary file (.json or
    .model). Digests of the normal forms are joined to the counts stored for this version
    of the tokenizer. Of the digests it lacks, one text each is encoded and the counts are
    appended; ``cached`` says whether the count was there before. Null texts count as empty. Rows with
    equal or null ids are counted each. Extra columns are not looked at, an empty table
    gives no rows and appends nothing.

    A text to encode is found by digest and smallest id, so a group of copies is one row
    of the misses and its texts are spread by id, however many they are. Texts are
    shuffled only if something is missing. The last join is by digest with one row each
    on the cache's side; a hot group is split by the adaptive planner. Appending
    is not atomic against a second writer: two at a time may store a count twice, which
    is why the cache is read through a grouping.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    version, fold = tokenizer_version(path), folds_space(path)
    body = normal_form(F.col(text_col), fold)
    keys = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
    )
    keys = materialise(keys, "token-keys")
    stored = known_counts(spark, table, version)
    texts = keys.groupBy("digest").agg(F.min("_id").alias("_id"))
    missing = materialise(
        texts.hint("merge").join(stored.select("digest"), "digest", "left_anti"), "token-misses"
    )
    if missing.take(1):
        full = docs.select(F.col(id_col).alias("_own"), body.alias("body"))
        full = full.withColumn("digest", F.unhex(F.sha2("body", 256)))
        same = F.col("_own").eqNullSafe(F.col("_id")) & (full["digest"] == missing["digest"])
        wanted = full.join(missing, same, "left_semi")
        fresh = encode_misses(wanted, path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        fresh = materialise(fresh, "token-counts")
        fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.insertInto(table)
    spark.catalog.refreshTable(table)
    counts = known_counts(spark, table, version)
    new = missing.select("digest", F.lit(False).alias("cached"))
    counts = materialise(counts.join(new, "digest", "left"), "token-known")
    return keys.join(counts, "digest").select(
        F.col("_id").alias(id_col),
        "n_bytes",
        "n_tokens",
        "digest",
        F.coalesce("cached", F.lit(True)).alias("cached"),
    )


def known_counts(spark: SparkSession, table: str, version: bytes) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer version, each digest once."""
    rows = spark.table(table).where(F.col("tokenizer") == F.lit(version))
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
