"""Reports to columns: one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.functions import extract as x
from faultline.functions import text as t
from faultline.functions.automaton import Automaton, phrases_of_texts
from faultline.session import materialise

_FIELDS = [
    "report_id", "title", "description", "steps_to_reproduce", "expected_result", "actual_result",
    "impact", "platform", "app_version", "component_hint", "reproducibility", "reporter_email",
    "reporter_name", "raw_text",
]
Rules = Sequence[tuple[str, Sequence[str]]]


def parse_reports(
    reports: DataFrame,
    module_rules: Rules = lx.MODULE_RULES,
    component_rules: Rules = lx.COMPONENT_RULES,
    product: str = "App",
    skip_greeting: bool = False,
) -> DataFrame:
    """``report_id, raw_text`` to one column per field of a report; other columns stay."""
    body, low = F.col("_text"), F.col("_low")
    staged = reports.withColumn("_text", t.strip(F.col("raw_text"))).withColumn("_low", F.lower("_text"))
    staged = staged.withColumns(
        {
            "reporter_email": x.reporter_email(body, low),
            "title": x.title(body, module_rules, product, low),
        }
    ).withColumn("_corpus", x.component_corpus(body, F.col("title"), low))
    return staged.select(
        "report_id",
        "title",
        x.description(body, skip_greeting).alias("description"),
        x.steps(body, low).alias("steps_to_reproduce"),
        x.labelled_field(body, ["Expected Result", "Expected"], low=low).alias("expected_result"),
        x.labelled_field(body, ["Actual Result", "Actual"], low=low).alias("actual_result"),
        x.labelled_field(body, ["Impact"], low=low).alias("impact"),
        x.platform(body, low).alias("platform"),
        x.version(body, low).alias("app_version"),
        x.component(body, F.col("title"), component_rules, corpus=F.col("_corpus")).alias("component_hint"),
        x.reproducibility(body, low).alias("reproducibility"),
        "reporter_email",
        x.reporter_name(body, F.col("reporter_email")).alias("reporter_name"),
        "raw_text",
        *[c for c in reports.columns if c not in _FIELDS],
    )


def lexicon_rules(lexicon: DataFrame, name: str, max_entries: int = 10_000) -> list[tuple[str, list[str]]]:
    """Ordered ``(label, phrases)`` rules of one list of a lexicon table.

    Lexicons are configuration. The size is checked before anything reaches
    the driver.
    """
    rows = (
        lexicon.filter(F.col("list") == name)
        .select("rank", "label", "pattern")
        .orderBy("rank", "pattern")
        .limit(max_entries + 1)
        .collect()
    )
    if len(rows) > max_entries:
        raise ValueError(f"lexicon {name!r} has more than {max_entries} entries")
    rules: dict[str, list[str]] = {}
    for row in rows:
        rules.setdefault(row["label"], []).append(row["pattern"])
    return list(rules.items())


def keyword_hits(
    corpus: DataFrame,
    signals: dict[str, Sequence[str]] | None = None,
    regex_tiers: set[str] | None = None,
) -> DataFrame:
    """``report_id, corpus`` to one array of hits per tier, in list order."""
    signals = lx.SIGNALS if signals is None else signals
    regex = lx.REGEX_TIERS if regex_tiers is None else regex_tiers
    return corpus.select(
        "report_id",
        *[t.hits(F.col("corpus"), p, tier in regex).alias(tier) for tier, p in signals.items()],
    )


def lexicon_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """``rank, label, pattern`` of rules given as a list."""
    entries = [(label, phrase) for label, phrases in rules for phrase in phrases]
    rows = [(k, *e) for k, e in enumerate(entries, 1)]
    return spark.createDataFrame(rows, "rank int, label string, pattern string")


def lexicon_matches(corpus: DataFrame, lexicon: DataFrame, shard_bytes: int = 4 << 20) -> DataFrame:
    """``corpus`` (a text column of that name and others) to one row per text and phrase inside it.

    Adds ``pattern``, once for a text however often it occurs. Null texts and empty or null
    patterns match nothing; repeated rows of the corpus match each on their own. An automaton
    over all phrases walks each text once, so the work does not grow with the number of
    phrases. The lexicon may have any size: it is dealt by a hash into shards of about
    ``shard_bytes`` of phrases, of which the driver and a task hold one at a time, and the
    corpus is read once for each shard.
    """
    spark = corpus.sparkSession
    phrases = lexicon.where("pattern <> ''").select("pattern").distinct()
    size = phrases.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    if shards > 1:
        phrases = materialise(phrases, "phrases")
    names, out = corpus.columns, None
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema]
    for k in range(shards):
        own = phrases.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == k) if shards > 1 else phrases
        rows = sorted(r["pattern"] for r in own.toLocalIterator())
        shipped = spark.sparkContext.broadcast(rows)
        found = corpus.mapInArrow(_phrase_finder(shipped), ", ".join([*fields, "_patterns array<string>"]))
        found = found.select(*names, F.explode_outer("_patterns").alias("pattern")).where("pattern is not null")
        out = found if out is None else out.unionByName(found)
    return out


def _phrase_finder(shipped):
    built = []

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:  # once for a task
            built.append(Automaton([p.encode() for p in shipped.value]))
            built.append(pa.array(shipped.value, pa.string()))
        for batch in batches:
            numbers = phrases_of_texts(built[0], batch.column("corpus"))
            patterns = pa.ListArray.from_arrays(numbers.offsets, built[1].take(numbers.values))
            yield pa.RecordBatch.from_arrays([*batch.columns, patterns], [*batch.schema.names, "_patterns"])

    return find


def lexicon_join(corpus: DataFrame, lexicon: DataFrame | Rules) -> DataFrame:
    """One row per report and matching lexicon entry: ``report_id, rank, label, pattern``.

    ``lexicon`` is a table ``rank, label, pattern`` of any size or a list of rules. A pattern
    with several entries gives a row for each.
    """
    if not isinstance(lexicon, DataFrame):
        lexicon = lexicon_table(corpus.sparkSession, lexicon)
    found = lexicon_matches(corpus.select("report_id", "corpus"), lexicon)
    # the planner broadcasts the entries by their size, or deals both sides out by phrase
    entries = lexicon.select("rank", "label", "pattern")
    return found.join(entries, "pattern").select("report_id", "rank", "label", "pattern")


def route_components(corpus: DataFrame, lexicon: DataFrame, default: str = lx.CATCH_ALL) -> DataFrame:
    """``report_id, component_hint``: the label of the first rule with a phrase in the text.

    The lowest rank decides, of equal ranks the first label; reports with no phrase get
    ``default``. ``report_id`` must be unique. Ranks are reduced before they are shuffled, so a
    phrase in every report costs one row each.
    """
    entries = lexicon.where("pattern <> ''").groupBy("pattern").agg(F.min(F.struct("rank", "label")).alias("entry"))
    found = lexicon_matches(corpus.select("report_id", "corpus"), lexicon).join(entries, "pattern")
    first = found.groupBy("report_id").agg(F.min("entry")["label"].alias("component_hint"))
    return corpus.select("report_id").join(first, "report_id", "left").select(
        "report_id", F.coalesce("component_hint", F.lit(default)).alias("component_hint")
    )


def with_components(parsed: DataFrame, lexicon: DataFrame, default: str = lx.CATCH_ALL) -> DataFrame:
    """Parsed reports with ``component_hint`` from a lexicon table instead of the built-in rules."""
    corpus = F.lower(F.concat_ws(" ", t.strip(F.col("raw_text")), F.col("title"))).alias("corpus")
    found = route_components(parsed.select("report_id", corpus), lexicon, default)
    return parsed.drop("component_hint").join(found, "report_id").select(*parsed.columns)


def scoring_corpus() -> Column:
    """Text the priority signals look at, from the columns of parse_reports."""
    parts = ["title", "description", "impact", "actual_result", "raw_text"]
    return F.lower(F.concat_ws(" ", *[t.blank_to_null(F.col(p)) for p in parts]))
