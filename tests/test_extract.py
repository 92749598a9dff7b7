"""Extraction on authored reports."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.functions import automaton
from faultline.functions import extract as x
from faultline.functions import text as t
from faultline.operators.extraction import (
    keyword_hits,
    lexicon_join,
    lexicon_matches,
    lexicon_rules,
    lexicon_table,
    parse_reports,
    route_components,
    with_components,
)
from faultline.operators.priority import is_vague
from faultline.operators.quality import gate_field_consistency, gate_vague_report
from faultline.sources.reports import form_reports

FULL = """From: "Ada North" <ada.north@mail.example.com>
To: intake@mail.example.com
Subject: Re: [URGENT] checkout stuck after coupon

The checkout page **never** finishes. It spins forever! Reloading does not help? A fourth sentence is cut.

Steps to Reproduce:
1. Open the shop
2) Add a coupon
   that wraps over
- Press pay

Expected: the order is placed
within a second

**Actual Result:** spinner never ends

Impact: all users

Reproducibility: always
Platform: Android, iOS
App Version: v3.14.1
"""


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t STRING").select(column(t.strip(F.col("t"))).alias("v")).first()["v"]


def test_full_report(spark):
    row = parse_reports(spark.createDataFrame([("r", FULL)], "report_id STRING, raw_text STRING")).first()
    assert row["title"] == "[Checkout]: checkout stuck after coupon"
    assert row["reporter_email"] == "ada.north@mail.example.com"
    assert row["reporter_name"] == "Ada North"
    assert row["description"] == "The checkout page never finishes. It spins forever! Reloading does not help?"
    assert row["steps_to_reproduce"] == ["Open the shop", "Add a coupon", "Press pay"]
    assert row["expected_result"] == "the order is placed\nwithin a second"
    assert row["actual_result"] == "spinner never ends"
    assert row["impact"] == "all users"
    assert row["platform"] == "Android, iOS, Web"
    assert row["app_version"] == "3.14.1"
    assert row["reproducibility"] == "100%"
    assert row["component_hint"] == "Backend"


def test_empty_and_headers_only(spark):
    rows = spark.createDataFrame([("a", ""), ("b", "From: x@y.example\nTo: z")], "report_id STRING, raw_text STRING")
    a, b = parse_reports(rows).orderBy("report_id").collect()
    assert a["title"] == "[App]: Bug report" and a["steps_to_reproduce"] == []
    assert a["description"] == "See full bug report for details."
    assert a["platform"] == "Unknown" and a["reproducibility"] == "unknown" and a["component_hint"] == "bugs"
    assert b["reporter_email"] == "x@y.example" and b["reporter_name"] == "X"


def test_title_forms(spark):
    title = lambda text: one(spark, text, x.title)
    assert title("Subject: [Known]: thing") == "[Known]: thing"
    assert title("subject: FWD: login broken") == "[Auth]: login broken"
    assert title("To: a\n  plain first line  ") == "[Chat/AI]: plain first line"
    assert len(title("To: a\n" + "z" * 200)) == len("[App]: ") + 80


def test_names(spark):
    name = lambda text: one(spark, text, x.reporter_name)
    assert name("From: Prince") == "Prince"
    assert name("hello\nRegards,\nJane Roe") == "Jane Roe"
    assert name("hello\n- Jane Roe") == "Jane Roe"
    assert name("From: jane_van.roe@mail.example.com") == "Jane Van Roe"
    assert name("nothing here") is None


def test_platform_and_version(spark):
    platform = lambda text: one(spark, text, x.platform)
    assert platform("Platform: web only") == "Web"
    assert platform("Platform: android and ios") == "Android, iOS, Web"
    assert platform("seen on iOS and the web") == "iOS, Web"
    assert platform("curious website") == "Unknown"
    version = lambda text: one(spark, text, x.version)
    assert version("Version: 2.1") == "2.1"
    assert version("build v1.2.3 here") == "1.2.3"
    assert version("on version 4.5 now") == "4.5"
    assert version("none") is None


def test_steps_fallback_and_last_section(spark):
    steps = lambda text: one(spark, text, x.steps)
    assert steps("how: steps to repro are\n1. one\n2. two\n\n3. three") == ["one", "two"]
    assert steps("Steps:\n- a\n\n- b") == ["a"] or steps("Steps:\n- a\n\n- b") == ["a", "b"]
    assert steps("no such thing") == []
    actual = lambda text: one(spark, text, lambda c: x.labelled_field(c, ["Actual Result", "Actual"]))
    assert actual("x\nActual: it breaks") == "it breaks"
    assert actual("x\nActual:\n\nEnvironment: y") in ("Not provided.", "Environment: y")


def test_reproducibility(spark):
    repro = lambda text: one(spark, text, x.reproducibility)
    assert repro("Reproducibility: ~40%") == "~40%"
    assert repro("Reproducibility: ~33.5%") == "unknown"
    assert repro("Reproducibility: not always") == "100%"
    assert repro("Reproducibility: conditional on login") == "conditional"
    assert repro("it is intermittent") == "intermittent"


def test_description_cut(spark):
    body = "From: a\n\n" + ("word " * 120).strip() + ".\n\nsecond paragraph"
    text = one(spark, body, x.description)
    assert len(text) == 453 and text.endswith("...")
    greeting = "From: a\n\nHi team,\n\nReal text."
    assert one(spark, greeting, x.description) == "Hi team,"


def test_vague_boundaries(spark):
    rows = [(349, "x" * 349, []), (350, "x" * 350, []), (1, "x", ["s"])]
    df = spark.createDataFrame(rows, "n INT, raw STRING, steps ARRAY<STRING>")
    got = {r["n"]: r["v"] for r in df.select("n", is_vague(F.col("raw"), F.col("steps")).alias("v")).collect()}
    assert got == {349: True, 350: False, 1: False}


def test_gate_vague_counts(spark):
    sections = "Steps to Reproduce expected: actual: impact: reproducibility: "
    rows = [
        ("one", sections + "y" * 300, ["s"]),  # only the environment is missing
        ("two", sections + "y" * 300, []),  # and no steps could be read
        ("form", "x", []),
    ]
    df = spark.createDataFrame(rows, "report_id STRING, raw_text STRING, steps_to_reproduce ARRAY<STRING>")
    df = df.withColumn("from_form", F.col("report_id") == "form")
    found = {r["report_id"]: r["message"] for r in gate_vague_report(df).collect()}
    assert set(found) == {"two"}
    assert "section 'Environment' is missing; steps are announced" in found["two"]


def test_gate_consistency(spark):
    title = "alpha bravo charlie delta echo foxtrot"
    rows = [
        ("apart", title, "golf hotel india juliet kilo lima", ["mike"]),
        ("shared", title, "golf hotel india juliet kilo alpha", []),
        ("steps", title, "golf hotel india juliet kilo lima", ["then bravo"]),
        ("short", "alpha bravo", "golf hotel india juliet kilo lima", []),
    ]
    df = spark.createDataFrame(rows, "report_id STRING, title STRING, description STRING, steps_to_reproduce ARRAY<STRING>")
    assert [r["report_id"] for r in gate_field_consistency(df).collect()] == ["apart"]


def test_keyword_hits_keep_order(spark):
    df = spark.createDataFrame([(1, "all users affected and the anr, login fails with 2g")], "report_id INT, corpus STRING")
    row = keyword_hits(df).first()
    assert row["p0_hard"] == [r"\ball users affected\b", r"\ball users\b"]
    assert row["p1_hard"] == [r"\banr\b"] and row["p1_soft"] == ["login fails"] and row["p2"] == ["2g"]


def test_required_literals():
    assert t.required_literal(r"\banr\b") == "anr"
    assert t.required_literal(r"crash(?:es)? to (?:home|desk)") == "crash"
    assert t.required_literal(r"a|b") == ""
    assert t.required_literal(r"colou?r") == "colo"


def test_lexicon_rules_checks_size(spark):
    df = spark.createDataFrame([("c", 1, "UI", "scroll"), ("c", 2, "DS", "nps"), ("c", 1, "UI", "swipe")], "list STRING, rank INT, label STRING, pattern STRING")
    assert lexicon_rules(df, "c") == [("UI", ["scroll", "swipe"]), ("DS", ["nps"])]
    try:
        lexicon_rules(df, "c", max_entries=2)
        raise AssertionError("size not checked")
    except ValueError:
        pass


def test_form_reports(spark):
    rows = [("a", " T ", "iOS", "S", "1) one\n\n* two\nthree", "Ann"), ("b", "", "Web", " ", "x", "y")]
    got = dict(form_reports(spark.createDataFrame(rows, "report_id STRING, title STRING, platform STRING, summary STRING, steps STRING, reporter STRING")).collect())
    assert got["a"] == (
        "From: Ann\nSubject: T\n\nPlatform: iOS\n\nDescription:\nS\n\nSteps to Reproduce:\n1. one\n2. two\n3. three\n"
    )
    assert got["b"] == ""


def test_json_from_text(spark):
    get = lambda text: spark.createDataFrame([(text,)], "t STRING").select(t.json_from_text(F.col("t")).alias("v")).first()["v"]
    assert get('{"a": 1}') == '{"a": 1}'
    assert get('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert get('so: {"a": "}{", "b": {"c": "\\""}} done {') == '{"a": "}{", "b": {"c": "\\""}}'
    long = '{"a": "' + "\\\\n{" * 20000 + '"}'
    assert get("see " + long + " and {") == long
    assert get("nothing") is None and get("{broken") is None


def test_phrases_of_texts():
    rng = random.Random(1)
    for _ in range(40):
        phrases = list({"".join(rng.choices("abé ", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30))})
        texts = [
            rng.choice([None, "".join(rng.choices("abcé ", k=rng.choice([0, 3, 20, 3000])))]) for _ in range(40)
        ]
        own = automaton.Automaton([p.encode() for p in phrases])
        want = [[i for i, p in enumerate(phrases) if x is not None and p in x] for x in texts]
        assert automaton.phrases_of_texts(own, pa.array(texts, pa.string())).to_pylist() == want
    empty = automaton.phrases_of_texts(automaton.Automaton([]), pa.array(["a", None], pa.string()))
    assert empty.to_pylist() == [[], []]


def test_lexicon_table_of_any_size(spark):
    """Shards, hot phrases, repeated and odd rows against plain search."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcde", k=4))
    entries = [(k, f"l{k % 7}", word()) for k in range(1, 900)]
    entries += [(5000, "hot", "a"), (1, "tie", "a"), (6000, "none", ""), (7000, "none", None)]
    texts = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 30])))) for k in range(150)]
    texts += [(200, None), (201, "a" * 100_000), (202, "zzz")]
    corpus = spark.createDataFrame([(i, t, "p") for i, t in texts], "report_id long, corpus string, pattern string")
    lexicon = spark.createDataFrame(entries, "rank int, label string, pattern string")
    want = sorted((i, r, b, p) for i, t in texts for r, b, p in entries if t is not None and p and p in t)
    found = lexicon_join(corpus, lexicon)
    assert sorted(tuple(r) for r in found.collect()) == want
    shards = lexicon_matches(corpus.select("report_id", "corpus"), lexicon, shard_bytes=500)
    assert sorted(set(tuple(r) for r in shards.collect())) == sorted({(i, t, p) for i, t in texts for _, _, p in entries if t is not None and p and p in t})
    first = {i: min([(r, b) for j, r, b, _ in want if j == i], default=(0, "bugs"))[1] for i, _ in texts}
    assert {r.report_id: r.component_hint for r in route_components(corpus, lexicon, "bugs").collect()} == first
    assert lexicon_join(corpus.limit(0), lexicon).collect() == [] and lexicon_join(corpus, lexicon.limit(0)).collect() == []
    reports = spark.createDataFrame([(1, FULL), (2, "nothing")], "report_id long, raw_text string")
    rules = lexicon_table(spark, [("Pay", ["spins forever"]), ("Other", ["coupon"])])
    routed = with_components(parse_reports(reports), rules)
    assert {r.report_id: r.component_hint for r in routed.collect()} == {1: "Pay", 2: "bugs"}


def test_component_searches_are_compiled(spark):
    """On a staged corpus the searches are no lambda; the phrase may lie across text and title."""
    rows = spark.createDataFrame([("a log", "Level"), ("none", None), (None, "cart"), ("x", "cart")], "text string, title string")
    staged = rows.select("text", "title", x.component_corpus(F.col("text"), F.col("title")).alias("corpus"))
    text, title = F.col("text"), F.col("title")
    both = staged.select(x.component(text, title).alias("a"), x.component(text, title, corpus=F.col("corpus")).alias("b"))
    got = both.collect()
    assert [r.a for r in got] == [r.b for r in got] and [r.b for r in got][0] == got[3].b == "Backend"
    plan = staged.select(x.component(text, title, corpus=F.col("corpus")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029", "\n\r", "\r\n\n"])
def test_every_line_end(spark, end):
    """Lines are split at one plain character after the other ends are made into it."""
    df = spark.createDataFrame([(f"{end}a{end}b\nc{end}",), ("",), (None,)], "s string")
    old = F.split("s", r"\r\n|[\n\r\x0b\x0c\u0085\u2028\u2029]", -1)
    assert all(r.a == r.b for r in df.select(t.lines(F.col("s")).alias("a"), old.alias("b")).collect())


def test_version_of_any_digits(spark):
    texts = ["on V1.2.3 now", "v١.٢.٣", "Version : 2.1", "App Version: v3.4", "version 5.6", "v1.2", None]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    got = [r[0] for r in df.select(x.version(F.col("s"))).collect()]
    assert got == ["1.2.3", "١.٢.٣", None, "3.4", "5.6", None, None]
