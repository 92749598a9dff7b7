"""Queries for the whole flows and the index they search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.operators import blockjoin, classify, indexing, retrieval, tfidf
from faultline.plans import queries_decisions as dec
from faultline.plans import queries_tickets as tic
from faultline.plans import standins as s
from faultline.plans import triage
from faultline.plans.queries_extraction import PRODUCT, VAGUE_CTE
from faultline.plans.queries_retrieval import counts_sql, tfidf_ctes
from faultline.plans.registry import query, table
from faultline.session import fresh_path
from faultline.streaming import streams

# Every document as an issue of the past.
_HISTORY = """SELECT doc_id AS key, text, concat(source, ' ', lang) AS summary, CASE WHEN lang = 'es' THEN '' ELSE source END AS assignee,
  concat('P', CAST(doc_id % 4 AS STRING)) AS priority, source AS component FROM documents"""

_BY_WORDS = f"""history AS ({_HISTORY}), {tfidf_ctes('documents', 'doc_id', 'text', lx.TFIDF_MAX_FEATURES, 'h')},
 asks AS (SELECT report_id AS query_id, concat_ws(chr(10), title, description, actual_result) AS text FROM parsed),
 qraw AS (SELECT doc_id AS query_id, term, (1 + ln(tf)) * idf AS raw FROM ({counts_sql('asks', 'query_id', 'text')}) JOIN hvocab USING (term)),
 qw AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS weight FROM qraw),
 hsims AS (SELECT query_id, doc_id AS key, round(sum(qw.weight * hweights.weight), 6) AS similarity FROM qw JOIN hweights USING (term) GROUP BY query_id, doc_id),
 ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS rank FROM hsims) WHERE rank <= {lx.TFIDF_TOP_K} AND similarity > 0),
 matches AS (SELECT r.*, summary, assignee, priority, component FROM ranked r JOIN history USING (key) WHERE similarity >= {lx.TFIDF_SIMILAR})"""
_FLOW = dec.SCORED.replace(dec._M, _BY_WORDS).replace("m.similarity >= 0.80", f"m.similarity >= {lx.TFIDF_DUPLICATE}")


def _history(spark, sf) -> DataFrame:
    s.views(spark, sf, "documents")
    return spark.sql(_HISTORY)


_BY_RULES = f"""{_FLOW}{VAGUE_CTE},
 cnt AS (SELECT query_id, assignee, count(*) AS n, min(rank) AS fr FROM matches WHERE assignee <> '' GROUP BY 1, 2),
 own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, fr) AS p FROM cnt) WHERE p = 1)
 SELECT s.report_id, s.priority, s.scoring_path, own.assignee AS owner, CASE WHEN d.similarity >= {lx.TFIDF_DUPLICATE} THEN CAST(d.key AS VARCHAR) END AS duplicate_of,
   p.component_hint AS component, coalesce(v.type, '') AS issues
 FROM sc1 s JOIN parsed p USING (report_id) LEFT JOIN own ON own.query_id = s.report_id LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) d ON d.query_id = s.report_id
 LEFT JOIN vague v USING (report_id)"""


def _decided(scored: DataFrame, parsed: DataFrame, drafts: DataFrame) -> DataFrame:
    notes = drafts.select(
        "report_id",
        F.col("fields.suggested_assignee").alias("owner"),
        F.col("fields.duplicate_candidate").alias("duplicate_of"),
        F.array_join("triage_notes.quality_issues", ",").alias("issues"),
    )
    component = parsed.select("report_id", F.col("component_hint").alias("component"))
    return scored.select("report_id", "priority", "scoring_path").join(notes, "report_id").join(component, "report_id")


@query("triage_by_rules", _BY_RULES)
def triage_by_rules(spark, sf):
    done = triage.triage_by_rules(s.reports(spark, sf), _history(spark, sf), tic._dim(spark, sf), PRODUCT)
    return _decided(done.scored, done.parsed, done.drafts)


@query("stream_triage_flow", f"""SELECT * FROM ({_BY_RULES}) UNION ALL
 SELECT -1 - doc_id, NULL, NULL, NULL, NULL, NULL, 'rejected' FROM documents WHERE doc_id % 50 = 0""")
def stream_triage_flow(spark, sf):
    """All reports in two micro-batches against a saved index, and empty ones that stop nothing."""
    source, out, index = fresh_path(spark, "mails"), fresh_path(spark, "triage"), fresh_path(spark, "text-index")
    tfidf.build_text_index(_history(spark, sf).withColumnRenamed("key", "doc_id"), path=index)
    mails = s.reports(spark, sf)
    blank = mails.filter(F.col("report_id") % 50 == 0).select((-1 - F.col("report_id")).alias("report_id"), F.lit(" \n").alias("raw_text"))
    every = mails.unionByName(blank)
    for k in range(2):
        every.where(F.pmod("report_id", F.lit(2)) == k).repartition(8).write.parquet(f"{source}/{k}")
    arriving = streams.file_stream(spark, "report_id BIGINT, raw_text STRING", f"{source}/*", "*.parquet", per_trigger=8)
    triage.stream_by_rules(arriving, index, tic._dim(spark, sf), out, PRODUCT).awaitTermination()
    scored, parsed, drafts, rejects = (spark.read.parquet(f"{out}/{name}") for name in ("scored", "parsed", "drafts", "rejects"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("priority", "scoring_path", "owner", "duplicate_of", "component")]
    return _decided(scored, parsed, drafts).unionByName(rejects.select("report_id", *nothing, F.lit("rejected").alias("issues")))


def _index(spark, sf) -> indexing.Index:
    issues = _history(spark, sf).withColumn("key", F.col("key").cast("string"))
    sources = table(spark, sf, "documents").select(F.col("source").alias("component"))
    docs = table(spark, sf, "documents")
    corrections = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(
        F.lit("2024-01-01").alias("timestamp"), F.md5("text").alias("bug_hash"),
        F.col("source").alias("corrected_component"), F.col("text").alias("bug_text"),
    )
    managers = s.managers(spark, sf)
    return indexing.build_index(issues, corrections, managers, sources, fresh_path(spark, "search-index"), 128, max_iter=20)


@query("build_index", """WITH fixes AS (SELECT md5(text) AS h, max(source) AS component FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1),
 rows AS (SELECT source AS component FROM documents WHERE regexp_matches(text, '\\S') UNION ALL SELECT component FROM fixes)
 SELECT component AS label, count(*) AS n_rows, count(*) AS n_counted, 128 AS width, true AS known_class FROM rows GROUP BY 1""")
def build_index(spark, sf):
    idx = _index(spark, sf)
    counted = idx.counts.filter(F.col("kind") == "label").select(F.col("name").alias("label"), F.col("n").alias("n_counted"))
    return (
        idx.rows.groupBy("label")
        .agg(F.count("*").alias("n_rows"), F.max(F.size("vec")).alias("width"))
        .join(counted, "label")
        .withColumn("known_class", F.col("label").isin(idx.classes))
    )


@query("triage_by_vectors")
def triage_by_vectors(spark, sf):
    """All documents as reports, every fourth a form, turns of conversations as media."""
    idx = _index(spark, sf)
    reports = s.reports(spark, sf).withColumn("from_form", F.col("report_id") % 4 == 3)
    facts = _history(spark, sf).withColumn("key", F.col("key").cast("string")).drop("text", "assignee")
    index = idx.rows.join(facts, "key", "left").select("key", "text", "vec", "summary", "assignee", "priority", "component")
    items = table(spark, sf, "benchmark").select(
        F.concat(F.lit("TKT-"), F.col("item_id").cast("string")).alias("key"), "text", F.left("text", F.lit(60)).alias("summary"),
        F.lit("").alias("assignee"), F.lit("P2").alias("priority"), F.lit("src0").alias("component"))
    local = classify.embed_text(items, idx.encoder)
    verdicts = spark.createDataFrame([], "query_id BIGINT, key STRING, confidence STRING")
    done = triage.triage_by_vectors(
        reports, index, local, lambda q: classify.embed_text(q, idx.encoder), idx.model, idx.classes, idx.roster,
        s.managers(spark, sf), s.team_managers(spark, sf), verdicts, tic._dim(spark, sf), PRODUCT, tic._findings(spark, sf),
    )
    kinds = done.issues.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("issues"))
    owner = done.owners.select(F.col("query_id").alias("report_id"), "suggested_owner", "method")
    return (
        done.scored.select("report_id", "priority", "scoring_path")
        .join(owner, "report_id", "left")
        .join(kinds, "report_id", "left")
        .join(done.drafts.select("report_id", F.lit(True).alias("released")), "report_id", "left")
    )


@query("lsh_sim_join_recall", "SELECT 0::BIGINT AS wrong, true AS recall_reached, count(*) AS n_queries FROM embeddings")
def lsh_sim_join_recall(spark, sf):
    """The approximate join against the exact one: no wrong similarity, recall of 0.9 or more of all pairs over 0.3."""
    vectors = s.index(spark, sf).drop("label")
    asked = vectors.withColumnRenamed("key", "query_id")
    near = retrieval.approximate_join(asked, vectors, k=30, min_similarity=0.3)
    exact = blockjoin.topk_dense(asked, vectors, 30, min_similarity=0.3)
    both = exact.select("query_id", "key", F.col("similarity").alias("exact")).join(
        near.select("query_id", "key", "similarity"), ["query_id", "key"], "full"
    )
    seen = both.agg(
        F.count_if(F.col("similarity") != F.col("exact")).alias("wrong"),
        F.count_if(F.col("similarity").isNotNull() & F.col("exact").isNotNull()).alias("found"),
        F.count("exact").alias("all"),
    )
    queries = asked.agg(F.count("*").alias("n_queries"))
    return seen.join(queries, F.lit(True)).select(
        "wrong", (F.col("found") >= 0.9 * F.col("all")).alias("recall_reached"), "n_queries"
    )
