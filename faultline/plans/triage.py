"""Whole tables of reports from text to drafts.

Both flows share the operators; they differ in how matches, components and
owners are found. Results that several branches read are written once to the
shared folder and read back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline import lexicons as lx
from faultline.operators import classify, dedup, drafts, extraction, priority, quality, retrieval, routing, tfidf
from faultline.session import materialise
from faultline.streaming import streams


@dataclass
class Triage:
    parsed: DataFrame
    matches: DataFrame
    scored: DataFrame
    owners: DataFrame
    duplicates: DataFrame
    issues: DataFrame
    drafts: DataFrame


def _query_text() -> Column:
    return F.concat_ws("\n", "title", "description", "actual_result")


FACTS = ["summary", "assignee", "priority", "component"]


def triage_by_rules(
    reports: DataFrame, history: DataFrame | tfidf.TextIndex, dim: DataFrame, product: str = "App"
) -> Triage:
    """``reports(report_id, raw_text)`` against the past by words alone.

    ``history`` is a table ``key, text, summary, assignee, priority, component``, or an index
    built from one (with ``key`` as ``doc_id``), which is searched as it is.
    """
    if isinstance(history, DataFrame):
        history = tfidf.build_text_index(history.select(F.col("key").alias("doc_id"), "text", *FACTS))
    parsed = materialise(extraction.parse_reports(reports, product=product), "parsed")
    queries = parsed.select(F.col("report_id").alias("query_id"), _query_text().alias("text"))
    found, duplicates = tfidf.search_text_index(queries, history)
    matches = retrieval.with_attributes(found, history.facts, FACTS)
    matches = materialise(matches, "matches")
    scored = priority.score_priority(parsed, matches)
    owners = routing.owner_frequency(matches, queries)
    issues = quality.gate_vague_report(parsed)
    built = drafts.build_drafts(parsed, scored, matches, owners, duplicates, dim, issues=issues)
    return Triage(parsed, matches, scored, owners, duplicates, issues, built)


def stream_by_rules(reports: DataFrame, index_path: str, dim: DataFrame, out: str, product: str = "App") -> StreamingQuery:
    """Arriving reports through the whole flow by words: drafts, scores, owners, matches, rejects.

    Every micro-batch loads the newest complete version of the index below ``index_path`` (see
    :func:`tfidf.build_text_index`) and the component table; a new version that is
    written beside takes effect with the next batch, without a restart.
    """

    def flow(batch: DataFrame) -> dict[str, DataFrame]:
        index = tfidf.load_text_index(batch.sparkSession, index_path)
        done = triage_by_rules(batch, index, dim, product)
        return {
            "parsed": done.parsed, "matches": done.matches, "scored": done.scored, "owners": done.owners,
            "duplicates": done.duplicates, "drafts": done.drafts,
        }

    return streams.stream_triage(reports, flow, out)


def triage_by_vectors(
    reports: DataFrame,
    index: DataFrame,
    tickets: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    model: LogisticRegressionModel,
    classes: list,
    roster: DataFrame,
    managers: DataFrame,
    team_managers: DataFrame,
    verdicts: DataFrame,
    dim: DataFrame,
    product: str = "App",
    findings: DataFrame | None = None,
) -> Triage:
    """Vector recall from index and tickets, rerank, classifier, routed owners.

    ``index`` and ``tickets`` carry ``key, text, vec, summary, assignee,
    priority, component``; ``encode`` adds ``vec`` to ``(query_id, text)``;
    ``verdicts(query_id, key, confidence)`` may be empty. Reports with ``from_form`` are
    forms: they need no sections, but their fields must agree. ``findings(report_id,
    seq, kind, path, one_line_summary, screen, contradiction)`` of media go ahead of
    the text, into the notes, and are held against the text.
    """
    media = None
    if findings is not None:
        media = materialise(drafts.findings_rollup(findings), "media")
        reports = drafts.with_media_summary(reports, media)
    parsed = materialise(extraction.parse_reports(reports, product=product), "parsed")
    queries = parsed.select(F.col("report_id").alias("query_id"), _query_text().alias("text"))
    queries = materialise(encode(queries), "queries")
    routed = classify.predict_component_lr(queries, model, classes).select("query_id", "component")
    routed = materialise(routed, "routed")
    found = retrieval.rerank_two_stage(queries, index, tickets)
    both = retrieval.union_candidates(index.select("key", *FACTS), tickets.select("key", *FACTS))
    matches = materialise(retrieval.with_attributes(found, both, FACTS), "matches")
    signal = retrieval.gate_relevance(matches)
    ids = queries.select("query_id")
    duplicates = dedup.decide_duplicates(signal, ids, verdicts, duplicate=lx.VECTOR_DUPLICATE)
    flagged = dedup.reflag(signal, duplicates)
    owners = routing.owner_routed(routed, signal, roster, managers, team_managers)
    scored = priority.priority_three_tier(priority.score_priority(parsed, flagged))
    component = routed.withColumnsRenamed({"query_id": "report_id", "component": "component_hint"})
    routed_reports = parsed.drop("component_hint").join(component, "report_id")
    gates = [quality.gate_vague_report(parsed)]
    if "from_form" in parsed.columns:
        gates.append(quality.gate_field_consistency(parsed.filter(F.coalesce("from_form", F.lit(False)))))
    if findings is not None:
        gates.append(quality.gate_media_contradiction(findings))
    issues = materialise(quality.quality_issues(*gates), "issues")
    built = drafts.build_drafts(routed_reports, scored, matches, owners, duplicates, dim, issues=issues, media=media)
    return Triage(parsed, matches, scored, owners, duplicates, issues, quality.releasable(built, issues))
