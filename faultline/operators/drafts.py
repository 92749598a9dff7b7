"""Ticket drafts: nested documents from the decisions about a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.functions import text as t


def reporter_display(name: Column, email: Column) -> Column:
    """``name <email>``, or whichever exists."""
    n, e = (t.strip(F.coalesce(c, F.lit(""))) for c in (name, email))
    return F.when((n != "") & (e != ""), F.concat(n, F.lit(" <"), e, F.lit(">"))).when(n != "", n).otherwise(e)


def component_dim(
    df: DataFrame, dim: DataFrame, component: str = "component_hint", catch_all: str = lx.CATCH_ALL
) -> DataFrame:
    """Adds ``component, component_id, team``; an unknown component keeps only the catch-all team."""
    side = dim.select(F.col("component").alias(component), "component_id", "team", F.lit(True).alias("known"))
    return df.join(side, component, "left").select(
        *[c for c in df.columns],
        F.when(F.col("known"), F.col(component)).alias("component"),
        "component_id",
        F.coalesce("team", F.lit(catch_all)).alias("team"),
    )


def component_by_keyword(hint: Column, keywords: Mapping[str, str]) -> Column:
    """First keyword inside the hint names the component, else null."""
    ladder = None
    for word, name in keywords.items():
        hit = F.lower(hint).contains(word)
        ladder = F.when(hit, name) if ladder is None else ladder.when(hit, name)
    return ladder


def draft_labels(
    platform: Column, team: Column, base: Sequence[str] = ("triage",), catch_all: str = lx.CATCH_ALL, strict: bool = False
) -> Column:
    """Base labels, the team, and the platforms. ``strict`` wants the platform alone and no team."""
    low = F.lower(F.coalesce(platform, F.lit("")))
    android, ios = (low == "android", low == "ios") if strict else (low.contains("android"), low.contains("ios"))
    named = F.when(
        (F.coalesce(team, F.lit("")) != "") & (team != catch_all), F.replace(F.lower(team), F.lit("_"), F.lit("-"))
    )
    return F.array_compact(
        F.array(
            *[F.lit(b) for b in base],
            F.lit(None).cast("string") if strict else named,
            F.when(android, "android"),
            F.when(ios, "ios"),
        )
    )


# --- the document -------------------------------------------------------------------
#
# A node is a JSON string built by to_json, so nodes of different shape fit in
# one array; sections that do not apply are null and drop out.


def _text(c: Column, bold: bool = False) -> Column:
    marks = F.array(F.struct(F.lit("strong").alias("type")))
    fields = [F.lit("text").alias("type"), F.coalesce(c, F.lit("")).alias("text")]
    return F.to_json(F.struct(*fields, marks.alias("marks")) if bold else F.struct(*fields))


def _holder(kind: str, children: Column, extra: str = "") -> Column:
    return F.concat(F.lit(f'{{"type":"{kind}",{extra}"content":['), children, F.lit("]}"))


def _paragraph(*inline: Column) -> Column:
    return _holder("paragraph", F.concat_ws(",", *inline))


def _heading(title: str) -> Column:
    return _holder("heading", _text(F.lit(title)), '"attrs":{"level":3},')


def _list(kind: str, items: Column) -> Column:
    nodes = F.transform(items, lambda i: _holder("listItem", _paragraph(_text(i))))
    return _holder(kind, F.array_join(nodes, ","))


def draft_document() -> Column:
    """Document tree of a draft, from the joined columns of build_drafts."""
    found = F.coalesce(F.size("similar_bugs"), F.lit(0)) > 0
    lines = F.transform(
        "similar_bugs",
        lambda m: F.format_string("%s (%s, sim=%.2f): %s", m["key"], m["priority"], m["similarity"], m["summary"]),
    )
    duplicate = F.format_string(
        "May repeat %s (%.0f%% sure); compare the two before filing.",
        F.col("duplicate_of"), F.col("duplicate_confidence") * 100,
    )
    reporter = F.trim(F.concat(
        F.coalesce("reporter_name", F.lit("")), F.lit(" <"), F.coalesce("reporter_email", F.lit("")), F.lit(">")
    ))
    known = F.col("reporter_name").isNotNull() | F.col("reporter_email").isNotNull()
    environment = F.array(
        F.concat(F.lit("Platform: "), "platform"),
        F.concat(F.lit("App version: "), F.coalesce("app_version", F.lit("unknown"))),
        F.concat(F.lit("Reproducibility: "), "reproducibility"),
    )
    assessment = F.concat(
        F.lit("Priority: "), "priority", F.lit("  |  Severity: "), "severity", F.lit("  |  ")
    )
    sections = [
        _paragraph(
            _text(F.lit("Draft. "), bold=True),
            _text(F.lit("To be checked and filed by a person.")),
        ),
        _heading("Description"),
        _paragraph(_text(F.col("description"))),
        _heading("Impact"),
        _paragraph(_text(F.col("impact"))),
        _heading("Steps to Reproduce"),
        F.when(F.size("steps_to_reproduce") > 0, _list("orderedList", F.col("steps_to_reproduce"))).otherwise(
            _paragraph(_text(F.lit(lx.NOT_PROVIDED)))
        ),
        _heading("Expected and actual"),
        _paragraph(_text(F.lit("Expected: "), bold=True), _text(F.col("expected_result"))),
        _paragraph(_text(F.lit("Actual: "), bold=True), _text(F.col("actual_result"))),
        _heading("Environment"),
        _list("bulletList", environment),
        _heading("Assessment"),
        _paragraph(_text(assessment, bold=True), _text(F.col("justification"))),
        F.when(found, _heading("Similar issues")),
        F.when(found & F.col("duplicate_of").isNotNull(), _paragraph(_text(duplicate, bold=True))),
        F.when(found, _list("bulletList", lines)),
        F.when(known, _heading("Reporter")),
        F.when(known, _paragraph(_text(reporter))),
    ]
    return F.concat(F.lit('{"type":"doc","version":1,"content":['), F.concat_ws(",", *sections), F.lit("]}"))


def similar_bugs(matches: DataFrame) -> DataFrame:
    """The matches of a report (at most k) as one ordered array."""
    entry = F.struct(
        "rank", F.col("key").cast("string").alias("key"), "summary", "similarity", "assignee", "priority", "component"
    )
    return matches.groupBy(F.col("query_id").alias("report_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda m: F.struct(*[m[n].alias(n) for n in ("key", "summary", "similarity", "assignee", "priority", "component")]),
        ).alias("similar_bugs")
    )


def build_drafts(
    parsed: DataFrame, scored: DataFrame, matches: DataFrame, owners: DataFrame, duplicates: DataFrame, dim: DataFrame,
    base_labels: Sequence[str] = ("triage",), issues: DataFrame | None = None, media: DataFrame | None = None,
) -> DataFrame:
    """Everything decided about a report as one nested row.

    The notes carry the kinds of quality ``issues(report_id, type)`` and the
    ``media(report_id, combined_summary)``, where given.
    """
    joined = (
        component_dim(parsed, dim)
        .join(scored, "report_id")
        .join(similar_bugs(matches), "report_id", "left")
        .join(owners.withColumnRenamed("query_id", "report_id"), "report_id", "left")
        .join(
            duplicates.select(
                F.col("query_id").alias("report_id"),
                F.col("duplicate_of").cast("string").alias("duplicate_of"),
                "duplicate_confidence",
            ),
            "report_id", "left",
        )
    )
    none = F.lit(None).cast("string")
    if issues is None:
        joined = joined.withColumn("issue_kinds", F.array().cast("array<string>"))
    else:
        kinds = issues.groupBy("report_id").agg(F.array_sort(F.collect_set("type")).alias("issue_kinds"))
        joined = joined.join(kinds, "report_id", "left").withColumn(
            "issue_kinds", F.coalesce("issue_kinds", F.array().cast("array<string>"))
        )
    if media is None:
        joined = joined.withColumn("combined_summary", none)
    else:
        joined = joined.join(media.select("report_id", "combined_summary"), "report_id", "left")
    fields = F.struct(
        F.col("title").alias("summary"),
        F.struct(F.col("priority_id").alias("id")).alias("priority"),
        draft_document().alias("description"),
        draft_labels(F.col("platform"), F.col("team"), base_labels).alias("labels"),
        F.struct(F.col("severity").alias("value")).alias("severity"),
        F.when(F.col("component").isNotNull(), F.array(F.struct(F.col("component").alias("name")))).alias("components"),
        F.col("suggested_owner").alias("suggested_assignee"),
        F.col("duplicate_of").alias("duplicate_candidate"),
        F.when(F.col("duplicate_of").isNotNull(), F.col("duplicate_confidence")).alias("duplicate_confidence"),
    )
    notes = F.struct(
        "team",
        F.coalesce("component", F.lit("unclassified (needs manual routing)")).alias("component"),
        F.col("scoring_path").alias("priority_scoring_path"),
        F.col("justification").alias("severity_justification"),
        F.col("suggested_owner").alias("owner_suggestion"),
        "owner_reason",
        "duplicate_of",
        "duplicate_confidence",
        "similar_bugs",
        F.col("issue_kinds").alias("quality_issues"),
        F.col("combined_summary").alias("media_summary"),
    )
    return joined.select(
        "report_id", fields.alias("fields"), F.col("title").alias("display_summary"), notes.alias("triage_notes")
    )


# --- review ---------------------------------------------------------------------------


def similar_report_rows(matches: DataFrame, local_prefix: str = "TKT-") -> DataFrame:
    """Matches for display: local or external key, assignee or a dash."""
    return matches.select(
        "query_id", "rank", "key",
        F.when(F.col("key").startswith(local_prefix), "local").otherwise("external").alias("origin"),
        F.round("similarity", 3).alias("similarity"),
        F.coalesce("assignee", F.lit("(unassigned)")).alias("assignee"),
        F.coalesce("priority", F.lit("—")).alias("priority"),
    )


def path_signals(scoring_path: Column) -> Column:
    """What follows the layer name of a scoring path."""
    cut = F.instr(scoring_path, ":")
    return F.when(cut > 0, t.strip(F.substr(scoring_path, cut + 1))).otherwise(F.coalesce(scoring_path, F.lit("—")))


def override_audit(reviews: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Changed fields of a review: ``predicted_x`` and ``edited_x`` to a map of from/to."""
    changes = [
        F.when(
            ~F.col(f"predicted_{f}").eqNullSafe(F.col(f"edited_{f}")),
            F.struct(
                F.lit(f).alias("key"),
                F.struct(F.col(f"predicted_{f}").alias("from"), F.col(f"edited_{f}").alias("to")).alias("value"),
            ),
        )
        for f in fields
    ]
    return reviews.select(
        "report_id", F.map_from_entries(F.array_compact(F.array(*changes))).alias("human_overrides")
    )


def apply_overrides(drafts: DataFrame, overrides: DataFrame, dim: DataFrame, catch_all: str = lx.CATCH_ALL) -> DataFrame:
    """Reviewer values over predicted ones; team, ids and severity follow.

    ``drafts(report_id, component, priority, owner)``, ``overrides`` alike.
    """
    from faultline.operators.priority import priority_dim

    o = overrides.select("report_id", *[F.col(c).alias(f"o_{c}") for c in ("component", "priority", "owner")])
    patched = drafts.join(o, "report_id", "left").select(
        "report_id",
        *[F.coalesce(f"o_{c}", c).alias(c) for c in ("component", "priority", "owner")],
        (F.col("o_component").isNotNull() | F.col("o_priority").isNotNull() | F.col("o_owner").isNotNull()).alias("edited"),
    )
    teams = dim.select("component", "component_id", "team")
    joined = patched.join(teams, "component", "left").withColumn("team", F.coalesce("team", F.lit(catch_all)))
    return priority_dim(joined).select(
        "report_id",
        F.when(F.col("component") != catch_all, F.col("component")).alias("component"),
        "component_id", "team", "priority", "priority_id", "severity", "owner", "edited",
    )


def findings_rollup(findings: DataFrame, chunk: int = 1000) -> DataFrame:
    """One summary text per report: image summary first, then each video's line.

    ``findings(report_id, seq, kind, path, one_line_summary)``. Lines are
    joined in two steps, by runs of ``seq`` and then by report, so the rows of
    one report are spread over several tasks.
    """
    name = F.regexp_extract("path", r"[^/]+$", 0)
    line = F.when(
        F.col("kind") == "video", F.concat(F.lit("[Video "), name, F.lit("] "), F.col("one_line_summary"))
    ).otherwise(t.strip(F.col("one_line_summary")))
    video = (F.col("kind") == "video").cast("int")

    def joined(parts: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "seq", parts))), lambda x: x[parts]), " ")

    return (
        findings.filter(F.coalesce("one_line_summary", F.lit("")) != "")
        .select("report_id", "seq", video.alias("order"), line.alias("line"))
        .groupBy("report_id", "order", F.floor(F.col("seq") / chunk).alias("run"))
        .agg(joined("line").alias("run_text"))
        .withColumnRenamed("run", "seq")
        .groupBy("report_id")
        .agg(joined("run_text").alias("combined_summary"))
    )


def with_media_summary(reports: DataFrame, summaries: DataFrame) -> DataFrame:
    """The media summary ahead of the report text."""
    body = t.strip(F.col("raw_text"))
    both = F.concat(
        F.lit("[From attached media]\n"), t.strip(F.col("combined_summary")),
        F.lit("\n\n[Text]\n"), body,
    )
    return reports.join(summaries, "report_id", "left").select(
        "report_id",
        F.when(F.coalesce("combined_summary", F.lit("")) != "", both).otherwise(body).alias("raw_text"),
        *[c for c in reports.columns if c not in ("report_id", "raw_text")],
    )
