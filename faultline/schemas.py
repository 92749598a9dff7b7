"""Schemas of the tables the operators read and write."""

from __future__ import annotations

ISSUES = (
    "key STRING, fields STRUCT<summary: STRING, description: VARIANT, status: STRUCT<name: STRING>, "
    "assignee: STRUCT<displayName: STRING, emailAddress: STRING>, priority: STRUCT<name: STRING>, "
    "labels: ARRAY<STRING>, components: ARRAY<STRUCT<name: STRING>>, created: STRING, updated: STRING, "
    "issuetype: STRUCT<name: STRING>>, renderedFields STRUCT<description: STRING>"
)
TICKETS = (
    "key STRING, summary STRING, description STRING, status STRING, component STRING, priority STRING, "
    "assignee STRING, reporter STRING, duplicate_of STRING, media_paths ARRAY<STRING>, "
    "created TIMESTAMP_NTZ, updated TIMESTAMP_NTZ"
)
TICKET_EVENTS = "timestamp TIMESTAMP_NTZ, seq BIGINT, event STRING, key STRING, payload STRING"
CORRECTIONS = (
    "timestamp STRING, bug_hash STRING, predicted_component STRING, corrected_component STRING, "
    "confidence_at_prediction STRING, title STRING, bug_text STRING"
)
MANIFEST = (
    "repos ARRAY<STRUCT<name: STRING, team: STRING, stack: STRING, prod_branch: STRING, "
    "freshness: STRING, purpose: STRING, owns_features: ARRAY<STRING>>>"
)
INSERT_PAYLOAD = (
    "summary STRING, description STRING, status STRING, component STRING, priority STRING, "
    "assignee STRING, reporter STRING, duplicate_of STRING, media_paths ARRAY<STRING>"
)
