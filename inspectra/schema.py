"""Schemas of the tables that the operators pass on to each other."""

from __future__ import annotations

COMPONENT_TYPES = ("envelope", "subject", "body", "attachment", "generic")
SEVERITIES = ("info", "low", "medium", "high", "critical")
STATUSES = ("new", "in_progress", "resolved", "dismissed", "escalated")

COMPONENTS = "message_id string, component_idx int, component_type string, component_name string, content string"
MATCHES = (
    "message_id string, component_idx int, component_type string, component_name string, analyzer_name string, "
    "rule_name string, matched_text string, start_offset int, end_offset int, confidence double"
)
VIOLATIONS = "message_id string, policy_name string, triggered boolean, severity string, matched_rules array<string>, match_count long, exceptions_applied array<string>, error string"
MATCH_COLUMNS = tuple(c.split()[0] for c in MATCHES.split(", "))
