"""Closed domains shared by several operators."""

from __future__ import annotations

# Lifecycle domains and their numeric meanings.
PLATFORMS = ("TELEGRAM", "MAX", "UNKNOWN")
IMPORT_STATUSES = ("RUNNING", "SUCCESS", "PARTIAL", "FAILED")
COMPLETED_IMPORTS = ("SUCCESS", "PARTIAL")
ROW_STATUSES = ("VALID", "REJECTED")
TRUST_LEVELS = ("OFFICIAL", "PRIMARY", "REPUTABLE_SECONDARY", "AGGREGATOR", "UNKNOWN")
TRUST_AUTHORITY = {
    "OFFICIAL": 100,
    "PRIMARY": 85,
    "REPUTABLE_SECONDARY": 60,
    "AGGREGATOR": 35,
    "UNKNOWN": 15,
}
TRUST_ORDER = {
    "UNKNOWN": 0,
    "AGGREGATOR": 1,
    "REPUTABLE_SECONDARY": 2,
    "PRIMARY": 3,
    "OFFICIAL": 4,
}
FIRST_HAND_TRUST = ("OFFICIAL", "PRIMARY")
EVENT_TYPES = ("RELEASE", "UPDATE", "NEW_TOOL", "RESEARCH", "GUIDE", "INCIDENT", "OTHER")
ITEM_STATUSES = (
    "NEW",
    "CLUSTERED",
    "FILTERED",
    "SELECTED",
    "BACKLOG",
    "VERIFIED",
    "CONVERTED_TO_CONTENT",
    "REJECTED",
)
CLUSTER_STATUSES = (
    "OPEN",
    "SCORED",
    "SELECTED",
    "BACKLOG",
    "FILTERED",
    "VERIFIED",
    "CONTENT_CREATED",
    "REJECTED",
    "EXPIRED",
)
RESCORABLE_STATUSES = ("OPEN", "SCORED", "BACKLOG", "FILTERED")
MATCH_METHODS = ("URL", "FINGERPRINT", "ENTITY", "SIMHASH", "SEED")
OCCUPYING_STATUSES = ("PUBLISHED", "SIMULATED")
PUBLICATION_STATUSES = ("SIMULATED", "PUBLISHED", "FAILED", "BLOCKED")
CALL_STATUSES = ("SUCCESS", "ERROR", "BLOCKED_BY_COST_LIMIT")
