"""Data model: closed vocabularies, row types and deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of the data model.
ENTITY_TYPES = ("Person", "Organisation", "System", "Project", "FinancialInstrument", "Event", "Role", "Location")
RELATIONS = (
    "works_at", "has_role", "reports_to", "manages", "member_of",
    "created", "sent_email", "decided", "proposed", "approved", "rejected", "warned_about", "investigated",
    "has_status", "has_value", "depends_on", "conflicts_with", "supersedes", "related_to",
    "invested_in", "profited_from", "owes", "acquired",
)
STATUSES = ("current", "historical", "retracted", "disputed")
UNKNOWN = "Unknown"
SCHEMA_VERSION = "1.0.0"

# Thresholds and limits, all of them parameters of the operators that use them.
SIMILARITY, CONFIDENCE, RETRIES = 0.85, 0.5, 3
THREAD_MIN, THREAD_MAX, THREAD_TARGET = 5, 15, 15
BODY_MIN, BODY_MAX, SUBJECT_KEY_MAX, FILE_MIN, MAILBOX_CAP = 60, 3000, 120, 200, 500
EXCERPT_MAX, PROMPT_BODY_MAX, TOP_ENTITIES = 300, 1000, 10

MESSAGE = "seq long, email_id string, message_id string, in_reply_to string, refs array<string>, sender string, recipients_raw string, subject string, ts_raw string, ts timestamp, body string"
ENTITY = "seq long, id string, name string, type string, aliases array<string>, first_seen string, last_seen string, metadata map<string,string>"
EVIDENCE = "struct<source_id:string,excerpt:string,timestamp:string,source_type:string,author:string,subject:string,char_offset_start:int,char_offset_end:int>"
CLAIM = (
    "seq long, id string, subject_id string, subject_name string, relation string, object_id string, object_name string, confidence double, status string, "
    f"evidence array<{EVIDENCE}>, valid_from string, valid_until string, superseded_by string, extraction_version string, metadata map<string,string>"
)
MERGE = "id string, merge_type string, winner_id string, loser_id string, reason string, timestamp string, reversible boolean, original_snapshots struct<winner:string,loser:string>"


def stable_id(*parts: Column) -> Column:
    """Twelve hex digits that follow from a row's natural key."""
    return F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 12)


def checked(column: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The column, or an error where it is not one of ``allowed`` (nulls pass)."""
    bad = column.isNotNull() & ~column.isin(*allowed)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{what} not allowed: "), column)).cast("string")).otherwise(column)
