"""Schemas of records, state, events and feedback."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, TIME, TEXTS, TEXT_MAP = T.StringType(), T.TimestampType(), T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())


def _struct(*fields: tuple[T.DataType, str], required: str = "") -> T.StructType:
    """Fields from (type, names); no session is needed, so workers can import this."""
    return T.StructType([T.StructField(name, kind, name not in required.split()) for kind, names in fields for name in names.split()])


RECORD = _struct(
    (TEXT, "source company title original_url apply_url source_job_id"),
    (TIME, "posted_at"),
    (TEXT, "location_text remote_text employment_type salary_text timezone_text description_raw description_clean status"),
    (TEXT_MAP, "source_metadata"),
    required="source company title original_url description_raw description_clean status",
)

STATE = _struct(
    (TEXT, "job_uid fingerprint content_hash source source_job_id company title original_url apply_url"),
    (TIME, "posted_at"),
    (TEXT, "location_text remote_text employment_type salary_text timezone_text description_raw description_clean status"),
    (TEXTS, "detected_blockers matched_signals"),
    (TEXT, "filter_decision"),
    (T.DoubleType(), "fit_score"),
    (TEXT, "fit_reason tier bucket"),
    (TEXTS, "risks audit_log"),
    (T.BooleanType(), "bridge_role"),
    (TEXT, "last_alerted_tier"),
    (TEXT_MAP, "source_metadata"),
    (TIME, "first_seen_at last_seen_at created_at updated_at"),
)

PAYLOAD = _struct((TEXT, "tier previous_tier new_tier"), (T.BooleanType(), "changed"), (TEXT, "channel message"))
EVENT = _struct((TEXT, "job_uid event_type"), (TIME, "created_at"), (PAYLOAD, "payload"))
FEEDBACK = _struct((TEXT, "job_uid label note"), (TIME, "created_at"))

DECISIONS, TIERS, STATUSES = ("pass", "reject", "review"), ("A", "B", "C"), ("open", "closed", "unknown")
