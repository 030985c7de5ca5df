"""Canonical shapes and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# --- fixed values: closed vocabularies of the event model ---------------------------------------
SOURCES = ["windows", "linux", "network", "dns", "cloud", "application", "edr", "identity", "simulator"]
EVENT_TYPES = [
    "authentication", "process_start", "process_end", "file_create", "file_modify", "file_delete", "file_read",
    "network_connection", "dns_query", "privilege_change", "user_created", "user_deleted", "group_change",
    "service_started", "service_stopped", "scheduled_task", "registry_change", "process_access",
    "security_alert", "application_log", "system_log",
]
SEVERITIES = ["info", "low", "medium", "high", "critical"]
DETECTION_KINDS = ["rule", "threshold", "sequence", "anomaly", "threat_intel"]
PHASES = [
    "reconnaissance", "initial_access", "execution", "persistence", "privilege_escalation", "defense_evasion",
    "credential_access", "discovery", "lateral_movement", "collection", "command_and_control", "exfiltration",
    "impact",
]
STATUSES = ["open", "investigating", "contained", "resolved", "false_positive"]
OPEN_STATUSES = ["open", "investigating"]
IOC_TYPES = ["ip", "domain", "url", "hash", "cidr"]
DEFAULT_SCORE = {"info": 5.0, "low": 15.0, "medium": 30.0, "high": 50.0, "critical": 75.0}
MAX_STRING = 8192
# ------------------------------------------------------------------------------------------------

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

EVENT_FIELDS: list[tuple[str, T.DataType]] = [
    ("event_id", S), ("tenant_id", S), ("timestamp", T.TimestampType()), ("source", S), ("event_type", S),
    ("action", S), ("outcome", S), ("host", S), ("user", S), ("session_id", S), ("process_name", S),
    ("process_id", L), ("parent_process_name", S), ("parent_process_id", L), ("command_line", S),
    ("file_path", S), ("file_hash", S), ("file_size", L), ("src_ip", S), ("src_port", I), ("dst_ip", S),
    ("dst_port", I), ("protocol", S), ("domain", S), ("url", S), ("bytes_in", L), ("bytes_out", L),
    ("geo_country", S), ("privilege", S), ("target_user", S), ("service_name", S), ("message", S),
    ("severity_hint", S), ("tags", T.ArrayType(S)), ("raw", T.VariantType()),
]
EVENT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in EVENT_FIELDS] + [T.StructField("seq", L)])
EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA.fields]
STRING_FIELDS = [n for n, t in EVENT_FIELDS if t == S]

DETECTION_COLUMNS = [
    "detection_id", "tenant_id", "kind", "rule_id", "title", "description", "severity", "score", "confidence",
    "techniques", "phase", "timestamp", "entities", "evidence_event_ids", "details",
]

IOC_SCHEMA = T.StructType([
    T.StructField("value", S), T.StructField("type", S), T.StructField("threat", S), T.StructField("source", S),
    T.StructField("confidence", D), T.StructField("severity", S), T.StructField("first_seen", S),
    T.StructField("tags", T.ArrayType(S)), T.StructField("reference", S), T.StructField("country", S),
])


def phase_label(phase: str) -> str:
    return phase.replace("_", " ").title().replace("And", "&")


def rank_of(values: list[str], column: Column) -> Column:
    """Position of a value in an ordered vocabulary (0-based), null when unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), column), F.lit(0)) - 1


def filled(column: Column) -> Column:
    """True when a string is neither null nor empty."""
    return F.coalesce(column != "", F.lit(False))


def blank_to_null(column: Column) -> Column:
    return F.when(column != "", column)


def micros(column: Column) -> Column:
    return F.unix_micros(column)


def seconds(value: float) -> int:
    """Seconds as microseconds."""
    return int(value * 1_000_000)


def digest_id(prefix: str, *parts: Column) -> Column:
    """Deterministic identifier from its parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 24))
