"""Vendor records -> canonical events, all as column expressions over a parsed ``raw`` variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from nightjar.functions.text import base_name
from nightjar.schema import EVENT_FIELDS, EVENT_TYPES, MAX_STRING, SEVERITIES, SOURCES, STRING_FIELDS, digest_id

# --- fixed values -------------------------------------------------------------------------------
# Windows and Sysmon event ids -> (event type, action).
WINDOWS_EVENTS = {
    4624: ("authentication", "login_success"), 4625: ("authentication", "login_failure"), 4634: ("authentication", "logoff"),
    4648: ("authentication", "explicit_credentials"), 4672: ("privilege_change", "special_privileges_assigned"),
    4688: ("process_start", "start"), 4689: ("process_end", "end"), 4720: ("user_created", "created"), 4726: ("user_deleted", "deleted"),
    4728: ("group_change", "member_added"), 4732: ("group_change", "member_added"), 4756: ("group_change", "member_added"),
    4698: ("scheduled_task", "created"), 7045: ("service_started", "installed"), 1102: ("security_alert", "audit_log_cleared"),
    4662: ("security_alert", "directory_object_access"), 1: ("process_start", "start"), 3: ("network_connection", "connect"),
    8: ("process_access", "remote_thread"), 10: ("process_access", "process_access"), 11: ("file_create", "create"),
    12: ("registry_change", "key_change"), 13: ("registry_change", "set_value"), 22: ("dns_query", "query"),
    5156: ("network_connection", "connect"), 5158: ("network_connection", "bind"), 4104: ("process_start", "script_block"),
    4103: ("process_start", "script_block"), 800: ("process_start", "script_block"), 4663: ("file_read", "object_access"),
}
SCRIPT_BLOCK_IDS = [800, 4103, 4104]
SUSPECT_MASKS = ["0x1010", "0x1410", "0x1438", "0x143a", "0x1fffff", "0x1f1fff", "0x1f3fff"]
LOGON_TYPES = {2: "interactive", 3: "network", 4: "batch", 5: "service", 7: "unlock", 8: "network_cleartext", 9: "new_credentials", 10: "rdp", 11: "cached"}
OK_STATES = ["SF", "S1", "S2", "S3", "RSTO"]
FAILED_CODES = ["NXDOMAIN", "3", "FAILURE"]
COLLECTORS = {"windows": "windows", "sysmon": "windows", "linux": "linux", "auditd": "linux", "zeek": "zeek", "zeek_conn": "zeek", "netflow": "zeek", "dns": "dns", "zeek_dns": "dns"}
LINUX_KINDS = {
    "authentication": ["user_login", "user_auth", "cred_acq", "sshd_login"], "process_start": ["execve", "syscall", "proctitle", "process"],
    "file_modify": ["path", "file"], "network_connection": ["sockaddr", "connect", "network"], "privilege_change": ["user_cmd", "sudo"],
}
# ------------------------------------------------------------------------------------------------
FALSY = ["null", "false", "0", "0.0", '""', "[]", "{}"]
FALSY_LENGTH = max(len(f) for f in FALSY)


class Texts:
    """Top-level values of a record as two map columns: all of them as text, and only the usable ones."""

    def __init__(self, name: str):
        self.name = name

    @property
    def every(self) -> Column:
        return F.col(f"{self.name}_every")

    @property
    def usable(self) -> Column:
        return F.col(f"{self.name}_usable")


def with_texts(df: DataFrame, name: str, record: Column) -> DataFrame:
    """Decode a variant once per row. Empty text, zero, false and empty containers are not usable; as text they are short."""
    fields, every = F.col(f"{name}_fields"), F.col(f"{name}_every")
    text = lambda v: F.try_variant_get(v, "$", "string")
    df = df.withColumn(f"{name}_fields", F.try_variant_get(record, "$", "map<string,variant>")).withColumn(f"{name}_every", F.transform_values(fields, lambda _, v: text(v)))
    usable = F.map_filter(every, lambda k, t: t.isNotNull() & ((F.length(t) > FALSY_LENGTH) | ~F.to_json(F.try_element_at(fields, k)).isin(FALSY)))
    return df.withColumn(f"{name}_usable", usable).drop(f"{name}_fields")


REC, DATA = Texts("rec"), Texts("data")


def has_key(record: Texts, key: str) -> Column:
    return F.coalesce(F.map_contains_key(record.every, key), F.lit(False))


def get_text(record: Texts, key: str) -> Column:
    return F.try_element_at(record.every, F.lit(key))


def truthy_text(record: Texts, key: str) -> Column:
    return F.try_element_at(record.usable, F.lit(key))


def pick(record: Texts, *keys: str) -> Column:
    """First usable value in order."""
    return F.coalesce(*[truthy_text(record, k) for k in keys])


def to_long(text: Column) -> Column:
    """Integer text, also ``0x`` hexadecimal; anything else is missing."""
    t = F.trim(text)
    hexadecimal = F.lower(t).rlike(r"^0x[0-9a-f]{1,15}$")
    return F.when(hexadecimal, F.conv(F.substring(t, 3, 20), 16, 10).try_cast("bigint")).when(t.rlike(r"^[+-]?[0-9]{1,18}$"), t.try_cast("bigint")) \
        .when(t.rlike(r"^[+-]?[0-9]+\.[0-9]+$"), t.try_cast("double").try_cast("bigint"))


def to_time(text: Column) -> Column:
    """Epoch seconds or ISO text; unparsable time stays missing and ends in quarantine."""
    number = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.coalesce(F.timestamp_micros(F.round(number * 1_000_000).cast("bigint")), F.try_to_timestamp(text))


def pick_hash(text: Column) -> Column:
    """SHA-256 of a ``NAME=value`` list, else the value after the last ``=``."""
    sha = F.nullif(F.regexp_extract(text, r"(?i)(?:^|,)SHA256=([^,]*)", 1), F.lit(""))
    return F.lower(F.coalesce(sha, F.element_at(F.split(text, "="), -1)))


def _map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def _assemble(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Full canonical row; fields an adapter leaves out are null."""
    return df.select(*[_field(name, dtype, columns).alias(name) for name, dtype in EVENT_FIELDS], "seq")


def _field(name: str, dtype: T.DataType, columns: dict[str, Column]) -> Column:
    value = columns.get(name, F.lit(None).cast(dtype))
    return value if name in ("raw", "tags", "timestamp") else value.cast(dtype)


def _common(source: str) -> dict[str, Column]:
    return {"event_id": F.col("new_id"), "tenant_id": F.col("tenant"), "source": F.lit(source), "severity_hint": F.lit("info"),
            "tags": F.array().cast("array<string>"), "raw": F.col("raw")}


def _held(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, which keeps the optimiser from working out their columns again inside each later check
    and filter: a filter on one field would otherwise decode the whole record once per mention of a key."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def with_windows_data(df: DataFrame, is_windows: Column) -> DataFrame:
    """Texts of the nested part of Windows records, or of the record itself, and the event id; null for other records."""
    nested = F.try_variant_get(F.col("raw"), "$.EventData", "variant")
    data = F.coalesce(F.when(~F.to_json(nested).isin(FALSY), nested), F.col("raw"))
    df = with_texts(df, "data", F.when(is_windows, data))
    return df.withColumn("eid", F.when(is_windows, F.coalesce(to_long(pick(REC, "EventID", "event_id_win", "id")), F.lit(0))))


def windows_fields() -> dict[str, Column]:
    """Windows Security and Sysmon records, nested or flat; needs ``with_windows_data``."""
    rec, d, eid = REC, DATA, F.col("eid")
    known = F.try_element_at(_map_literal({k: f"{t}|{a}" for k, (t, a) in WINDOWS_EVENTS.items()}), eid.cast("int"))
    script = eid.isin(SCRIPT_BLOCK_IDS)
    process = base_name(pick(d, "NewProcessName", "Image", "SourceImage", "Application", "ProcessName"))
    target = F.lower(F.coalesce(truthy_text(d, "TargetImage"), F.lit("")))
    on_lsass = target.endswith("lsass.exe")
    tags = F.array_compact(F.array(
        F.when((eid == 10) & on_lsass, F.lit("lsass_access")),
        F.when((eid == 10) & on_lsass & F.lower(F.coalesce(truthy_text(d, "GrantedAccess"), F.lit(""))).isin(SUSPECT_MASKS), F.lit("suspicious_access")),
        F.when(eid == 8, F.lit("remote_thread")), F.when((eid == 8) & on_lsass, F.lit("lsass_inject"))))
    logon = F.try_element_at(_map_literal(LOGON_TYPES), to_long(get_text(d, "LogonType")).cast("int"))
    return _common("windows") | {
        "timestamp": to_time(F.coalesce(pick(rec, "TimeCreated", "timestamp", "@timestamp", "EventTime"), pick(d, "UtcTime"), pick(rec, "SystemTime"))),
        "event_type": F.coalesce(F.split(known, r"\|")[0], F.lit("system_log")),
        "action": F.coalesce(F.split(known, r"\|")[1], F.concat(F.lit("win_"), eid.cast("string"))),
        "outcome": F.when(eid.isin(4624, 4688, 4720), "success").when(eid == 4625, "failure"),
        "host": pick(rec, "Computer", "Hostname", "host", "hostname"), "user": pick(d, "TargetUserName", "SubjectUserName", "User"),
        "session_id": pick(d, "TargetLogonId", "LogonId"),
        "process_name": F.when(script, F.coalesce(process, F.lit("powershell.exe"))).otherwise(process),
        "process_id": to_long(pick(d, "NewProcessId", "ProcessId")), "parent_process_name": base_name(pick(d, "ParentProcessName", "ParentImage")),
        "command_line": F.when(script, pick(d, "ScriptBlockText", "Payload", "CommandLine", "ContextInfo", "Message")).otherwise(get_text(d, "CommandLine")),
        "file_path": pick(d, "TargetFilename", "TargetObject", "TargetImage", "ObjectName", "NewProcessName", "Image"),
        "file_hash": pick_hash(truthy_text(d, "Hashes")), "src_ip": pick(d, "IpAddress", "SourceIp", "SourceAddress"), "src_port": to_long(pick(d, "IpPort", "SourcePort")),
        "dst_ip": pick(d, "DestinationIp", "DestAddress"), "dst_port": to_long(pick(d, "DestinationPort", "DestPort")),
        "protocol": F.coalesce(truthy_text(d, "Protocol"), F.lower(truthy_text(d, "AuthenticationPackageName"))), "domain": get_text(d, "QueryName"),
        "privilege": F.when(get_text(d, "LogonType").isNotNull(), logon).otherwise(pick(d, "PrivilegeList", "TargetGroup", "GroupName")),
        "target_user": F.coalesce(truthy_text(d, "MemberName"), F.when(eid.isin(4720, 4726), get_text(d, "TargetUserName"))),
        "service_name": pick(d, "ServiceName", "TaskName"), "message": get_text(rec, "Message"), "tags": tags,
    }


def linux_fields() -> dict[str, Column]:
    """auditd records: logins, processes, files, network, privilege."""
    rec, kind = REC, F.lower(F.coalesce(pick(REC, "type", "event_type"), F.lit("")))

    def succeeded(*keys: str) -> Column:
        return F.lower(F.coalesce(*[get_text(rec, k) for k in keys], F.lit("success"))).isin("success", "1")

    event_type, action = F.lit("system_log"), F.coalesce(truthy_text(rec, "action"), F.nullif(kind, F.lit("")), F.lit("log"))
    verbs = {
        "authentication": F.when(succeeded("res", "result"), "login_success").otherwise("login_failure"), "process_start": F.lit("start"), "file_modify": F.lit("modify"),
        "network_connection": F.lit("connect"), "privilege_change": F.when(succeeded("res"), "sudo_success").otherwise("sudo_failure"),
    }
    for name, kinds in LINUX_KINDS.items():
        event_type = F.when(kind.isin(kinds), name).otherwise(event_type)
        action = F.when(kind.isin(kinds), verbs[name]).otherwise(action)
    root = get_text(rec, "uid").isin("0", "root") | kind.isin(LINUX_KINDS["privilege_change"])
    return _common("linux") | {
        "timestamp": to_time(pick(rec, "timestamp", "time")), "event_type": event_type, "action": action, "host": pick(rec, "hostname", "host"),
        "user": pick(rec, "acct", "auid_name", "user"), "process_name": base_name(pick(rec, "exe", "comm")), "process_id": to_long(get_text(rec, "pid")),
        "parent_process_id": to_long(get_text(rec, "ppid")), "command_line": pick(rec, "proctitle", "cmd", "command_line"), "file_path": pick(rec, "name", "path"),
        "src_ip": pick(rec, "addr", "src_ip"), "dst_ip": get_text(rec, "dst_ip"), "dst_port": to_long(get_text(rec, "dst_port")),
        "privilege": F.when(F.coalesce(root, F.lit(False)), "root").otherwise(get_text(rec, "privilege")), "message": pick(rec, "msg", "message"),
    }


def zeek_fields() -> dict[str, Column]:
    """Connection log."""
    rec = REC
    return _common("network") | {
        "timestamp": to_time(pick(rec, "ts", "timestamp")), "event_type": F.lit("network_connection"), "action": F.lit("connect"),
        "outcome": F.when(F.coalesce(get_text(rec, "conn_state"), F.lit("SF")).isin(OK_STATES), "success").otherwise("failure"), "host": pick(rec, "host", "orig_host"),
        "src_ip": pick(rec, "id.orig_h", "src_ip"), "src_port": to_long(pick(rec, "id.orig_p", "src_port")), "dst_ip": pick(rec, "id.resp_h", "dst_ip"),
        "dst_port": to_long(pick(rec, "id.resp_p", "dst_port")), "protocol": pick(rec, "proto", "service"),
        "bytes_out": to_long(pick(rec, "orig_bytes", "bytes_out")), "bytes_in": to_long(pick(rec, "resp_bytes", "bytes_in")),
    }


def dns_fields() -> dict[str, Column]:
    """DNS log."""
    rec = REC
    code = F.upper(F.coalesce(pick(rec, "rcode_name", "rcode", "outcome"), F.lit("NOERROR")))
    answers = F.try_variant_get(F.col("raw"), "$.answers", "array<string>")
    return _common("dns") | {
        "timestamp": to_time(pick(rec, "ts", "timestamp")), "event_type": F.lit("dns_query"), "action": F.lit("query"),
        "outcome": F.when(code.isin(FAILED_CODES), "nxdomain").otherwise("success"), "host": pick(rec, "host", "client_host"),
        "src_ip": pick(rec, "id.orig_h", "client_ip", "src_ip"), "domain": pick(rec, "query", "domain"), "protocol": pick(rec, "qtype_name", "qtype", "record_type"),
        "dst_ip": F.when(answers.isNotNull(), F.try_element_at(answers, F.lit(1))).otherwise(get_text(rec, "answer")),
    }


def generic_fields() -> dict[str, Column]:
    """Records close to the canonical shape; unknown fields stay in ``raw``."""
    rec, raw = REC, F.col("raw")
    columns: dict[str, Column] = {}
    for name, dtype in EVENT_FIELDS:
        if name == "timestamp":
            columns[name] = to_time(get_text(rec, name))
        elif name == "tags":
            columns[name] = F.coalesce(F.try_variant_get(raw, "$.tags", "array<string>"), F.array().cast("array<string>"))
        elif name == "raw":
            known = F.array(*[F.lit(n) for n, _ in EVENT_FIELDS])
            rest = F.map_filter(F.try_variant_get(raw, "$", "map<string,variant>"), lambda k, _: ~F.array_contains(known, k))
            columns[name] = F.coalesce(F.try_variant_get(raw, "$.raw", "variant"), F.parse_json(F.to_json(rest)))
        elif dtype.typeName() == "string":
            columns[name] = get_text(rec, name)
        else:
            columns[name] = to_long(get_text(rec, name)).cast(dtype)
    defaults = {"event_id": F.col("new_id"), "tenant_id": F.col("tenant"), "source": F.lit("application"), "event_type": F.lit("application_log"), "action": F.lit("log"), "severity_hint": F.lit("info")}
    for name, value in defaults.items():
        columns[name] = F.coalesce(columns[name], value)
    return columns


def route_column(collector: Column) -> Column:
    """Adapter of a record: by collector name, else by the keys it has, in a fixed order."""
    rec = REC
    named = F.try_element_at(_map_literal(COLLECTORS), F.lower(F.coalesce(F.nullif(collector, F.lit("")), pick(rec, "collector", "format"), F.lit(""))))
    return (
        F.when(named.isNotNull(), named).when(has_key(rec, "EventID") | has_key(rec, "Computer"), "windows")
        .when(has_key(rec, "id.orig_h") & has_key(rec, "query"), "dns").when(has_key(rec, "id.orig_h"), "zeek")
        .when(has_key(rec, "auid") | has_key(rec, "proctitle") | has_key(rec, "acct"), "linux").otherwise("generic")
    )


FIELDS = {"windows": windows_fields, "linux": linux_fields, "zeek": zeek_fields, "dns": dns_fields, "generic": generic_fields}


def _adapter(name: str):
    """One adapter by itself, for records that are known to be of its kind (columns of ``tagged`` and the texts ``rec``)."""
    def run(df: DataFrame) -> DataFrame:
        return _assemble(with_windows_data(df, F.lit(True)) if name == "windows" else df, FIELDS[name]())
    return run


normalize_windows, normalize_linux, normalize_zeek_conn, normalize_dns, normalize_generic = (_adapter(n) for n in FIELDS)


def normalize(records: DataFrame, collector: str | None = None, tenant: str = "default") -> DataFrame:
    """Canonical events of mixed records (columns ``raw`` variant and ``seq``), in one pass.

    Every field is one CASE over the routes, so records are read and taken apart once, whatever the number of adapters and of
    filters on the result.
    """
    tagged = records.select("raw", "seq", F.lit(tenant).alias("tenant"))
    routed = with_texts(tagged, "rec", F.col("raw")).withColumn("route", route_column(F.lit(collector) if collector else F.lit(None).cast("string")))
    routed = _held(with_windows_data(routed, F.col("route") == "windows"))
    routed = routed.withColumn("new_id", digest_id("evt_", F.lit(tenant), F.col("seq"), F.to_json("raw")))
    fields = {route: columns() for route, columns in FIELDS.items()}

    def chosen(name: str, dtype: T.DataType) -> Column:
        out = F.lit(None).cast(dtype)
        for route, columns in fields.items():
            if name in columns:
                out = F.when(F.col("route") == route, _field(name, dtype, columns)).otherwise(out)
        return out

    return routed.select(*[chosen(name, dtype).alias(name) for name, dtype in EVENT_FIELDS], "seq")


def with_violations(events: DataFrame) -> DataFrame:
    """Column ``violations``: why a row is not acceptable."""
    checks = [
        F.when(F.col("timestamp").isNull(), F.lit("timestamp missing or unreadable")),
        F.when(~F.coalesce(F.col("source").isin(SOURCES), F.lit(False)), F.lit("unknown source")),
        F.when(~F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(False)), F.lit("unknown event type")),
        F.when(~F.coalesce(F.col("severity_hint").isin(SEVERITIES), F.lit(False)), F.lit("unknown severity")),
        F.when(F.col("action").isNull(), F.lit("action missing")),
        *[F.when(F.length(c) > MAX_STRING, F.lit(f"{c} too long")) for c in STRING_FIELDS],
    ]
    return _held(events).withColumn("violations", F.array_compact(F.array(*checks)))


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine)."""
    checked = with_violations(events)
    good = checked.where(F.size("violations") == 0).drop("violations")
    return good, checked.where(F.size("violations") > 0)
