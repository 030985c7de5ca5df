"""Queries for normalisation: vendor records are rendered from the telemetry as JSON, then mapped back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightjar.operators import normalize as N
from nightjar.operators.events import deduplicate
from nightjar.plans.adapter import telemetry
from nightjar.plans.ingest import ingest_batch
from nightjar.plans.queries_intel import sample_iocs
from nightjar.plans.registry import part, register

_COLUMNS = ["seq", "source", "event_type", "action", "outcome", "host", "user", "process_name", "command_line", "src_ip", "dst_ip", "domain", "privilege", "protocol"]


def vendor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of four shapes without a collector name; ``k = 50`` carries an unreadable time, canonical rows
    an unknown source when ``k = 60``."""
    ev = telemetry(spark, sf_dir, keep_inputs=True)
    c, k = F.col, F.col("k")
    time = F.when(k == 50, "yesterday").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    windows = F.to_json(F.struct(
        F.when(c("action") == "login_success", 4624).when(c("action") == "login_failure", 4625).otherwise(9999).alias("EventID"), c("host").alias("Computer"), time.alias("TimeCreated"),
        F.struct(c("user").alias("TargetUserName"), c("src_ip").alias("IpAddress"), (k % 12).alias("LogonType"), F.lit("NTLM").alias("AuthenticationPackageName")).alias("EventData")))
    conn = F.to_json(F.struct(time.alias("ts"), F.coalesce("src_ip", F.lit("10.9.9.9")).alias("id.orig_h"), c("dst_ip").alias("id.resp_h"), c("dst_port").alias("id.resp_p"), F.when(k % 2 == 0, c("bytes_out")).otherwise(0).alias("orig_bytes"),
                              F.when(k % 3 == 0, "SF").when(k % 3 == 1, "REJ").alias("conn_state"), F.lit("tcp").alias("proto")))
    dns = F.to_json(F.struct(time.alias("ts"), F.lit("10.9.9.8").alias("id.orig_h"), c("domain").alias("query"), F.when(c("outcome") == "nxdomain", "nxdomain").otherwise("").alias("rcode_name"), F.array("dst_ip").alias("answers"), c("protocol").alias("qtype_name")))
    linux = F.to_json(F.struct(F.when(k % 4 == 0, "SUDO").otherwise("execve").alias("type"), c("host").alias("hostname"), c("user").alias("acct"), F.concat(F.lit("/usr/bin/"), "process_name").alias("exe"),
                               c("command_line").alias("proctitle"), time.alias("timestamp"), F.when(k % 8 == 0, "failed").otherwise("success").alias("res")))
    generic = F.to_json(F.struct(F.when(k == 60, "nowhere").otherwise("edr").alias("source"), c("event_type"), c("action"), c("host"), c("user"), time.alias("timestamp"), k.alias("odd_field")))
    kind = c("event_type")
    text = F.when(kind == "authentication", windows).when(kind == "network_connection", conn).when(kind == "dns_query", dns).when(kind.isin("process_start", "process_end"), linux).otherwise(generic)
    return ev.select("seq", F.parse_json(text).alias("raw"))


_LOGON = "CASE k % 12 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in N.LOGON_TYPES.items()) + " END"
part("vendor", f"""
SELECT seq, k, ts_us, 'windows' AS source, 'authentication' AS event_type, action, CASE WHEN action = 'login_success' THEN 'success' ELSE 'failure' END AS outcome, host, "user", NULL AS process_name, NULL AS command_line, src_ip, NULL AS dst_ip,
  NULL AS domain, {_LOGON} AS privilege, 'ntlm' AS protocol FROM ev WHERE event_type = 'authentication'
UNION ALL SELECT seq, k, ts_us, 'network', event_type, 'connect', CASE WHEN k % 3 = 1 THEN 'failure' ELSE 'success' END, NULL, NULL, NULL, NULL, coalesce(src_ip, '10.9.9.9'), dst_ip, NULL, NULL, 'tcp' FROM ev WHERE event_type = 'network_connection'
UNION ALL SELECT seq, k, ts_us, 'dns', event_type, 'query', CASE WHEN outcome = 'nxdomain' THEN 'nxdomain' ELSE 'success' END, NULL, NULL, NULL, NULL, '10.9.9.8', dst_ip, domain, NULL, protocol FROM ev WHERE event_type = 'dns_query'
UNION ALL SELECT seq, k, ts_us, 'linux', CASE WHEN k % 4 = 0 THEN 'privilege_change' ELSE 'process_start' END, CASE WHEN k % 8 = 0 THEN 'sudo_failure' WHEN k % 4 = 0 THEN 'sudo_success' ELSE 'start' END, NULL, host, "user", process_name,
  nullif(command_line, ''), NULL, NULL, NULL, CASE WHEN k % 4 = 0 THEN 'root' END, NULL FROM ev WHERE event_type IN ('process_start', 'process_end')
UNION ALL SELECT seq, k, ts_us, CASE WHEN k = 60 THEN 'nowhere' ELSE 'edr' END, event_type, action, NULL, host, "user", NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ev WHERE event_type NOT IN ('authentication', 'network_connection', 'dns_query', 'process_start', 'process_end')""", "ev")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.normalize(vendor_records(spark, sf_dir))


def _adapter(*sources: str):
    return lambda spark, sf_dir: normalized(spark, sf_dir).where(F.col("source").isin(list(sources))).select(*_COLUMNS, F.coalesce(F.unix_micros("timestamp").cast("string"), F.lit("none")).alias("ts"))


_LIST = ", ".join(f'"{c}"' for c in _COLUMNS) + ", CASE WHEN k = 50 THEN 'none' ELSE CAST(ts_us AS VARCHAR) END AS ts"
for _name, _sources in {"normalize_windows": ["windows"], "normalize_linux": ["linux"], "normalize_zeek_conn": ["network"], "normalize_dns": ["dns"], "normalize_generic": ["edr", "nowhere"]}.items():
    register(_name, _adapter(*_sources), f"SELECT {_LIST} FROM vendor WHERE source IN ({', '.join(repr(s) for s in _sources)})", "vendor")
register("normalize_bytes", lambda s, d: normalized(s, d).where(F.col("event_type") == "network_connection").select("seq", F.coalesce(F.col("bytes_out").cast("string"), F.lit("none")).alias("bytes_out"), F.col("dst_port").cast("string").alias("dst_port")),
         "SELECT seq, CASE WHEN k % 2 = 0 AND bytes_out <> 0 THEN CAST(bytes_out AS VARCHAR) ELSE 'none' END AS bytes_out, CAST(dst_port AS VARCHAR) AS dst_port FROM ev WHERE event_type = 'network_connection'", "ev")
register("normalize_route", lambda s, d: normalized(s, d).groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("n")), "SELECT source, event_type, count(*) AS n FROM vendor GROUP BY ALL", "vendor")
register("validate", lambda s, d: N.with_violations(normalized(s, d)).where(F.size("violations") > 0).select("seq", F.array_join("violations", "; ").alias("violations")), """
SELECT seq, concat_ws('; ', CASE WHEN k = 50 THEN 'timestamp missing or unreadable' END, CASE WHEN source = 'nowhere' THEN 'unknown source' END) AS violations FROM vendor WHERE k = 50 OR source = 'nowhere'""", "vendor")
register("ingest_counts", lambda s, d: deduplicate(N.validate(normalized(s, d))[0]).groupBy("source").agg(F.count(F.lit(1)).alias("kept")), """
SELECT source, count(*) AS kept FROM (SELECT DISTINCT ts_us, source, event_type, action, host, "user", process_name, command_line, dst_ip, domain FROM vendor WHERE k <> 50 AND source <> 'nowhere') GROUP BY source""", "vendor")


_IDS = list(N.WINDOWS_EVENTS)
_KINDS = [k for kinds in N.LINUX_KINDS.values() for k in kinds] + ["daemon_start"]


def all_windows_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event id in turn: hexadecimal process ids, hash lists, epoch times, script blocks, access to lsass."""
    ev, c = telemetry(spark, sf_dir, keep_inputs=True), F.col
    target = F.when(c("seq") % 3 == 0, "C:\\Windows\\System32\\lsass.exe").otherwise("C:\\a\\b.exe")
    data = F.struct(
        F.lit("C:\\Tools\\Agent.exe").alias("Image"), target.alias("TargetImage"), F.when(c("seq") % 2 == 0, "0x1010").otherwise("0x1000").alias("GrantedAccess"),
        F.concat(F.lit("0x"), F.hex("seq")).alias("NewProcessId"), F.concat(F.lit("MD5=AA,SHA256="), F.upper(F.sha2("event_id", 256)), F.lit(",IMPHASH=0")).alias("Hashes"),
        F.lit("run.exe /x").alias("CommandLine"), F.lit("Get-Item .").alias("ScriptBlockText"), c("user").alias("TargetUserName"))
    raw = F.to_json(F.struct(F.element_at(F.array(*[F.lit(i) for i in _IDS]), (c("seq") % len(_IDS) + 1).cast("int")).alias("EventID"), c("host").alias("Computer"),
                             F.floor(F.unix_micros("timestamp") / 1_000_000).alias("TimeCreated"), data.alias("EventData")))
    out = N.normalize(ev.select("seq", F.parse_json(raw).alias("raw")))
    return out.select("seq", "event_type", "action", "outcome", "process_name", "process_id", "command_line", "file_hash", "target_user", F.array_join("tags", ",").alias("tags"), F.unix_micros("timestamp").alias("ts_us"))


_ID_ROWS = ", ".join(f"({n}, {i}, '{t}', '{a}')" for n, (i, (t, a)) in enumerate(N.WINDOWS_EVENTS.items()))
register("normalize_windows_ids", all_windows_ids, f"""
SELECT seq, m.event_type, m.action, CASE WHEN id IN (4624, 4688, 4720) THEN 'success' WHEN id = 4625 THEN 'failure' END AS outcome, 'Agent.exe' AS process_name, seq AS process_id,
  CASE WHEN id IN ({', '.join(map(str, N.SCRIPT_BLOCK_IDS))}) THEN 'Get-Item .' ELSE 'run.exe /x' END AS command_line, sha256(event_id) AS file_hash, CASE WHEN id IN (4720, 4726) THEN "user" END AS target_user,
  concat_ws(',', CASE WHEN id = 10 AND seq % 3 = 0 THEN 'lsass_access' END, CASE WHEN id = 10 AND seq % 3 = 0 AND seq % 2 = 0 THEN 'suspicious_access' END, CASE WHEN id = 8 THEN 'remote_thread' END,
    CASE WHEN id = 8 AND seq % 3 = 0 THEN 'lsass_inject' END) AS tags, ts_us // 1000000 * 1000000 AS ts_us
FROM ev JOIN (VALUES {_ID_ROWS}) m(n, id, event_type, action) ON m.n = seq % {len(_IDS)}""", "ev")


def all_linux_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every auditd record kind in turn, and one that maps to nothing."""
    ev, c = telemetry(spark, sf_dir), F.col
    kind = F.element_at(F.array(*[F.lit(k.upper()) for k in _KINDS]), (c("seq") % len(_KINDS) + 1).cast("int"))
    raw = F.to_json(F.struct(kind.alias("type"), c("host").alias("hostname"), F.when(c("seq") % 2 == 0, "success").otherwise("failed").alias("res"), F.lit("/usr/bin/tool").alias("exe"),
                             F.when(c("seq") % 5 == 0, "0").otherwise("1000").alias("uid"), c("seq").alias("pid"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")))
    out = N.normalize(ev.select("seq", F.parse_json(raw).alias("raw")), "auditd")
    return out.select("seq", "source", "event_type", "action", "process_name", "process_id", "privilege", F.unix_micros("timestamp").alias("ts_us"))


_KIND_ROWS = ", ".join(f"({n}, '{k}', '{next((t for t, ks in N.LINUX_KINDS.items() if k in ks), 'system_log')}')" for n, k in enumerate(_KINDS))
register("normalize_linux_kinds", all_linux_kinds, f"""
SELECT seq, 'linux' AS source, t AS event_type, CASE t WHEN 'authentication' THEN CASE WHEN seq % 2 = 0 THEN 'login_success' ELSE 'login_failure' END WHEN 'process_start' THEN 'start' WHEN 'file_modify' THEN 'modify'
  WHEN 'network_connection' THEN 'connect' WHEN 'privilege_change' THEN CASE WHEN seq % 2 = 0 THEN 'sudo_success' ELSE 'sudo_failure' END ELSE kind END AS action, 'tool' AS process_name, seq AS process_id,
  CASE WHEN seq % 5 = 0 OR t = 'privilege_change' THEN 'root' END AS privilege, ts_us FROM ev JOIN (VALUES {_KIND_ROWS}) m(n, kind, t) ON m.n = seq % {len(_KINDS)}""", "ev")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor records of all events through the whole batch: what was accepted, kept, detected and linked."""
    run = ingest_batch(vendor_records(spark, sf_dir), iocs=sample_iocs(spark, sf_dir))
    by_rule = run.detections.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("detections "), "rule_id").alias("what"), "n")
    by_kind = run.incidents.groupBy(F.substring_index("incident_id", "-", 1).alias("kind"), "severity").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(" ", F.lit("incidents"), "kind", "severity").alias("what"), "n")
    return run.counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("accepted", "kept", "deduplicated")]))).unionByName(by_rule).unionByName(by_kind)


register("ingest_batch", ingested)
