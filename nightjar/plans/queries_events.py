"""Queries over single events: conditions, identity, order, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightjar.functions.conditions import holds
from nightjar.functions.text import shannon_entropy
from nightjar.operators import events as E
from nightjar.plans.adapter import spread, telemetry
from nightjar.plans.registry import part, register

part("ip_num", """
SELECT ip, CASE WHEN regexp_full_match(ip, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')
  THEN CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
     + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) END AS num
FROM (SELECT dst_ip AS ip FROM ev WHERE dst_ip IS NOT NULL UNION SELECT src_ip FROM ev WHERE src_ip IS NOT NULL)""", "ev")
part("ips", """
SELECT ip, num, num IS NULL OR num BETWEEN 0 AND 16777215 OR num BETWEEN 167772160 AND 184549375 OR num BETWEEN 2130706432 AND 2147483647
  OR num BETWEEN 2851995648 AND 2852061183 OR num BETWEEN 2886729728 AND 2887778303 OR num BETWEEN 3221225472 AND 3221225727
  OR num BETWEEN 3221225984 AND 3221226239 OR num BETWEEN 3232235520 AND 3232301055 OR num BETWEEN 3323068416 AND 3323199487
  OR num BETWEEN 3325256704 AND 3325256959 OR num BETWEEN 3405803776 AND 3405804031 OR num >= 3758096384 AS is_private FROM ip_num""", "ip_num")

ENTROPY_SQL = """-list_sum([ (length({x}) - length(replace({x}, c, ''))) / CAST(length({x}) AS DOUBLE)
  * log2((length({x}) - length(replace({x}, c, ''))) / CAST(length({x}) AS DOUBLE)) for c in list_distinct(string_split({x}, '')) if c != ''])"""

# name -> (condition, SQL predicate over ev)
CONDITIONS: dict[str, tuple[dict, str]] = {
    "predicate_eq": ({"process_name": "POWERSHELL.EXE"}, "lower(process_name) = 'powershell.exe'"),
    "predicate_eq_number": ({"dst_port": 445}, "dst_port = 445"),
    "predicate_neq": ({"outcome": {"neq": "Success"}}, "outcome IS NULL OR lower(outcome) <> 'success'"),
    "predicate_in": ({"process_name": {"in": ["cmd.exe", "WINWORD.exe"]}}, "lower(process_name) IN ('cmd.exe', 'winword.exe')"),
    "predicate_not_in": ({"geo_country": {"not_in": ["in", "us"]}}, "geo_country IS NOT NULL AND lower(geo_country) NOT IN ('in', 'us')"),
    "predicate_regex": ({"command_line": {"regex": r"(?i)(^|\s)-(e|enc)\s+[a-z0-9]{20,}"}}, r"regexp_matches(command_line, '(?i)(^|\s)-(e|enc)\s+[a-z0-9]{20,}')"),
    "predicate_contains": ({"command_line": {"contains": ["SHADOWS", "curl"]}}, "contains(lower(command_line), 'shadows') OR contains(lower(command_line), 'curl')"),
    "predicate_contains_tags": ({"tags": {"contains": "lsass"}}, "contains(tags, 'lsass')"),
    "predicate_startswith": ({"host": {"startswith": ["WS-0", "db-"]}}, "starts_with(lower(host), 'ws-0') OR starts_with(lower(host), 'db-')"),
    "predicate_endswith": ({"domain": {"endswith": ["mega.nz", ".corp"]}}, "ends_with(lower(domain), 'mega.nz') OR ends_with(lower(domain), '.corp')"),
    "predicate_gte_lt": ({"bytes_out": {"gte": 5_000_000, "lt": 9_000_000}}, "bytes_out >= 5000000 AND bytes_out < 9000000"),
    "predicate_gt_lte": ({"file_size": {"gt": 10_000_000, "lte": 50_000_000}}, "file_size > 10000000 AND file_size <= 50000000"),
    "predicate_number_in_text": ({"session_id": {"gte": 1}}, "try_cast(session_id AS DOUBLE) >= 1"),
    "predicate_exists": ({"command_line": {"exists": True}}, "command_line IS NOT NULL AND command_line <> ''"),
    "predicate_missing": ({"event_type": "process_start", "command_line": {"exists": False}}, "event_type = 'process_start' AND (command_line IS NULL OR command_line = '')"),
    "predicate_private": ({"dst_ip": {"private": True}}, "dst_ip IN (SELECT ip FROM ips WHERE is_private)"),
    "predicate_public": ({"dst_ip": {"private": False}}, "dst_ip IN (SELECT ip FROM ips WHERE NOT is_private)"),
    "predicate_entropy": ({"domain": {"entropy_gte": 3.5}}, ENTROPY_SQL.format(x="split_part(domain, '.', 1)") + " >= 3.5"),
    "predicate_length": ({"domain": {"len_gte": 30}}, "length(domain) >= 30"),
    "predicate_any_of": ({"event_type": "authentication", "any_of": [{"geo_country": "RU"}, {"privilege": "rdp"}]},
                         "event_type = 'authentication' AND (lower(geo_country) = 'ru' OR lower(privilege) = 'rdp')"),
    "predicate_not": ({"event_type": "network_connection", "not": {"domain": {"endswith": ["google.com"]}}},
                      "event_type = 'network_connection' AND NOT coalesce(ends_with(lower(domain), 'google.com'), false)"),
}


def _condition_query(spec: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = telemetry(spark, sf_dir)
        return ev.where(holds(ev, spec)).select("event_id", "seq")
    return run


for _name, (_spec, _sql) in CONDITIONS.items():
    register(_name, _condition_query(_spec), f"SELECT event_id, seq FROM ev WHERE coalesce({_sql}, false)", "ips")


def entropy_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy over whole documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", F.round(shannon_entropy(F.col("text"), long_texts=True), 6).alias("entropy"))


register("document_entropy", entropy_of_texts, f"SELECT doc_id, round({ENTROPY_SQL.format(x='text')}, 6) AS entropy FROM documents")


# -------------------------------------------------------------------------------------- identity
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("event_id", E.fingerprint().alias("fingerprint"))


ISO_SQL = """strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_us % 1000000 <> 0 THEN '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'"""
FINGERPRINT_SQL = "substr(sha256(" + " || '|' || ".join(
    [ISO_SQL if f == "timestamp" else f'coalesce("{f}", \'None\')' for f in E.FINGERPRINT_FIELDS]) + "), 1, 24)"
register("fingerprint", fingerprints, f"SELECT event_id, {FINGERPRINT_SQL} AS fingerprint FROM ev", "ev")


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry where each login is delivered twice and times are cut to the hour, so that copies occur."""
    ev = telemetry(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    return ev.unionByName(ev.where(F.col("event_type") == "authentication").withColumn("seq", F.col("seq") + 1_000_000_000))


part("doubled", f"""SELECT seq, event_id, {FINGERPRINT_SQL} AS fingerprint FROM (
  SELECT * REPLACE (date_trunc('hour', "timestamp") AS "timestamp", epoch_us(date_trunc('hour', "timestamp")) AS ts_us) FROM ev
  UNION ALL SELECT * REPLACE (date_trunc('hour', "timestamp") AS "timestamp", epoch_us(date_trunc('hour', "timestamp")) AS ts_us, seq + 1000000000 AS seq)
  FROM ev WHERE event_type = 'authentication')""", "ev")
register("deduplicate", lambda s, d: E.deduplicate(_doubled(s, d)).select("event_id", "seq"),
         "SELECT event_id, seq FROM doubled QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1", "doubled")
register("duplicate_counts", lambda s, d: E.count_duplicates(_doubled(s, d)),
         "SELECT count(DISTINCT fingerprint) AS kept, count(*) - count(DISTINCT fingerprint) AS dropped FROM doubled", "doubled")
register("event_entity_keys", lambda s, d: telemetry(s, d).select("event_id", F.explode(E.event_entity_keys()).alias("entity")), """
SELECT event_id, 'user:' || lower("user") AS entity FROM ev WHERE "user" <> '' UNION ALL SELECT event_id, 'host:' || upper(host) FROM ev WHERE host <> ''
UNION ALL SELECT event_id, 'session:' || session_id FROM ev WHERE session_id <> ''
UNION ALL SELECT event_id, 'ip:' || dst_ip FROM ev WHERE dst_ip <> '' AND NOT regexp_matches(dst_ip, '^(10\\.|192\\.168\\.|172\\.16\\.)')""", "ev")
SUMMARY_SQL = """concat_ws(' ', strftime("timestamp", '%H:%M:%S'), event_type, action, 'user=' || nullif("user", ''), 'host=' || nullif(host, ''),
  'proc=' || nullif(process_name, ''), 'dst=' || nullif(dst_ip, '') || ':' || CASE WHEN coalesce(dst_port, 0) <> 0 THEN CAST(dst_port AS VARCHAR) ELSE '' END,
  'domain=' || nullif(domain, ''), 'file=' || nullif(file_path, ''), CASE WHEN coalesce(bytes_out, 0) <> 0 THEN 'out=' || CAST(bytes_out AS VARCHAR) || 'B' END)"""
register("event_summary", lambda s, d: telemetry(s, d).select("event_id", E.event_summary().alias("summary")), f"SELECT event_id, {SUMMARY_SQL} AS summary FROM ev", "ev")
register("order_events", lambda s, d: E.order_events(telemetry(s, d)).select("event_id", F.unix_micros("timestamp").alias("ts_us"), "seq"),
         "SELECT event_id, ts_us, seq FROM ev ORDER BY ts_us, seq", "ev")
