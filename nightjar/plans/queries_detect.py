"""Queries for stateful rules and statistical baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightjar.operators import baselines as B
from nightjar.operators import rules as R
from nightjar.operators.ordered import cooldown
from nightjar.plans.adapter import telemetry
from nightjar.plans.queries_events import ENTROPY_SQL
from nightjar.plans.registry import part, register
from nightjar.plans.rulepack import BUILT_IN_TECHNIQUES, RULES  # noqa: F401
from nightjar.schema import seconds

DAY = 86_400
FAILED = {"event_type": "authentication", "action": "login_failure"}
PASSED = {"event_type": "authentication", "action": "login_success"}


# --------------------------------------------------------------------------------------- cooldown
def failed_login_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed logins of a user at least one day apart."""
    rows = telemetry(spark, sf_dir).where((F.col("event_type") == "authentication") & (F.col("action") == "login_failure")).withColumn("ts_us", F.unix_micros("timestamp"))
    return cooldown(rows, ["tenant_id", "user"], seconds(DAY), ["event_id", "ts_us"])


def _recursive_cooldown(source: str, gap_us: int, columns: str, key: str = "gkey") -> str:
    """Greedy suppression as a recursive walk over the rows of each key; ``source`` yields gkey, ts_us, ord and columns."""
    return f"""WITH RECURSIVE src AS ({source}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts_us, ord) AS rn FROM src),
walk AS (
  SELECT {key}, rn, ts_us AS last_ts, true AS fires FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.{key}, r.rn, CASE WHEN r.ts_us - w.last_ts >= {gap_us} THEN r.ts_us ELSE w.last_ts END, r.ts_us - w.last_ts >= {gap_us}
  FROM walk w JOIN ranked r ON r.{key} = w.{key} AND r.rn = w.rn + 1)
SELECT {columns} FROM ranked JOIN walk USING ({key}, rn) WHERE fires"""


register("cooldown", failed_login_cooldown, _recursive_cooldown(
    """SELECT tenant_id || '|' || coalesce("user", '?') AS gkey, ts_us, seq AS ord, event_id FROM ev WHERE action = 'login_failure'""", seconds(DAY), "event_id, ts_us"), "ev")


def _flat(detections: DataFrame) -> DataFrame:
    return detections.select("rule_id", "tenant_id", F.unix_micros("timestamp").alias("ts_us"), F.array_join("evidence_event_ids", ",").alias("evidence"))


def _rule_query(*rules: R.RuleSpec):
    return lambda spark, sf_dir: _flat(R.run_rules(telemetry(spark, sf_dir), list(rules)))


MATCH_RULE = R.RuleSpec(id="Q-MATCH", title="Shell on a host", group_by=["host"], cooldown_seconds=DAY,
                        where={"event_type": "process_start", "process_name": {"in": ["powershell.exe", "cmd.exe"]}})
register("match_rule", _rule_query(MATCH_RULE), _recursive_cooldown(
    """SELECT tenant_id, tenant_id || '|' || lower(host) AS gkey, ts_us, seq AS ord, event_id FROM ev
    WHERE event_type = 'process_start' AND process_name IN ('powershell.exe', 'cmd.exe')""", seconds(DAY), "'Q-MATCH' AS rule_id, tenant_id, ts_us, event_id AS evidence"), "ev")


def _recursive_threshold(source: str, rule: str, window_us: int, need: int, gap_us: int, distinct: bool = False) -> str:
    """Sliding window that empties when it fires, as a recursive walk; ``source`` yields gkey, tenant_id, ts_us, ord, event_id, item."""
    live = f"list_append(list_filter(w.win, lambda x: x.ts >= r.ts_us - {window_us}), {{'ts': r.ts_us, 'id': r.event_id, 'item': r.item}})"
    size = "len(list_distinct([coalesce(x.item, '<none>') for x in live]))" if distinct else "len(live)"
    return f"""WITH RECURSIVE src AS ({source}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gkey ORDER BY ts_us, ord) AS rn FROM src),
walk AS (
  SELECT gkey, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(ts BIGINT, id VARCHAR, item VARCHAR)[]) AS win, CAST(NULL AS BIGINT) AS last_ts, CAST(NULL AS VARCHAR) AS evidence FROM ranked WHERE rn = 1
  UNION ALL
  SELECT gkey, rn, CASE WHEN {size} >= {need} THEN [] ELSE live END,
    CASE WHEN {size} >= {need} AND (last_ts IS NULL OR ts_us - last_ts >= {gap_us}) THEN ts_us ELSE last_ts END,
    CASE WHEN {size} >= {need} AND (last_ts IS NULL OR ts_us - last_ts >= {gap_us}) THEN array_to_string([x.id for x in live], ',') END
  FROM (SELECT r.gkey, r.rn, r.ts_us, w.last_ts, {live} AS live FROM walk w JOIN ranked r ON r.gkey = w.gkey AND r.rn = w.rn + 1))
SELECT '{rule}' AS rule_id, tenant_id, ts_us, evidence FROM ranked JOIN walk USING (gkey, rn) WHERE evidence IS NOT NULL"""


THRESHOLD_RULE = R.RuleSpec(id="Q-COUNT", title="Failures on a host", kind="threshold", group_by=["host"], window_seconds=7200, count_gte=3, cooldown_seconds=3600, where=FAILED)
register("threshold_rule", _rule_query(THRESHOLD_RULE), _recursive_threshold(
    "SELECT tenant_id, tenant_id || '|' || lower(host) AS gkey, ts_us, seq AS ord, event_id, '' AS item FROM ev WHERE action = 'login_failure'", "Q-COUNT", seconds(7200), 3, seconds(3600)), "ev")
DISTINCT_RULE = R.RuleSpec(id="Q-DISTINCT", title="Many accounts fail on a host", kind="threshold", group_by=["host"], window_seconds=4 * 3600, count_gte=4, cooldown_seconds=6 * 3600,
                           distinct="user", where=FAILED)
register("threshold_distinct", _rule_query(DISTINCT_RULE), _recursive_threshold(
    """SELECT tenant_id, tenant_id || '|' || lower(host) AS gkey, ts_us, seq AS ord, event_id, "user" AS item FROM ev WHERE action = 'login_failure'""",
    "Q-DISTINCT", seconds(4 * 3600), 4, seconds(6 * 3600), distinct=True), "ev")
BRUTE_FORCE = R.RuleSpec(id="Q-THEN", title="Guessing that succeeded", kind="threshold", group_by=["user"], window_seconds=3 * DAY, count_gte=3, cooldown_seconds=600, where=FAILED, then=PASSED,
                         techniques=["T1110.001", "T1078"], phase="credential_access", severity="high", score=55, confidence=0.92)


def _recursive_then(rule: str, window_us: int, need: int, gap_us: int) -> str:
    live = f"list_append(list_filter(w.win, lambda x: x.ts >= r.ts_us - {window_us}), {{'ts': r.ts_us, 'id': r.event_id}})"
    fires = f"(taken AND ts_us <= armed[1].ts + {window_us} AND (last_ts IS NULL OR ts_us - last_ts >= {gap_us}))"
    return f"""WITH RECURSIVE src AS (
  SELECT tenant_id, tenant_id || '|' || lower("user") AS gkey, ts_us, seq AS ord, event_id, action FROM ev WHERE action IN ('login_failure', 'login_success') AND "user" IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gkey ORDER BY ts_us, ord) AS rn FROM src),
walk AS (
  SELECT gkey, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(ts BIGINT, id VARCHAR)[]) AS win, CAST(NULL AS STRUCT(ts BIGINT, id VARCHAR)[]) AS armed, CAST(NULL AS BIGINT) AS last_ts, CAST(NULL AS VARCHAR) AS evidence
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT gkey, rn, CASE WHEN action = 'login_failure' THEN (CASE WHEN len(live) >= {need} THEN [] ELSE live END) ELSE win END,
    CASE WHEN taken THEN NULL WHEN action = 'login_failure' AND len(live) >= {need} THEN live ELSE armed END,
    CASE WHEN {fires} THEN ts_us ELSE last_ts END,
    CASE WHEN {fires} THEN array_to_string([x.id for x in armed], ',') || ',' || event_id END
  FROM (SELECT r.gkey, r.rn, r.ts_us, r.event_id, r.action, w.win, w.armed, w.last_ts, {live} AS live, (w.armed IS NOT NULL AND r.action = 'login_success') AS taken
        FROM walk w JOIN ranked r ON r.gkey = w.gkey AND r.rn = w.rn + 1))
SELECT '{rule}' AS rule_id, tenant_id, ts_us, evidence FROM ranked JOIN walk USING (gkey, rn) WHERE evidence IS NOT NULL"""


register("threshold_then", _rule_query(BRUTE_FORCE), _recursive_then("Q-THEN", seconds(3 * DAY), 3, seconds(600)), "ev")

SEQUENCE_RULE = R.RuleSpec(id="Q-SEQUENCE", title="Login, process, connection", kind="sequence", group_by=["host"], window_seconds=6 * 3600, cooldown_seconds=12 * 3600,
                           steps=[PASSED, {"event_type": "process_start"}, {"event_type": "network_connection", "dst_ip": {"private": False}}])
OVERLAP_RULE = R.RuleSpec(id="Q-OVERLAP", title="Steps that share events", kind="sequence", group_by=["user"], window_seconds=4 * DAY, cooldown_seconds=DAY,
                          steps=[{"event_type": "authentication"}, PASSED, {"event_type": "authentication"}])


def _recursive_sequence(source: str, rule: str, window_us: int, gap_us: int, steps: int) -> str:
    """Partial matches as a list per key; ``source`` yields gkey, tenant_id, ts_us, ord, event_id, mask."""
    last = steps - 1
    return f"""WITH RECURSIVE src AS ({source}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gkey ORDER BY ts_us, ord) AS rn FROM src WHERE mask > 0),
walk AS (
  SELECT gkey, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(f BIGINT, n INTEGER, ids VARCHAR)[]) AS open, CAST(NULL AS BIGINT) AS last_ts, CAST(NULL AS VARCHAR) AS evidence FROM ranked WHERE rn = 1
  UNION ALL
  SELECT gkey, rn,
    CASE WHEN len(full_) > 0 THEN [] ELSE list_concat(list_transform(live, lambda x: CASE WHEN (mask >> x.n) & 1 = 1 THEN {{'f': x.f, 'n': x.n + 1, 'ids': x.ids || ',' || event_id}} ELSE x END),
      CASE WHEN mask & 1 = 1 THEN [{{'f': ts_us, 'n': 1, 'ids': event_id}}] ELSE [] END) END,
    CASE WHEN len(full_) > 0 AND (last_ts IS NULL OR ts_us - last_ts >= {gap_us}) THEN ts_us ELSE last_ts END,
    CASE WHEN len(full_) > 0 AND (last_ts IS NULL OR ts_us - last_ts >= {gap_us}) THEN full_[1].ids || ',' || event_id END
  FROM (SELECT *, list_filter(live, lambda x: x.n = {last} AND (mask >> {last}) & 1 = 1) AS full_
        FROM (SELECT r.gkey, r.rn, r.ts_us, r.event_id, r.mask, w.last_ts, list_filter(w.open, lambda x: r.ts_us - x.f <= {window_us}) AS live
              FROM walk w JOIN ranked r ON r.gkey = w.gkey AND r.rn = w.rn + 1)))
SELECT '{rule}' AS rule_id, tenant_id, ts_us, evidence FROM ranked JOIN walk USING (gkey, rn) WHERE evidence IS NOT NULL"""


register("sequence_rule", _rule_query(SEQUENCE_RULE), _recursive_sequence(
    """SELECT tenant_id, tenant_id || '|' || lower(host) AS gkey, ts_us, seq AS ord, event_id, CASE WHEN action = 'login_success' THEN 1 ELSE 0 END + CASE WHEN event_type = 'process_start' THEN 2 ELSE 0 END
    + CASE WHEN event_type = 'network_connection' AND dst_ip IN (SELECT ip FROM ips WHERE NOT is_private) THEN 4 ELSE 0 END AS mask FROM ev""", "Q-SEQUENCE", seconds(6 * 3600), seconds(12 * 3600), 3), "ips")
register("sequence_overlap", _rule_query(OVERLAP_RULE), _recursive_sequence(
    """SELECT tenant_id, tenant_id || '|' || lower("user") AS gkey, ts_us, seq AS ord, event_id, CASE WHEN event_type = 'authentication' THEN 5 ELSE 0 END
    + CASE WHEN action = 'login_success' THEN 2 ELSE 0 END AS mask FROM ev WHERE "user" IS NOT NULL""", "Q-OVERLAP", seconds(4 * DAY), seconds(DAY), 3), "ev")


# ------------------------------------------------------------------------------ detections, counts
def brute_force_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full detection rows of the brute-force rule: entities are the first known values of the evidence."""
    d = R.run_rules(telemetry(spark, sf_dir), [BRUTE_FORCE])
    e = F.col("entities")
    return d.select("rule_id", "kind", "tenant_id", F.unix_micros("timestamp").alias("ts_us"), "severity", "score", "confidence", F.array_join("techniques", ",").alias("techniques"), "phase",
                    e["user"].alias("user"), e["host"].alias("host"), e["src_ip"].alias("src_ip"), e["dst_ip"].alias("dst_ip"), e["session"].alias("session"),
                    F.col("details")["count"].alias("n"), F.col("details")["followed_by"].alias("followed_by"), F.array_join("evidence_event_ids", ",").alias("evidence"))


_THEN_SQL = _recursive_then("Q-THEN", seconds(3 * DAY), 3, seconds(600))
register("emit_detection", brute_force_detections, _THEN_SQL.replace(
    "SELECT 'Q-THEN' AS rule_id, tenant_id, ts_us, evidence FROM", "fired AS (SELECT tenant_id, ts_us, evidence, string_split(evidence, ',') AS ids FROM", 1).replace(
    "FROM walk w JOIN ranked r ON r.gkey = w.gkey AND r.rn = w.rn + 1))\nfired", "FROM walk w JOIN ranked r ON r.gkey = w.gkey AND r.rn = w.rn + 1)),\nfired") + """),
parts AS (SELECT f.*, i.pos, e."user", e.host, e.src_ip, e.dst_ip, e.session_id FROM (SELECT *, unnest(ids) AS id, generate_subscripts(ids, 1) AS p0 FROM fired) f
    JOIN (SELECT evidence AS ev0, unnest(ids) AS id0, generate_subscripts(ids, 1) AS pos FROM fired) i ON i.ev0 = f.evidence AND i.id0 = f.id AND i.pos = f.p0 JOIN ev e ON e.event_id = f.id)
SELECT 'Q-THEN' AS rule_id, 'threshold' AS kind, tenant_id, ts_us, 'high' AS severity, 55.0 AS score, 0.92 AS confidence, 'T1110.001,T1078' AS techniques, 'credential_access' AS phase,
  arg_min("user", pos) FILTER ("user" <> '') AS "user", arg_min(host, pos) FILTER (host <> '') AS host, arg_min(src_ip, pos) FILTER (src_ip <> '') AS src_ip,
  arg_min(dst_ip, pos) FILTER (dst_ip <> '') AS dst_ip, arg_min(session_id, pos) FILTER (session_id <> '') AS session,
  CAST(max(pos) - 1 AS VARCHAR) AS n, 'login_success' AS followed_by, evidence FROM parts GROUP BY tenant_id, ts_us, evidence""", "ev")


def accounts_guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which accounts were brute-forced and then logged in?"""
    d = R.run_rules(telemetry(spark, sf_dir), [BRUTE_FORCE])
    return d.groupBy("tenant_id", F.lower(F.col("entities")["user"]).alias("account")).agg(
        F.count(F.lit(1)).alias("break_ins"), F.min(F.unix_micros("timestamp")).alias("first_ts_us")).orderBy(F.desc("break_ins"), "tenant_id", "account")


register("accounts_guessed", accounts_guessed, _THEN_SQL.replace("SELECT 'Q-THEN' AS rule_id, tenant_id, ts_us, evidence FROM", "SELECT tenant_id, split_part(gkey, '|', 2) AS account, count(*) AS break_ins, min(ts_us) AS first_ts_us FROM", 1)
         + " GROUP BY tenant_id, gkey", "ev")


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over all shipped rules: matching events per rule before any state."""
    ev = telemetry(spark, sf_dir)
    return R.hit_counts(R.scan_conditions(ev, RULES), RULES)


_NUMERIC = {"dst_port", "bytes_out", "file_size"}
_ABSENT = {"ObjectType", "Properties"}


def _quoted(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _matcher_sql(field: str, op: str, arg) -> str:
    """One matcher of a shipped rule as SQL over ``evp``."""
    if field in _ABSENT:
        return "false"
    col = f'"{field}"'
    if op == "private":
        return f"coalesce(dst_private = {str(arg).lower()}, false)"
    if op == "exists":
        return f"({col} IS {'NOT ' if arg else ''}NULL {'AND' if arg else 'OR'} {col} {'<>' if arg else '='} '')"
    values = arg if isinstance(arg, list) else [arg]
    if op in ("eq", "in", "not_in"):
        found = f"{col} IN ({', '.join(str(v) for v in values)})" if field in _NUMERIC else f"lower({col}) IN ({', '.join(_quoted(v.lower()) for v in values)})"
        return f"coalesce(NOT ({found}), false)" if op == "not_in" else f"coalesce({found}, false)"
    if op == "gte":
        return f"coalesce({col} >= {arg}, false)"
    how = {"regex": "regexp_matches({c}, {v})", "contains": "contains(lower({c}), {v})", "startswith": "starts_with(lower({c}), {v})", "endswith": "ends_with(lower({c}), {v})"}[op]
    return "(" + " OR ".join("coalesce(" + how.replace("{c}", col).replace("{v}", _quoted(v if op == "regex" else v.lower())) + ", false)" for v in values) + ")"


def condition_sql(spec: dict) -> str:
    terms = []
    for key, value in spec.items():
        if key == "any_of":
            terms.append("(" + " OR ".join(condition_sql(v) for v in value) + ")")
        elif key == "not":
            terms.append(f"NOT {condition_sql(value)}")
        else:
            terms += [_matcher_sql(key, op, arg) for op, arg in (value.items() if isinstance(value, dict) else [("eq", value)])]
    return "(" + " AND ".join(terms) + ")"


part("evp", "SELECT ev.*, ips.is_private AS dst_private FROM ev LEFT JOIN ips ON ips.ip = ev.dst_ip", "ips")
register("rule_scan", rule_hits, "\nUNION ALL ".join(
    f"SELECT '{r.id}' AS rule_id, count(*) FILTER ({' OR '.join(condition_sql(c) for c in r.conditions)}) AS hits FROM evp" for r in RULES), "evp")
register("rule_pack", lambda s, d: _flat(R.run_rules(telemetry(s, d), RULES)))


def all_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = telemetry(spark, sf_dir)
    return R.union_detections(R.run_rules(ev, RULES), *B.run_baselines(ev))


register("union_detections", lambda s, d: R.fired_counts(all_detections(s, d)))


# -------------------------------------------------------------------------------------- baselines
def _anomalies(detections: DataFrame, *details: str) -> DataFrame:
    return detections.select(F.element_at("evidence_event_ids", 1).alias("event_id"), "rule_id", "score", "severity", "confidence", F.col("phase"),
                             *[F.col("details")[n].alias(n) for n in details])


part("logins", """SELECT *, lower("user") AS user_key, CAST(extract(hour FROM "timestamp") AS INTEGER) AS hr,
  row_number() OVER (PARTITION BY tenant_id, lower("user") ORDER BY ts_us, seq) - 1 AS earlier FROM ev WHERE action = 'login_success' AND "user" <> ''""", "ev")
_HIST = ", ".join(f"count(*) FILTER (o.hr = {h}) AS h{h}" for h in range(24))
register("anomaly_login_hour", lambda s, d: _anomalies(B.anomaly_login_hour(telemetry(s, d)), "hour", "history", "peak_hour"), f"""
WITH hist AS (SELECT l.event_id, l.hr, count(o.event_id) AS total, {_HIST} FROM logins l JOIN logins o
    ON o.tenant_id = l.tenant_id AND o.user_key = l.user_key AND o.earlier < l.earlier GROUP BY l.event_id, l.hr),
arr AS (SELECT event_id, hr, total, [{", ".join(f"h{h}" for h in range(24))}] AS h FROM hist),
sh AS (SELECT *, (0.5 * h[(hr + 23) % 24 + 1] + h[hr + 1] + 0.5 * h[(hr + 1) % 24 + 1]) / (2.0 * total) AS share FROM arr WHERE total >= 12)
SELECT event_id, 'ANOM-LOGIN-HOUR' AS rule_id, round(25 + 20 * (1 - share / 0.03), 1) AS score, 'medium' AS severity, 0.7 AS confidence, 'initial_access' AS phase,
  CAST(hr AS VARCHAR) AS hour, CAST(total AS VARCHAR) AS history, CAST(list_position(h, list_max(h)) - 1 AS VARCHAR) AS peak_hour FROM sh WHERE share < 0.03""", "logins")
register("anomaly_first_seen_location", lambda s, d: _anomalies(B.anomaly_first_seen_location(telemetry(s, d)), "new_country", "new_ip"), """
WITH marked AS (SELECT *, geo_country <> '' AND row_number() OVER (PARTITION BY tenant_id, user_key, geo_country ORDER BY ts_us, seq) = 1 AS new_c,
    src_ip IN (SELECT ip FROM ips WHERE NOT is_private) AND row_number() OVER (PARTITION BY tenant_id, user_key, src_ip ORDER BY ts_us, seq) = 1 AS new_i FROM logins)
SELECT event_id, 'ANOM-LOGIN-LOCATION' AS rule_id, CASE WHEN coalesce(new_c, false) THEN 45.0 ELSE 30.0 END AS score, 'medium' AS severity, 0.75 AS confidence, 'initial_access' AS phase,
  CASE WHEN new_c THEN geo_country END AS new_country, CASE WHEN new_i THEN src_ip END AS new_ip FROM marked WHERE earlier >= 5 AND (coalesce(new_c, false) OR coalesce(new_i, false))""", "logins", "ips")
_SANCTIONED = "|".join(d.replace(".", "\\.") for d in B.SANCTIONED_UPLOAD_DOMAINS)
register("anomaly_egress_volume", lambda s, d: _anomalies(B.anomaly_egress_volume(telemetry(s, d)), "z_score", "baseline_median_bytes"), f"""
WITH x AS (SELECT *, upper(host) AS hk, ln(1 + bytes_out) AS lx, row_number() OVER (PARTITION BY tenant_id, upper(host) ORDER BY ts_us, seq) - 1 AS n,
    coalesce(regexp_matches(lower(domain), '({_SANCTIONED})$'), false) AS sanctioned FROM ev WHERE event_type = 'network_connection' AND bytes_out <> 0 AND host <> ''),
past AS (SELECT *, list(lx) OVER (PARTITION BY tenant_id, hk ORDER BY ts_us, seq ROWS BETWEEN 2000 PRECEDING AND 1 PRECEDING) AS h FROM x),
m AS (SELECT *, list_median(h) AS med FROM past WHERE n >= 20 AND NOT sanctioned AND dst_ip IN (SELECT ip FROM ips WHERE NOT is_private)),
d AS (SELECT *, list_median([abs(v - med) for v in h]) AS mad FROM m),
z AS (SELECT *, 0.6745 * (lx - med) / CASE WHEN mad = 0 THEN 0.35 ELSE mad END AS zz FROM d)
SELECT event_id, 'ANOM-EGRESS-VOLUME' AS rule_id, round(least(70.0, 35 + 6.0 * (zz - 3.5)), 1) AS score, 'high' AS severity, 0.8 AS confidence, 'exfiltration' AS phase,
  CAST(round(zz, 2) AS VARCHAR) AS z_score, CAST(CAST(floor(exp(med) - 1) AS BIGINT) AS VARCHAR) AS baseline_median_bytes FROM z WHERE zz >= 3.5""", "ips")
register("anomaly_rare_process", lambda s, d: _anomalies(B.anomaly_rare_process(telemetry(s, d)), "org_hosts", "parent"), """
WITH p AS (SELECT *, upper(host) AS hk, lower(process_name) AS pk, row_number() OVER (PARTITION BY tenant_id, upper(host) ORDER BY ts_us, seq) - 1 AS n,
    row_number() OVER (PARTITION BY tenant_id, upper(host), lower(process_name) ORDER BY ts_us, seq) AS nth FROM ev WHERE event_type = 'process_start' AND host <> '' AND process_name <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, pk ORDER BY ts_us, seq) - 1 AS org FROM p WHERE nth = 1)
SELECT event_id, 'ANOM-RARE-PROCESS' AS rule_id, CASE WHEN lower(parent_process_name) IN ('winword.exe', 'excel.exe', 'outlook.exe', 'powerpnt.exe', 'acrord32.exe') THEN 35.0 ELSE 20.0 END AS score,
  CASE WHEN lower(parent_process_name) IN ('winword.exe', 'excel.exe', 'outlook.exe', 'powerpnt.exe', 'acrord32.exe') THEN 'medium' ELSE 'low' END AS severity, 0.6 AS confidence, 'execution' AS phase,
  CAST(org AS VARCHAR) AS org_hosts, parent_process_name AS parent FROM f WHERE n >= 40 AND org <= 2""", "ev")
part("lookups", f"""SELECT *, CASE WHEN label = '' THEN 0 ELSE {ENTROPY_SQL.format(x="label")} END AS ent, length(label) AS len FROM (
  SELECT *, CASE WHEN len(string_split(domain, '.')) > 2 THEN split_part(lower(domain), '.', 1) ELSE '' END AS label FROM ev WHERE event_type = 'dns_query' AND domain <> '')""", "ev")
part("plain_lookups", "SELECT * FROM lookups WHERE NOT (ent >= 3.9 AND len >= 12 OR len >= 40) AND host <> ''", "lookups")
register("anomaly_dns_entropy", lambda s, d: _anomalies(B.anomaly_dns_entropy(telemetry(s, d)), "label_len"), """
SELECT event_id, 'ANOM-DNS-ENTROPY' AS rule_id, 35.0 AS score, 'medium' AS severity, 0.7 AS confidence, 'command_and_control' AS phase, CAST(len AS VARCHAR) AS label_len
FROM lookups WHERE label <> '' AND (ent >= 3.9 AND len >= 12 OR len >= 40)""", "lookups")
register("anomaly_dns_burst", lambda s, d: _anomalies(B.anomaly_dns_burst(telemetry(s, d), window_seconds=2 * DAY, count=5, quiet_seconds=DAY)), _recursive_cooldown(
    f"""SELECT tenant_id || '|' || upper(host) AS gkey, ts_us, seq AS ord, event_id FROM plain_lookups
    QUALIFY lag(ts_us, 4) OVER (PARTITION BY tenant_id, upper(host) ORDER BY ts_us, seq) >= ts_us - {seconds(2 * DAY)}""", seconds(DAY) + 1,
    "event_id, 'ANOM-DNS-BURST' AS rule_id, 30.0 AS score, 'medium' AS severity, 0.65 AS confidence, 'command_and_control' AS phase"), "plain_lookups")
register("anomaly_detections", lambda s, d: R.fired_counts(R.union_detections(*B.run_baselines(telemetry(s, d)))))
register("baseline_snapshot", lambda s, d: B.baseline_snapshot(telemetry(s, d)), """
SELECT 'users_with_login_baseline' AS baseline, count(DISTINCT tenant_id || '|' || lower("user")) AS n FROM ev WHERE action = 'login_success' AND "user" <> ''
UNION ALL SELECT 'hosts_with_volume_baseline', count(DISTINCT tenant_id || '|' || upper(host)) FROM ev WHERE event_type = 'network_connection' AND bytes_out <> 0 AND host <> ''
UNION ALL SELECT 'processes_known', count(DISTINCT tenant_id || '|' || lower(process_name)) FROM ev WHERE event_type = 'process_start' AND host <> '' AND process_name <> ''""", "ev")
