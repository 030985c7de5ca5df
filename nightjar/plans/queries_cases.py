"""Queries for correlation, the risk ledger and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightjar.operators import correlate as C
from nightjar.operators import graph as G
from nightjar.operators import incidents as I
from nightjar.operators import ledger as L
from nightjar.plans import queries_events  # noqa: F401  (defines shared check parts)
from nightjar.plans.adapter import sample_detections, telemetry
from nightjar.plans.registry import part, register
from nightjar.schema import PHASES, seconds
from nightjar.session import materialize
from nightjar.sources.techniques import TECHNIQUES

HOURS_6 = 6 * 3600
CASE_DAYS = 3

# ------------------------------------------------------------------------------------ correlation
part("dkeys", """SELECT detection_id, tenant_id, ts_us, 'user:' || lower("user") AS entity FROM dt WHERE "user" <> '' UNION ALL SELECT detection_id, tenant_id, ts_us, 'host:' || upper(host) FROM dt WHERE host <> ''
UNION ALL SELECT detection_id, tenant_id, ts_us, 'session:' || session_id FROM dt WHERE session_id <> '' UNION ALL SELECT detection_id, tenant_id, ts_us, 'ip:' || dst_ip FROM dt WHERE dst_ip <> ''""", "dt")
register("detection_entity_keys", lambda s, d: C.detection_entity_keys(sample_detections(s, d)).select("detection_id", "entity"), "SELECT detection_id, entity FROM dkeys", "dkeys")
part("links", f"""SELECT tenant_id, entity, detection_id, ts_us, previous_ts, prev_id FROM (SELECT *, lag(ts_us) OVER w AS previous_ts, lag(detection_id) OVER w AS prev_id FROM dkeys WHERE entity NOT LIKE 'ip:%'
  WINDOW w AS (PARTITION BY tenant_id, entity ORDER BY ts_us, detection_id)) WHERE ts_us - previous_ts <= {seconds(HOURS_6)}""", "dkeys")
register("temporal_links", lambda s, d: C.temporal_links(sample_detections(s, d), HOURS_6), "SELECT tenant_id, entity, detection_id, ts_us, previous_ts FROM links", "links")
# every pair in the window, address keys only with a second shared key: the original definition, not the shortcut
part("pairs", f"""SELECT a.detection_id AS x, b.detection_id AS y FROM dkeys a JOIN dkeys b ON a.tenant_id = b.tenant_id AND a.entity = b.entity AND a.detection_id <> b.detection_id
  AND abs(a.ts_us - b.ts_us) <= {seconds(HOURS_6)} GROUP BY ALL HAVING count(*) FILTER (a.entity NOT LIKE 'ip:%') > 0 OR count(*) > 1""", "dkeys")
_REACH = """WITH RECURSIVE reach AS (SELECT detection_id AS a, detection_id AS b FROM dt UNION SELECT r.a, p.y FROM reach r JOIN pairs p ON r.b = p.x)"""
register("connected_components", lambda s, d: C.cluster_detections(sample_detections(s, d), HOURS_6), _REACH + " SELECT a AS detection_id, min(b) AS cluster FROM reach GROUP BY a", "dt", "pairs")


def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of neighbouring hosts joined when at most two days apart."""
    dets = sample_detections(spark, sf_dir)
    clusters = C.cluster_detections(dets, HOURS_6)
    return C.merge_by_topology(clusters, dets, G.contacted_ips(G.cap_edges(G.derive_edges(telemetry(spark, sf_dir)))), days=2)


part("contacted", """SELECT DISTINCT tenant_id, upper(host) AS host, lower(dst_ip) AS ip FROM ev WHERE event_type = 'network_connection' AND dst_ip <> '' AND host <> '' AND (process_name IS NULL OR process_name = '')
UNION SELECT DISTINCT n.tenant_id, upper(n.host), lower(n.dst_ip) FROM ev n JOIN (SELECT DISTINCT tenant_id, lower(host) AS h, lower(process_name) AS p FROM ev
    WHERE event_type IN ('process_start', 'process_end') AND process_name <> '' AND host <> '' AND (parent_process_name IS NULL OR parent_process_name = '')
    UNION SELECT DISTINCT tenant_id, lower(host), lower(process_name) FROM ev WHERE event_type = 'process_access' AND process_name <> '' AND host <> '' AND file_path IS NULL) e
  ON e.tenant_id = n.tenant_id AND e.h = lower(n.host) AND e.p = lower(n.process_name) WHERE n.event_type = 'network_connection' AND n.dst_ip <> ''""", "ev")
part("neighbors", "SELECT DISTINCT a.tenant_id, a.host, b.host AS neighbor FROM contacted a JOIN contacted b ON a.tenant_id = b.tenant_id AND a.ip = b.ip AND a.host <> b.host", "contacted")
register("merge_by_topology", merged_clusters, _REACH + f""",
first AS (SELECT a AS detection_id, min(b) AS cluster FROM reach GROUP BY a),
span AS (SELECT f.cluster, d.tenant_id, min(ts_us) AS lo, max(ts_us) AS hi FROM first f JOIN dt d USING (detection_id) GROUP BY ALL),
at_host AS (SELECT DISTINCT f.cluster, d.tenant_id, upper(host) AS host FROM first f JOIN dt d USING (detection_id) WHERE host <> ''),
clinks AS (SELECT DISTINCT x.cluster AS a, y.cluster AS b FROM at_host x JOIN neighbors n ON n.tenant_id = x.tenant_id AND n.host = x.host JOIN at_host y ON y.tenant_id = n.tenant_id AND y.host = n.neighbor
  JOIN span s ON s.cluster = x.cluster JOIN span t ON t.cluster = y.cluster WHERE x.cluster <> y.cluster AND greatest(s.lo, t.lo) - least(s.hi, t.hi) <= {seconds(2 * 86_400)}),
creach AS (SELECT DISTINCT cluster AS a, cluster AS b FROM first UNION SELECT c.a, l.b FROM creach c JOIN clinks l ON c.b = l.a)
SELECT f.detection_id, m.cluster FROM first f JOIN (SELECT a, min(b) AS cluster FROM creach GROUP BY a) m ON m.a = f.cluster""", "dt", "pairs", "neighbors")


# ----------------------------------------------------------------------------------------- ledger
part("deposits", """SELECT k.tenant_id, k.entity, k.detection_id, d.rule_id, d.ts_us, d.score * CASE d.kind WHEN 'sequence' THEN 1.1 WHEN 'anomaly' THEN 0.6 ELSE 1.0 END * (0.6 + 0.4 * d.confidence) AS amount
FROM dkeys k JOIN dt d USING (detection_id) WHERE k.entity LIKE 'user:%' OR k.entity LIKE 'host:%'""", "dkeys")
part("balances", """SELECT tenant_id, entity, sum(amount * pow(0.5, ((SELECT max(ts_us) FROM deposits) - ts_us) / (96 * 3600000000.0))) AS balance, count(*) AS deposits FROM deposits GROUP BY ALL""", "deposits")
HOT = 60.0


def _deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger_deposits(sample_detections(spark, sf_dir))


register("ledger_deposits", lambda s, d: _deposits(s, d).select("tenant_id", "entity", "detection_id", "ts_us", F.round("amount", 6).alias("amount")),
         "SELECT tenant_id, entity, detection_id, ts_us, round(amount, 6) AS amount FROM deposits", "deposits")
register("ledger_balance", lambda s, d: L.ledger_balance(_deposits(s, d)).select("tenant_id", "entity", F.round("balance", 6).alias("balance"), "deposits"),
         "SELECT tenant_id, entity, round(balance, 6) AS balance, deposits FROM balances", "balances")
register("ledger_peak", lambda s, d: L.ledger_peak(_deposits(s, d)).select("tenant_id", "entity", F.round("peak", 6).alias("peak")), """
SELECT tenant_id, entity, round(max(running), 6) AS peak FROM (SELECT a.tenant_id, a.entity, a.detection_id, sum(b.amount * pow(0.5, (a.ts_us - b.ts_us) / (96 * 3600000000.0))) AS running
  FROM deposits a JOIN deposits b ON a.tenant_id = b.tenant_id AND a.entity = b.entity AND (b.ts_us, b.detection_id) <= (a.ts_us, a.detection_id) GROUP BY ALL) GROUP BY ALL""", "deposits")
register("hot_entities", lambda s, d: L.hot_entities(_deposits(s, d), threshold=HOT).select("tenant_id", "entity", F.round("balance", 6).alias("balance")),
         f"SELECT tenant_id, entity, round(balance, 6) AS balance FROM balances WHERE balance >= {HOT}", "balances")
part("candidates", f"""SELECT d.tenant_id, d.entity, round(any_value(b.balance), 1) AS balance, round((max(ts_us) - min(ts_us)) / 3600000000.0, 1) AS span_hours,
  list(detection_id ORDER BY ts_us, detection_id) AS ids, list_sort(list(DISTINCT rule_id)) AS rules FROM deposits d JOIN balances b USING (tenant_id, entity)
  WHERE b.balance >= {HOT} AND d.ts_us >= (SELECT max(ts_us) FROM deposits) - {30 * 86_400_000_000} GROUP BY d.tenant_id, d.entity HAVING count(*) >= 2 AND max(ts_us) - min(ts_us) >= 3600000000""", "balances")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.slow_burn_candidates(_deposits(spark, sf_dir), threshold=HOT)


register("slow_burn_candidates", lambda s, d: _candidates(s, d).select("tenant_id", "entity", "balance", "span_hours", F.array_join("detection_ids", ",").alias("ids"), F.array_join("rules", ",").alias("rules")),
         "SELECT tenant_id, entity, balance, span_hours, array_to_string(ids, ',') AS ids, array_to_string(rules, ',') AS rules FROM candidates", "candidates")


def sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups emitted ten days earlier, carried into the current run."""
    dets = sample_detections(spark, sf_dir)
    old = L.slow_burn_candidates(L.ledger_deposits(dets.where(F.col("timestamp") < "2024-01-20")), threshold=HOT)
    merged = L.sticky_groups(_candidates(spark, sf_dir), old)
    return merged.select("tenant_id", "entity", "balance", F.array_join(F.array_sort("detection_ids"), ",").alias("ids"), F.array_join("rules", ",").alias("rules"), "sticky")


_OLD = """old_dep AS (SELECT * FROM deposits WHERE ts_us < epoch_us(TIMESTAMP '2024-01-20')),
old_bal AS (SELECT tenant_id, entity, sum(amount * pow(0.5, ((SELECT max(ts_us) FROM old_dep) - ts_us) / (96 * 3600000000.0))) AS balance FROM old_dep GROUP BY ALL),
old AS (SELECT d.tenant_id, d.entity, round(any_value(b.balance), 1) AS balance, list(detection_id) AS ids, list(DISTINCT rule_id) AS rules FROM old_dep d JOIN old_bal b USING (tenant_id, entity)
  WHERE b.balance >= 60.0 GROUP BY d.tenant_id, d.entity HAVING count(*) >= 2 AND max(ts_us) - min(ts_us) >= 3600000000)"""
register("sticky_groups", sticky, f"""WITH {_OLD}
SELECT tenant_id, entity, greatest(c.balance, o.balance) AS balance, array_to_string(list_sort(list_distinct(list_concat(coalesce(c.ids, []), coalesce(o.ids, [])))), ',') AS ids,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(c.rules, []), coalesce(o.rules, [])))), ',') AS rules, o.entity IS NOT NULL AS sticky
FROM candidates c FULL JOIN old o USING (tenant_id, entity)""", "candidates")
register("ledger_snapshot", lambda s, d: L.ledger_snapshot(_deposits(s, d), threshold=HOT).select("tenant_id", "entity", "balance", "deposits", "hot"),
         f"SELECT tenant_id, entity, round(balance, 1) AS balance, deposits, balance >= {HOT} AS hot FROM balances WHERE balance > 0.5 ORDER BY balances.balance DESC, entity LIMIT 20", "balances")


# -------------------------------------------------------------------------------------- incidents
def sample_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections grouped by host and three-day slot, so that incidents hold several signals."""
    slot = F.floor(F.unix_micros("timestamp") / float(CASE_DAYS * 86_400_000_000)).cast("string")
    return sample_detections(spark, sf_dir).withColumn("cluster", F.concat_ws("|", "tenant_id", F.upper(F.col("entities")["host"]), slot))


def case_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build_incidents(sample_cases(spark, sf_dir), telemetry(spark, sf_dir))


_TACTIC = "CASE {c} " + " ".join(f"WHEN '{t}' THEN '{tac}'" for t, _, tac in TECHNIQUES) + " END"


def tactic_sql(column: str) -> str:
    return f"coalesce({_TACTIC.format(c=column)}, {_TACTIC.format(c=f'split_part({column}, chr(46), 1)')})"


part("cases", f"""SELECT *, tenant_id || '|' || upper(host) || '|' || CAST(CAST(floor(ts_us / {float(CASE_DAYS * 86_400_000_000)}) AS BIGINT) AS VARCHAR) AS cluster,
  coalesce(phase, {tactic_sql("technique_1")}) AS stage, least(greatest(score * (0.6 + 0.4 * confidence), 0), 100) AS weighted,
  CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS sev_rank FROM dt""", "dt")
_WEIGHT = "CASE p " + " ".join(f"WHEN '{p}' THEN {w}" for p, w in I.PHASE_WEIGHT.items()) + " ELSE 3 END"
_ORDER = "[" + ", ".join(f"'{p}'" for p in PHASES) + "]"
part("scored", f"""
WITH g AS (SELECT tenant_id, cluster, 100 * (1 - product(1 - weighted / 100)) AS base, list(DISTINCT stage) FILTER (stage IS NOT NULL) AS stages, count(*) FILTER (kind = 'threat_intel') AS ti, list(DISTINCT kind) AS kinds,
    list_sort(list(DISTINCT host) FILTER (host <> '')) AS hosts, list_sort(coalesce(list(DISTINCT "user") FILTER ("user" <> ''), [])) AS users, avg(confidence) AS mean_conf, count(*) AS n, max(sev_rank) AS worst,
    count(DISTINCT rule_id) AS rules, min(ts_us) AS first_ts, max(ts_us) AS last_ts, arg_min(detection_id, (ts_us, detection_id)) AS first_id, arg_max(title, (score, -ts_us, detection_id)) AS top_title,
    list_sort(list_distinct(list_concat(coalesce(list(technique_1), []), coalesce(list(technique_2) FILTER (technique_2 IS NOT NULL), [])))) AS techniques FROM cases GROUP BY ALL),
b AS (SELECT *, coalesce(stages, []) AS st, CASE WHEN len(coalesce(stages, [])) >= 2 THEN least(0.6 * list_sum([{_WEIGHT} for p in stages]), 25) ELSE 0 END AS chain, least(12, 6 * ti) AS ti_bonus,
    CASE WHEN len([h for h in hosts if regexp_matches(upper(h), '^(DC|DB|FS|API|PRD|SRV|ERP)-')]) > 0 THEN 8 ELSE 0 END + CASE WHEN len([u for u in users if regexp_matches(lower(u), '^(adm-|da-|administrator|svc-backup|svc-sql)')]) > 0 THEN 6 ELSE 0 END AS asset,
    CASE WHEN len(hosts) > 1 THEN least(10, 3 * (len(hosts) - 1)) ELSE 0 END AS breadth FROM g),
r AS (SELECT *, round(least(100, base + chain + ti_bonus + asset + breadth), 1) AS risk,
    round(least(0.99, mean_conf * least(1, 0.55 + 0.15 * len(kinds)) * least(1, 0.6 + 0.1 * n) + CASE WHEN ti > 0 THEN 0.05 ELSE 0 END), 2) AS conf FROM b)
SELECT *, CASE WHEN risk >= 85 THEN 'critical' WHEN risk >= 65 THEN 'high' WHEN risk >= 40 THEN 'medium' WHEN risk >= 20 THEN 'low' ELSE 'info' END AS severity,
  [p for p in {_ORDER} if list_contains(st, p)] AS phases, NOT (n = 1 AND kinds[1] = 'anomaly') AND NOT (risk < 40 AND worst < 3 AND rules < 2) AS admitted FROM r""", "cases")
part("context", """SELECT c.tenant_id, c.cluster, list_sort(coalesce(list(DISTINCT e.dst_ip) FILTER (e.dst_ip IN (SELECT ip FROM ips WHERE NOT is_private)), [])) AS external_ips,
  list_sort(coalesce(list(DISTINCT e.domain) FILTER (e.domain <> ''), [])) AS domains FROM cases c JOIN ev e USING (event_id) GROUP BY ALL""", "cases", "ips")
part("inc", """SELECT s.*, 'SEC-' || lpad(CAST(row_number() OVER (ORDER BY first_ts, first_id) AS VARCHAR), 4, '0') AS incident_id, external_ips, domains FROM scored s JOIN context USING (tenant_id, cluster) WHERE admitted""", "scored", "context")
part("inc_det", "SELECT c.*, i.incident_id FROM cases c JOIN inc i USING (tenant_id, cluster)", "inc")
part("inc_ev", "SELECT DISTINCT d.incident_id, e.* FROM inc_det d JOIN ev e USING (event_id)", "inc_det")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.score_clusters(sample_cases(spark, sf_dir))


register("noisy_or", lambda s, d: sample_cases(s, d).groupBy("tenant_id", "cluster").agg(F.round(I.noisy_or(), 6).alias("risk")),
         "SELECT tenant_id, cluster, round(100 * (1 - product(1 - weighted / 100)), 6) AS risk FROM cases GROUP BY ALL", "cases")
register("risk_score", lambda s, d: _scores(s, d).select("tenant_id", "cluster", F.round("base", 6).alias("base"), F.round("chain_bonus", 6).alias("chain_bonus"), F.col("ti_bonus").cast("double").alias("ti_bonus"), "asset_bonus", "breadth_bonus", "risk_score"),
         """SELECT tenant_id, cluster, round(base, 6) AS base, round(CAST(chain AS DOUBLE), 6) AS chain_bonus, CAST(ti_bonus AS DOUBLE) AS ti_bonus, CAST(asset AS DOUBLE) AS asset_bonus, CAST(breadth AS DOUBLE) AS breadth_bonus, risk AS risk_score FROM scored""", "scored")
register("incident_confidence", lambda s, d: _scores(s, d).select("tenant_id", "cluster", "confidence"), "SELECT tenant_id, cluster, conf AS confidence FROM scored", "scored")
register("severity_bucket", lambda s, d: _scores(s, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min("risk_score").alias("lowest"), F.max("risk_score").alias("highest")),
         "SELECT severity, count(*) AS n, min(risk) AS lowest, max(risk) AS highest FROM scored GROUP BY severity", "scored")
register("admission_filter", lambda s, d: I.admission_filter(_scores(s, d)).select("tenant_id", "cluster", "detections", "risk_score"),
         "SELECT tenant_id, cluster, n AS detections, risk AS risk_score FROM scored WHERE admitted", "scored")
_TITLE = """CASE WHEN (list_contains(phases, 'exfiltration') OR list_contains(phases, 'collection')) AND list_contains(phases, 'execution') THEN 'Compromise with execution and data theft: ' || place
  WHEN list_contains(phases, 'impact') THEN 'Destructive activity on ' || hosts[1] WHEN list_contains(phases, 'lateral_movement') THEN who || ' moving across ' || len(hosts) || ' host(s)'
  WHEN list_contains(phases, 'credential_access') AND list_contains(phases, 'initial_access') THEN 'Account break-in: ' || who WHEN list_contains(phases, 'exfiltration') THEN 'Data leaving ' || hosts[1]
  WHEN list_contains(phases, 'persistence') OR list_contains(phases, 'privilege_escalation') THEN 'Foothold or elevation on ' || hosts[1] WHEN list_contains(phases, 'command_and_control') THEN 'Remote-control traffic from ' || hosts[1]
  ELSE top_title || ': ' || place END"""
part("titled", f"SELECT *, {_TITLE} AS title FROM (SELECT *, coalesce(users[1], hosts[1]) AS who, coalesce(users[1], hosts[1]) || CASE WHEN len(users) > 0 THEN ' on ' || hosts[1] ELSE '' END AS place FROM inc)", "inc")
register("incident_title", lambda s, d: case_incidents(s, d).select("incident_id", "title"), "SELECT incident_id, title FROM titled", "titled")
register("number_incidents", lambda s, d: case_incidents(s, d).select("incident_id", "cluster"), "SELECT incident_id, cluster FROM inc", "inc")


def incident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = case_incidents(spark, sf_dir)
    return i.select("incident_id", "tenant_id", "severity", "risk_score", "confidence", F.unix_micros("first_event_at").alias("first_us"), F.unix_micros("last_event_at").alias("last_us"),
                    *[F.array_join(c, ",").alias(c) for c in ("affected_users", "affected_hosts", "external_ips", "domains", "techniques", "phases", "tags")], "detections")


register("build_incidents", incident_rows, """SELECT incident_id, tenant_id, severity, risk AS risk_score, conf AS confidence, first_ts AS first_us, last_ts AS last_us, array_to_string(users, ',') AS affected_users, array_to_string(hosts, ',') AS affected_hosts,
  array_to_string(external_ips, ',') AS external_ips, array_to_string(domains, ',') AS domains, array_to_string(techniques, ',') AS techniques, array_to_string(phases, ',') AS phases, array_to_string(list_sort(kinds), ',') AS tags, n AS detections FROM inc""", "inc")


def case_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.incident_detections(case_incidents(spark, sf_dir), sample_cases(spark, sf_dir))


def case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.incident_events(case_incidents(spark, sf_dir), sample_cases(spark, sf_dir), telemetry(spark, sf_dir))


register("incident_events", lambda s, d: case_events(s, d).select("incident_id", "event_id", F.unix_micros("timestamp").alias("ts_us")), "SELECT incident_id, event_id, ts_us FROM inc_ev", "inc_ev")
register("phase_matrix", lambda s, d: I.phase_matrix(case_detections(s, d), case_incidents(s, d)).select("incident_id", "phase", "present", F.array_join("techniques", ",").alias("techniques"), F.array_join("detection_ids", ",").alias("detection_ids"), F.unix_micros("first_seen").cast("string").alias("first_us")), f"""
WITH seen AS (SELECT incident_id, stage, list_sort(list_distinct(list_concat(list(technique_1), coalesce(list(technique_2) FILTER (technique_2 IS NOT NULL), [])))) AS techs, list(detection_id ORDER BY ts_us, detection_id) AS ids, min(ts_us) AS first_us
  FROM inc_det WHERE stage IS NOT NULL GROUP BY ALL)
SELECT i.incident_id, p.phase, s.stage IS NOT NULL AS present, coalesce(array_to_string(techs, ','), '') AS techniques, coalesce(array_to_string(ids, ','), '') AS detection_ids, CAST(first_us AS VARCHAR) AS first_us
FROM inc i CROSS JOIN (SELECT unnest({_ORDER}) AS phase) p LEFT JOIN seen s ON s.incident_id = i.incident_id AND s.stage = p.phase""", "inc_det")


def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections -> clusters -> incidents, sorted by risk, plus slow-burn incidents of the ledger."""
    dets = sample_detections(spark, sf_dir)
    grouped = materialize(C.correlate(dets, G.contacted_ips(G.derive_edges(telemetry(spark, sf_dir))), HOURS_6))
    window = I.build_incidents(grouped, telemetry(spark, sf_dir))
    admitted = I.incident_detections(window, grouped).select("detection_id")
    slow = I.slow_burn_incidents(L.slow_burn_candidates(L.ledger_deposits(dets), threshold=HOT), dets, admitted, telemetry(spark, sf_dir))
    cols = ["tenant_id", "cluster", "severity", "risk_score", "detections", "title"]
    return window.select(*cols, "first_event_at", "incident_id").unionByName(slow.select(*cols, "first_event_at", F.concat(F.lit("L-"), "incident_id").alias("incident_id"))).orderBy(F.desc("risk_score"), "first_event_at").select(*cols)


register("correlate", correlated)


def slow_burn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger incidents from what the window incidents leave unexplained, in greedy rank order."""
    dets = sample_detections(spark, sf_dir)
    admitted = I.incident_detections(case_incidents(spark, sf_dir), sample_cases(spark, sf_dir)).select("detection_id")
    cands = L.slow_burn_candidates(L.ledger_deposits(dets), threshold=HOT)
    out = I.slow_burn_incidents(cands, dets, admitted, telemetry(spark, sf_dir))
    return out.select("tenant_id", F.col("cluster").alias("entity"), "risk_score", "severity", "detections", "ledger_balance")


register("slow_burn_incidents", slow_burn, """WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (ORDER BY balance DESC, entity, tenant_id) AS rn FROM candidates),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, (SELECT coalesce(list(detection_id), CAST([] AS VARCHAR[])) FROM inc_det) AS used, false AS taken UNION ALL
  SELECT r.rn, CASE WHEN ok THEN list_concat(w.used, r.ids) ELSE w.used END, ok FROM (SELECT w.rn AS prev, w.used FROM walk w) w JOIN (SELECT * FROM ranked) r ON r.rn = w.prev + 1, LATERAL (SELECT len([x for x in r.ids if NOT list_contains(w.used, x)]) >= 2 AS ok) o),
chosen AS (SELECT r.* FROM ranked r JOIN walk w ON w.rn = r.rn WHERE w.taken),
m AS (SELECT c.tenant_id, c.entity, c.balance, d.* EXCLUDE (tenant_id) FROM (SELECT *, unnest(ids) AS did FROM chosen) c JOIN cases d ON d.detection_id = c.did),
g AS (SELECT tenant_id, entity, any_value(balance) AS bal, 100 * (1 - product(1 - weighted / 100)) AS base, list(DISTINCT stage) FILTER (stage IS NOT NULL) AS stages, count(*) FILTER (kind = 'threat_intel') AS ti, list(DISTINCT host) AS hosts,
  coalesce(list(DISTINCT "user") FILTER ("user" <> ''), []) AS users, count(*) AS n FROM m GROUP BY tenant_id, entity),
r AS (SELECT *, round(least(100, base + CASE WHEN len(coalesce(stages, [])) >= 2 THEN least(0.6 * list_sum([""" + _WEIGHT + """ for p in stages]), 25) ELSE 0 END + least(12, 6 * ti)
  + CASE WHEN len([h for h in hosts if regexp_matches(upper(h), '^(DC|DB|FS|API|PRD|SRV|ERP)-')]) > 0 THEN 8 ELSE 0 END + CASE WHEN len([u for u in users if regexp_matches(lower(u), '^(adm-|da-|administrator|svc-backup|svc-sql)')]) > 0 THEN 6 ELSE 0 END
  + CASE WHEN len(hosts) > 1 THEN least(10, 3 * (len(hosts) - 1)) ELSE 0 END), 1) AS risk0 FROM g),
f AS (SELECT *, round(least(100, greatest(risk0, least(95, bal))), 1) AS risk FROM r)
SELECT tenant_id, entity, risk AS risk_score, CASE WHEN risk >= 85 THEN 'critical' WHEN risk >= 65 THEN 'high' WHEN risk >= 40 THEN 'medium' WHEN risk0 >= 20 THEN 'low' ELSE 'info' END AS severity, n AS detections, bal AS ledger_balance FROM f""", "candidates", "inc_det")


def carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's incidents (three-day slots, some already handled) meet today's (one-day slots)."""
    old_dets = case_detections(spark, sf_dir)
    old = case_incidents(spark, sf_dir).withColumn("status", F.when(F.col("severity") == "critical", "investigating").otherwise("contained")).withColumn("summary", F.concat(F.lit("seen "), "cluster"))
    fresh = sample_detections(spark, sf_dir)
    slot = F.floor(F.unix_micros("timestamp") / 86_400_000_000.0).cast("string")
    fresh = fresh.withColumn("cluster", F.concat_ws("|", "tenant_id", F.upper(F.col("entities")["host"]), slot))
    new = I.build_incidents(fresh, None)
    out = I.carry_over_status(new, I.incident_detections(new, fresh), old, old_dets)
    return out.select("incident_id", "cluster", "status", "summary", "risk_score")


register("carry_over_status", carried_over)


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst updates derived from the incidents: two per critical incident, the later one wins."""
    inc = case_incidents(spark, sf_dir)
    ups = inc.where(F.col("severity") == "critical").select("incident_id", F.inline(F.array(
        F.struct(F.lit("investigating").alias("status"), F.lit(1).alias("updated_at")), F.struct(F.lit("resolved").alias("status"), F.lit(2).alias("updated_at")), F.struct(F.lit("bogus").alias("status"), F.lit(3).alias("updated_at")))))
    return I.set_status(inc, ups).select("incident_id", "status")


register("set_status", status_updates, "SELECT incident_id, CASE WHEN severity = 'critical' THEN 'resolved' ELSE 'open' END AS status FROM inc", "inc")
