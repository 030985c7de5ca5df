"""Queries for ATT&CK coverage, investigation, text checks, views and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightjar.operators import attack as M
from nightjar.operators import evaluate as X
from nightjar.operators import investigate as V
from nightjar.operators import rules as R
from nightjar.operators import text_guard as T
from nightjar.operators import views as Q
from nightjar.operators.incidents import effective_phase
from nightjar.operators.intel import extract_observables
from nightjar.plans.adapter import sample_detections, spread, telemetry
from nightjar.plans.queries_cases import case_detections, case_events, case_incidents, tactic_sql
from nightjar.plans.queries_events import SUMMARY_SQL
from nightjar.plans.queries_intel import sample_iocs, web_events
from nightjar.plans.registry import part, register
from nightjar.plans.rulepack import BUILT_IN_TECHNIQUES, RULES
from nightjar.schema import PHASES, phase_label
from nightjar.sources.techniques import TECHNIQUES, read_techniques

_PHASE_ROWS = "(VALUES " + ", ".join(f"({i}, '{p}', '{phase_label(p)}')" for i, p in enumerate(PHASES)) + ") ph(phase_rank, phase, label)"
_CATALOG = "(VALUES " + ", ".join(f"('{t}', '{n.replace(chr(39), chr(39) * 2)}', '{tac}')" for t, n, tac in TECHNIQUES) + ") cat(technique_id, name, tactic)"

# ----------------------------------------------------------------------------------------- ATT&CK
part("seen_techs", "SELECT detection_id, unnest([technique_1, technique_2]) AS technique FROM dt", "dt")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_detections(spark, sf_dir).select("detection_id", F.explode("techniques").alias("technique"))


register("map_techniques", lambda s, d: M.map_techniques(_observed(s, d), read_techniques(s)).select("detection_id", "technique", "technique_name", "tactic", "url"), f"""
SELECT detection_id, technique, coalesce(e.name, p.name) AS technique_name, coalesce(e.tactic, p.tactic) AS tactic, 'https://attack.mitre.org/techniques/' || replace(coalesce(e.technique_id, p.technique_id), '.', '/') || '/' AS url
FROM seen_techs s LEFT JOIN (SELECT * FROM {_CATALOG}) e ON e.technique_id = s.technique LEFT JOIN (SELECT * FROM {_CATALOG}) p ON p.technique_id = split_part(s.technique, '.', 1) WHERE technique IS NOT NULL""", "seen_techs")
register("tactic_coverage", lambda s, d: M.tactic_coverage(_observed(s, d)).select("tactic", "label", "n"), f"""
SELECT phase AS tactic, label, count(t) AS n FROM {_PHASE_ROWS} LEFT JOIN (SELECT {tactic_sql("technique")} AS t FROM seen_techs WHERE technique IS NOT NULL) x ON x.t = phase GROUP BY phase, label""", "seen_techs")


def coverage_of_fired_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue coverage of the shipped rules, beside the number of events their conditions hit here."""
    hits = R.scan_conditions(telemetry(spark, sf_dir), RULES).groupBy("rule_idx").agg(F.count(F.lit(1)).alias("hits"))
    table = R.rule_table(spark, RULES).join(F.broadcast(hits), "rule_idx", "left")
    tech = table.select("rule_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.explode("techniques").alias("technique"))
    built = spark.createDataFrame([(r, t) for r, ts in BUILT_IN_TECHNIQUES.items() for t in ts], "rule_id string, technique string").withColumn("hits", F.lit(0).cast("long"))
    every = tech.unionByName(built)
    cover = M.rule_coverage(every.select("rule_id", "technique"), read_techniques(spark))
    per_tactic = every.select(M.tactic_of(F.col("technique")).alias("tactic"), "rule_id", "hits").distinct().groupBy("tactic").agg(F.sum("hits").alias("hits"))
    return cover.join(per_tactic, "tactic", "left").select("tactic", "total", "covered", F.coalesce("hits", F.lit(0)).alias("hits"))


register("rule_coverage", coverage_of_fired_rules)
register("observed_techniques", lambda s, d: M.observed_techniques(case_incidents(s, d)), "SELECT technique, count(*) AS incidents FROM (SELECT unnest(techniques) AS technique FROM inc) GROUP BY technique", "inc")


def unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed technique ids without their own catalogue entry."""
    return M.unmapped_techniques(_observed(spark, sf_dir), read_techniques(spark))


register("unmapped_techniques", unmapped, f"SELECT DISTINCT technique FROM seen_techs WHERE technique IS NOT NULL AND technique NOT IN (SELECT technique_id FROM {_CATALOG})", "seen_techs")


def fired_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = sample_detections(spark, sf_dir).select("rule_id", "title").distinct()
    return M.rule_catalog(rules, sample_detections(spark, sf_dir))


register("rule_catalog", fired_catalog, "SELECT rule_id, title, count(*) AS fired FROM dt GROUP BY ALL", "dt")

# ---------------------------------------------------------------------------------- investigation
_MEETS = lambda phases: "len(list_intersect(phases, [" + ", ".join(f"'{p}'" for p in phases) + "])) > 0"
register("plan_findings", lambda s, d: V.plan_findings(case_incidents(s, d)), f"""SELECT incident_id, true AS identity, {_MEETS(V.PROCESS_PHASES)} AS process,
  {_MEETS(V.NETWORK_PHASES)} OR len(external_ips) > 0 OR len(domains) > 0 AS network, {_MEETS(V.FILE_PHASES)} AS file FROM inc""", "inc")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tagged_events(case_events(spark, sf_dir))


def _finding_rows(df: DataFrame) -> DataFrame:
    return df.select("incident_id", "headline", "confidence", F.array_join("evidence_event_ids", ",").alias("evidence"))


_IDS = "coalesce(list(event_id ORDER BY ts_us, seq) FILTER ({f}), [])[1:{n}]"


def _ids(condition: str, n: int) -> str:
    return _IDS.format(f=condition, n=n)


_FAIL, _SUCC = "action = 'login_failure'", "action = 'login_success'"
_PRIV = "event_type IN ('privilege_change', 'group_change', 'user_created')"
register("identity_finding", lambda s, d: _finding_rows(V.identity_finding(_tagged(s, d))), f"""
SELECT incident_id, CASE WHEN (count(*) FILTER ({_FAIL}) > 0 AND count(*) FILTER ({_SUCC}) > 0) OR count(*) FILTER ({_SUCC} AND geo_country <> '') > 0 THEN 'Identity compromised or misused' ELSE 'Identity activity worth a look' END AS headline,
  round(least(0.95, 0.6 + CASE WHEN count(*) FILTER ({_FAIL}) > 0 THEN 0.15 ELSE 0 END + CASE WHEN count(*) FILTER ({_SUCC} AND geo_country <> '' AND geo_country <> 'IN') > 0 THEN 0.15 ELSE 0 END + CASE WHEN count(*) FILTER ({_PRIV}) > 0 THEN 0.1 ELSE 0 END), 2) AS confidence,
  array_to_string(list_concat({_ids(_FAIL, 5)}, {_ids(_SUCC, 3)}, {_ids(_PRIV, 3)}), ',') AS evidence
FROM inc_ev GROUP BY incident_id HAVING count(*) FILTER (event_type = 'authentication' OR {_PRIV}) > 0""", "inc_ev")
_START = "event_type = 'process_start'"
_SUSPECT = f"({_START} AND lower(coalesce(process_name, '')) IN ({', '.join(repr(p) for p in V.SUSPECT_PROCESSES)}))"
_CHAIN = f"({_START} AND lower(coalesce(parent_process_name, '')) IN ('winword.exe', 'excel.exe', 'outlook.exe', 'powerpnt.exe'))"
_ENC = f"({_START} AND (contains(lower(coalesce(command_line, '')), '-enc') OR contains(lower(coalesce(command_line, '')), 'encodedcommand')))"
register("process_finding", lambda s, d: _finding_rows(V.process_finding(_tagged(s, d))), f"""
SELECT incident_id, CASE WHEN odd THEN 'Suspicious commands' ELSE 'Ordinary process activity' END AS headline, CASE WHEN odd THEN round(least(0.95, 0.7 + CASE WHEN chains > 0 THEN 0.15 ELSE 0 END + CASE WHEN encs > 0 THEN 0.15 ELSE 0 END), 2) ELSE 0.4 END AS confidence,
  array_to_string(CASE WHEN odd THEN list_concat(c_ids, e_ids, s_ids) ELSE all_ids END, ',') AS evidence
FROM (SELECT incident_id, count(*) FILTER ({_SUSPECT}) + count(*) FILTER ({_CHAIN}) > 0 AS odd, count(*) FILTER ({_CHAIN}) AS chains, count(*) FILTER ({_ENC}) AS encs, count(*) FILTER ({_START}) AS starts,
  {_ids(_CHAIN, 1)} AS c_ids, {_ids(_ENC, 1)} AS e_ids, {_ids(_SUSPECT, 4)} AS s_ids, {_ids(_START, 5)} AS all_ids FROM inc_ev GROUP BY incident_id) WHERE starts > 0""", "inc_ev")
_CONN, _DNS = "event_type = 'network_connection'", "event_type = 'dns_query'"
_EXT = f"({_CONN} AND dst_ip IN (SELECT ip FROM ips WHERE NOT is_private))"
_ODD = f"({_DNS} AND domain <> '' AND (coalesce(protocol, '') = 'TXT' OR length(split_part(domain, '.', 1)) > 30))"
register("network_finding", lambda s, d: _finding_rows(V.network_finding(_tagged(s, d), case_detections(s, d))), f"""
WITH ti AS (SELECT incident_id, count(*) AS n, list(event_id ORDER BY ts_us, detection_id) AS ids FROM inc_det WHERE kind = 'threat_intel' GROUP BY incident_id),
m AS (SELECT *, dst_ip IN (SELECT ip FROM ips WHERE NOT is_private) AS pub FROM inc_ev),
g AS (SELECT incident_id, count(*) FILTER ({_CONN} OR {_DNS}) AS net, count(*) FILTER ({_CONN} AND pub) AS ext, count(*) FILTER ({_ODD}) AS odd, coalesce(max(bytes_out) FILTER ({_CONN}), 0) AS big,
  {_ids(_CONN + " AND pub", 4)} AS x_ids, {_ids(_ODD, 3)} AS o_ids FROM m GROUP BY incident_id)
SELECT incident_id, CASE WHEN coalesce(n, 0) > 0 OR big >= 10000000 THEN 'Remote control or data theft' ELSE 'Network activity worth a look' END AS headline,
  round(least(0.96, 0.6 + CASE WHEN coalesce(n, 0) > 0 THEN 0.25 ELSE 0 END + CASE WHEN big >= 10000000 THEN 0.1 ELSE 0 END + CASE WHEN odd > 0 THEN 0.1 ELSE 0 END), 2) AS confidence,
  array_to_string(list_concat(x_ids, coalesce(ids, []), o_ids), ',') AS evidence FROM g LEFT JOIN ti USING (incident_id) WHERE net > 0 AND (ext > 0 OR coalesce(n, 0) > 0 OR big >= 10000000 OR odd > 0)""", "inc_ev", "ips")
_PATH = "event_type LIKE 'file_%' AND file_path <> ''"


def _words(words: list[str], how: str) -> str:
    return f"({_PATH} AND (" + " OR ".join(f"{how}(lower(file_path), '{w}')" for w in words) + "))"


_ARC, _LOCK = _words(V.ARCHIVE_ENDINGS, "ends_with"), _words(V.LOCKED_ENDINGS, "ends_with")
_NOTE, _SENS = _words(V.NOTE_WORDS, "contains"), _words(V.SENSITIVE_WORDS, "contains")
register("file_finding", lambda s, d: _finding_rows(V.file_finding(_tagged(s, d))), f"""
SELECT incident_id, 'File activity of concern' AS headline, round(least(0.96, 0.55 + CASE WHEN l > 0 THEN 0.3 ELSE 0 END + CASE WHEN n > 0 THEN 0.1 ELSE 0 END + CASE WHEN a > 0 THEN 0.15 ELSE 0 END + CASE WHEN s > 0 THEN 0.1 ELSE 0 END), 2) AS confidence,
  array_to_string(list_concat(l_ids, n_ids, CASE WHEN a > 0 THEN [big] ELSE [] END, s_ids), ',') AS evidence
FROM (SELECT incident_id, count(*) FILTER ({_LOCK}) AS l, count(*) FILTER ({_NOTE}) AS n, count(*) FILTER ({_ARC}) AS a, count(*) FILTER ({_SENS}) AS s, {_ids(_LOCK, 3)} AS l_ids, {_ids(_NOTE, 1)} AS n_ids, {_ids(_SENS, 2)} AS s_ids,
  arg_max(event_id, (coalesce(file_size, 0), -seq)) FILTER ({_ARC}) AS big FROM inc_ev GROUP BY incident_id) WHERE l + n + a + s > 0""", "inc_ev")
register("all_findings", lambda s, d: V.all_findings(case_incidents(s, d), case_events(s, d), case_detections(s, d)).select("incident_id", "agent", "headline", "detail", "confidence"))
register("incident_timeline", lambda s, d: V.incident_timeline(case_events(s, d), case_detections(s, d)).select("incident_id", "position", "event_id", "time", "summary", "phase", F.array_join("techniques", ",").alias("techniques")), f"""
SELECT e.incident_id, CAST(row_number() OVER (PARTITION BY e.incident_id ORDER BY e.ts_us, e.seq) AS INTEGER) AS position, e.event_id, strftime(e."timestamp", '%Y-%m-%d %H:%M:%S') AS time, e.summary, d.phase,
  array_to_string(list_sort(list_distinct([x for x in [d.technique_1, d.technique_2] if x IS NOT NULL])), ',') AS techniques FROM (SELECT *, {SUMMARY_SQL} AS summary FROM inc_ev) e JOIN inc_det d USING (incident_id, event_id)""", "inc_ev")
_ACTION_ROWS = "(VALUES " + ", ".join(f"('{p}', {PHASES.index(p)}, {i}, '{a.replace(chr(39), chr(39) * 2)}')" for p, acts in V.ACTIONS.items() for i, a in enumerate(acts)) + ") lib(phase, phase_rank, pos, action)"
_CLOSING_ROWS = " ".join(f"UNION ALL SELECT incident_id, {len(PHASES)}, {i}, '{a}' FROM inc" for i, a in enumerate(V.CLOSING_ACTIONS))
register("recommendations", lambda s, d: V.recommendations(case_incidents(s, d)), f"""
SELECT incident_id, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY phase_rank, pos) AS INTEGER) AS position, action FROM (
  SELECT i.incident_id, lib.phase_rank, lib.pos, lib.action FROM (SELECT incident_id, unnest(phases) AS phase FROM inc) i JOIN {_ACTION_ROWS} USING (phase) {_CLOSING_ROWS})""", "inc")
register("fact_summary", lambda s, d: V.fact_summary(case_incidents(s, d)), """
SELECT incident_id, 'Incident ' || incident_id || ' (' || upper(severity) || ', risk ' || CAST(CAST(floor(risk + 0.5) AS BIGINT) AS VARCHAR) || '/100, confidence ' || CAST(CAST(floor(conf * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%) concerns ' || CASE WHEN len(users) > 0 THEN array_to_string(users, ', ') ELSE 'an unknown account' END
  || ' on ' || array_to_string(hosts, ', ') || '. Phases: ' || CASE WHEN len(phases) > 0 THEN replace(array_to_string(phases, ' > '), '_', ' ') ELSE 'single stage' END || '.' || chr(10) || chr(10) || ' ' || n || ' detections by ' || len(kinds) || ' method(s).' AS text FROM inc""", "inc")


# ------------------------------------------------------------------------------------------- text
def _sql_regex(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _injected_sql(column: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_sql_regex(p)})" for p in T.INJECTION_PATTERNS) + ")"


register("scan_injection_events", lambda s, d: T.scan_injection(telemetry(s, d), ["event_id"]), "\nUNION ALL ".join(
    f"SELECT event_id, '{f}' AS field, {f} AS value FROM ev WHERE {f} <> '' AND {_injected_sql(f)}" for f in T.SCANNED_FIELDS), "ev")
register("scan_injection_texts", lambda s, d: T.scan_injection(s.read.parquet(f"{d}/documents.parquet"), ["doc_id"], ["text"]).select("doc_id").withColumn("origin", F.lit("documents")).unionByName(
    T.scan_injection(s.read.parquet(f"{d}/conversations.parquet").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn")), ["doc_id"], ["text"]).select("doc_id").withColumn("origin", F.lit("conversations"))),
    f"SELECT doc_id, 'documents' AS origin FROM documents WHERE {_injected_sql('text')} UNION ALL SELECT conv_id * 1000 + turn, 'conversations' FROM conversations WHERE {_injected_sql('text')}")


def _sanitize_sql(column: str) -> str:
    out = f"coalesce({column}, '')"
    for p in T.INJECTION_PATTERNS:
        out = f"regexp_replace({out}, {_sql_regex(p)}, '{T.REDACTED}', 'g')"
    out = f"regexp_replace(replace(replace({out}, '{T.FENCE}', '{T.DEFANGED_FENCE}'), chr(0), ''), '[\\r\\n]+', '{T.LINE_MARK}', 'g')"
    return out


register("sanitize_text", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.sanitize_text(F.col("text")).alias("clean")),
         f"SELECT doc_id, {_sanitize_sql('text')} AS clean FROM documents")


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per incident: its telemetry lines in time order plus invented names, as something to check."""
    lines = V.incident_timeline(case_events(spark, sf_dir), case_detections(spark, sf_dir))
    body = lines.groupBy("incident_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", F.concat("event_id", F.lit(" "), "summary").alias("t")))).getField("t"), ". ").alias("body"))
    inc = case_incidents(spark, sf_dir).select("incident_id", F.array_join("techniques", " ").alias("techs"), F.array_join("affected_hosts", " ").alias("hosts"), F.array_join("affected_users", " ").alias("users"))
    extra = "Lateral movement to XX-77 at 8.8.8.8 with evil.exe via c2.evil.example.com and T1490. No exfiltration was seen. Ransomware evt_ffffffffff"
    return body.join(inc, "incident_id").select(F.col("incident_id").alias("text_id"), "incident_id", F.concat_ws(". ", F.upper("hosts"), "users", "techs", "body", F.lit(extra)).alias("text"))


part("narratives", f"""SELECT incident_id AS text_id, incident_id, upper(array_to_string(hosts, ' ')) || '. ' || array_to_string(users, ' ') || '. ' || array_to_string(techniques, ' ') || '. ' || body
  || '. Lateral movement to XX-77 at 8.8.8.8 with evil.exe via c2.evil.example.com and T1490. No exfiltration was seen. Ransomware evt_ffffffffff' AS text
FROM inc JOIN (SELECT incident_id, string_agg(event_id || ' ' || summary, '. ' ORDER BY ts_us, seq) AS body FROM (SELECT *, {SUMMARY_SQL} AS summary FROM inc_ev) GROUP BY incident_id) USING (incident_id)""", "inc_ev")
register("citation_check", lambda s, d: T.citation_check(narratives(s, d), case_events(s, d).withColumnRenamed("incident_id", "text_id")).withColumn("fabricated_ids", F.array_join("fabricated_ids", ",")), """
WITH c AS MATERIALIZED (SELECT text_id, event_id FROM (SELECT text_id, unnest(list_distinct(regexp_extract_all(text, 'evt_[0-9a-f]{6,}'))) AS event_id FROM narratives)),
v AS MATERIALIZED (SELECT incident_id AS text_id, event_id FROM inc_ev), t AS (SELECT text_id, count(*) AS total FROM v GROUP BY text_id),
g AS (SELECT c.text_id, count(*) AS cited, count(v.event_id) AS good, list_sort(coalesce(list(c.event_id) FILTER (v.event_id IS NULL), [])) AS bad FROM c LEFT JOIN v USING (text_id, event_id) GROUP BY c.text_id)
SELECT text_id, total AS evidence_total, good AS evidence_cited, array_to_string(bad, ',') AS fabricated_ids, round(good / total, 3) AS coverage, round(good / cited, 3) AS fidelity, len(bad) = 0 AS grounded FROM g JOIN t USING (text_id)""", "narratives")
part("vocab", """SELECT DISTINCT incident_id, kind, value FROM (
  SELECT incident_id, 'ip' AS kind, src_ip AS value FROM inc_ev UNION ALL SELECT incident_id, 'ip', dst_ip FROM inc_ev UNION ALL SELECT incident_id, 'host', upper(host) FROM inc_ev UNION ALL SELECT incident_id, 'user', lower("user") FROM inc_ev
  UNION ALL SELECT incident_id, 'user', lower(target_user) FROM inc_ev UNION ALL SELECT incident_id, 'domain', lower(domain) FROM inc_ev UNION ALL SELECT incident_id, 'domain', lower(split_part(split_part(url, '//', 2), '/', 1)) FROM inc_ev
  UNION ALL SELECT incident_id, 'process', lower(process_name) FROM inc_ev UNION ALL SELECT incident_id, 'process', lower(parent_process_name) FROM inc_ev UNION ALL SELECT incident_id, 'file', lower(regexp_extract(file_path, '([^/]*)$', 1)) FROM inc_ev
  UNION ALL SELECT incident_id, 'phase', stage FROM inc_det UNION ALL SELECT incident_id, 'technique', unnest([technique_1, technique_2]) FROM inc_det UNION ALL SELECT incident_id, 'technique_parent', split_part(unnest([technique_1, technique_2]), '.', 1) FROM inc_det) WHERE value <> ''""", "inc_ev")


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.evidence_vocabulary(case_events(spark, sf_dir), case_detections(spark, sf_dir))


register("evidence_vocabulary", _vocabulary, "SELECT incident_id, kind, value FROM vocab", "vocab")
_LIST = lambda p, change="x": f"list_distinct([{change} for x in regexp_extract_all(text, {_sql_regex(p)})])"
_CLAIM_KINDS = f"""SELECT @ID, 'ip' AS kind, unnest([x for x in {_LIST(T.IP)} if list_max([CAST(o AS INTEGER) for o in string_split(x, '.')]) <= 255]) AS value FROM @SRC
UNION ALL SELECT @ID, 'technique', unnest({_LIST(T.TECHNIQUE)}) FROM @SRC UNION ALL SELECT @ID, 'host', unnest([x for x in {_LIST(T.HOST, 'upper(x)')} if NOT starts_with(x, 'SEC-')]) FROM @SRC
UNION ALL SELECT @ID, 'process', unnest({_LIST(T.PROCESS, 'lower(x)')}) FROM @SRC UNION ALL SELECT @ID, 'domain', unnest([x for x in {_LIST(T.DOMAIN, 'lower(x)')} if NOT regexp_full_match(x, {_sql_regex(T.IP)})]) FROM @SRC"""
_PHASE_CLAIMS = "\nUNION ALL ".join(
    f"SELECT @ID, 'phase' AS kind, '{ph}' AS value FROM @SRC WHERE len([i for i in range(1, len(string_split_regex(text, {_sql_regex(p)})))"
    f" if NOT regexp_matches(split_part(right(array_to_string(list_concat([''], list_transform(range(1, i + 1), lambda j: string_split_regex(text, {_sql_regex(p)})[j] || CASE WHEN j < i THEN regexp_extract_all(text, {_sql_regex(p)})[j] ELSE '' END)), ''), 60), '.', -1), {_sql_regex(T.NEGATION)})]) > 0"
    for ph, p in T.PHASE_WORDS.items())


def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every document and conversation turn, whole texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("text_id"), "text")
    return T.extract_claims(spread(docs.unionByName(conv)))


register("extract_claims", document_claims)
register("extract_claims_narratives", lambda s, d: T.extract_claims(narratives(s, d)).select("text_id", "kind", "value"), (_CLAIM_KINDS + "\nUNION ALL " + _PHASE_CLAIMS).replace("@ID", "text_id").replace("@SRC", "narratives"), "narratives")


def verified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.verify_claims(narratives(spark, sf_dir), _vocabulary(spark, sf_dir))[0].select("text_id", "kind", "value", "supported")


def verified_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.verify_claims(narratives(spark, sf_dir), _vocabulary(spark, sf_dir))[1]


part("claims", (_CLAIM_KINDS + "\nUNION ALL " + _PHASE_CLAIMS).replace("@ID", "text_id").replace("@SRC", "narratives"), "narratives")
part("checked", """SELECT text_id, kind, value, EXISTS (SELECT 1 FROM vocab v WHERE v.incident_id = c.text_id AND (v.kind = c.kind AND v.value = c.value
    OR c.kind = 'technique' AND v.kind = 'technique_parent' AND v.value = split_part(c.value, '.', 1) OR c.kind = 'process' AND v.kind = 'file' AND v.value = c.value
    OR c.kind = 'domain' AND v.kind = 'domain' AND (ends_with(c.value, '.' || v.value) OR ends_with(v.value, '.' || c.value)))) AS supported FROM claims c
UNION ALL SELECT n.text_id, 'user', v.value, true FROM narratives n JOIN vocab v ON v.incident_id = n.incident_id AND v.kind = 'user' AND regexp_matches(lower(n.text), '\\b' || regexp_escape(v.value) || '\\b')""", "claims", "vocab")
register("verify_claims", verified_claims, "SELECT text_id, kind, value, supported FROM checked", "checked")
register("verify_claims_summary", verified_texts, """SELECT text_id, count(*) AS total, count(*) FILTER (supported) AS supported, count(*) FILTER (NOT supported) AS unsupported,
  round(count(*) FILTER (supported) / count(*), 3) AS fidelity, bool_and(supported) AS verified FROM checked GROUP BY text_id""", "checked")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations, put to all incidents in turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("role") == "user")
    incidents = max(case_incidents(spark, sf_dir).count(), 1)
    slot = F.concat(F.lit("SEC-"), F.lpad((F.col("conv_id") % incidents + 1).cast("string"), 4, "0"))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), slot.alias("incident_id"), F.col("text").alias("question"))


def _route_sql(column: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + f" THEN '{r}'" for r, words, _ in V.QUESTION_ROUTES if words) + " ELSE 'other' END"


register("answer_evidence", lambda s, d: V.answer_evidence(questions(s, d), case_events(s, d)).select("question_id", "incident_id", "route", "position", "event_id"), f"""
WITH q AS (SELECT conv_id * 1000 + turn AS question_id, 'SEC-' || lpad(CAST(conv_id % greatest((SELECT count(*) FROM inc), 1) + 1 AS VARCHAR), 4, '0') AS incident_id, {_route_sql('text')} AS route FROM conversations WHERE role = 'user')
SELECT question_id, q.incident_id, route, CAST(row_number() OVER (PARTITION BY question_id ORDER BY ts_us, seq) AS INTEGER) AS position, event_id FROM q JOIN inc_ev e ON e.incident_id = q.incident_id
WHERE CASE route WHEN 'network' THEN coalesce(dst_ip <> '', false) OR coalesce(domain <> '', false) WHEN 'identity' THEN event_type = 'authentication' OR coalesce(privilege <> '', false) WHEN 'process' THEN coalesce(process_name <> '', false) WHEN 'file' THEN coalesce(file_path <> '', false) ELSE true END
QUALIFY position <= CASE route WHEN 'before' THEN 6 WHEN 'other' THEN 8 ELSE 10 END""", "inc_ev")

_MATCHES = """CASE route WHEN 'network' THEN coalesce(dst_ip <> '', false) OR coalesce(domain <> '', false) WHEN 'identity' THEN event_type = 'authentication' OR coalesce(privilege <> '', false) WHEN 'process' THEN coalesce(process_name <> '', false)
  WHEN 'file' THEN coalesce(file_path <> '', false) ELSE true END"""
register("answer_evidence_all", lambda s, d: V.answer_evidence(questions(s, d), case_events(s, d), None).select("question_id", "incident_id", "route", "position", "event_id"), f"""
WITH q AS (SELECT conv_id * 1000 + turn AS question_id, 'SEC-' || lpad(CAST(conv_id % greatest((SELECT count(*) FROM inc), 1) + 1 AS VARCHAR), 4, '0') AS incident_id, {_route_sql('text')} AS route FROM conversations WHERE role = 'user')
SELECT question_id, q.incident_id, route, CAST(row_number() OVER (PARTITION BY question_id ORDER BY ts_us, seq) AS INTEGER) AS position, event_id FROM q JOIN inc_ev e ON e.incident_id = q.incident_id WHERE {_MATCHES}""", "inc_ev")

# ------------------------------------------------------------------------------------------ views
register("overview", lambda s, d: Q.overview(case_incidents(s, d)), """
SELECT CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (severity = 'high') > 0 THEN 'HIGH' WHEN count(*) > 0 THEN 'ELEVATED' ELSE 'LOW' END AS threat_level, count(*) AS active_incidents,
  count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, (SELECT count(DISTINCT u) FROM (SELECT unnest(users) AS u FROM inc)) AS suspicious_users, (SELECT count(DISTINCT h) FROM (SELECT unnest(hosts) AS h FROM inc)) AS affected_hosts FROM inc""", "inc")
register("severity_distribution", lambda s, d: Q.severity_distribution(case_incidents(s, d)).select("severity", "n"),
         "SELECT severity, count(i.incident_id) AS n FROM (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) s(severity) LEFT JOIN inc i USING (severity) GROUP BY severity", "inc")
register("phase_distribution", lambda s, d: Q.phase_distribution(case_incidents(s, d)), f"SELECT phase, label, count(*) AS n FROM (SELECT unnest(phases) AS phase FROM inc) JOIN {_PHASE_ROWS} USING (phase) GROUP BY phase, label", "inc")
register("top_incidents", lambda s, d: Q.top_incidents(case_incidents(s, d)).select("incident_id", "risk_score"), "SELECT incident_id, risk AS risk_score FROM inc ORDER BY risk DESC, first_ts, incident_id LIMIT 10", "inc")
register("list_incidents", lambda s, d: Q.list_incidents(case_incidents(s, d), severity="high", status="open").select("incident_id", "risk_score", "detections"), "SELECT incident_id, risk AS risk_score, n AS detections FROM inc WHERE severity = 'high' ORDER BY risk DESC, first_ts, incident_id", "inc")
register("threat_map_nodes", lambda s, d: Q.threat_map_nodes(case_incidents(s, d), sample_iocs(s, d)).select("type", "value", "incident_id", "risk_score", "known_malicious", "threat", "country"), """
WITH v AS (SELECT 'ip' AS type, unnest(external_ips) AS value, incident_id, risk FROM inc UNION ALL SELECT 'domain', unnest(domains), incident_id, risk FROM inc),
b AS (SELECT type, value, arg_max(incident_id, (risk, incident_id)) AS incident_id, max(risk) AS risk_score FROM v GROUP BY type, value)
SELECT b.type, b.value, b.incident_id, b.risk_score, h.value IS NOT NULL AS known_malicious, h.threat, h.country FROM b LEFT JOIN value_hits h ON h.kind = b.type AND h.observed = b.value
WHERE b.type = 'ip' OR h.value IS NOT NULL OR NOT (ends_with(b.value, '.local') OR ends_with(b.value, '.corp'))""", "inc", "value_hits")
register("threat_map_origins", lambda s, d: Q.threat_map_origins(case_incidents(s, d), case_events(s, d)).select("country", "incidents", "max_risk", F.array_join("users", ",").alias("users")), """
SELECT upper(geo_country) AS country, count(DISTINCT incident_id) AS incidents, max(risk) AS max_risk, array_to_string(list_sort(list(DISTINCT e."user") FILTER (e."user" <> '')), ',') AS users FROM inc_ev e JOIN inc i USING (incident_id)
WHERE geo_country <> '' AND upper(geo_country) <> 'IN' GROUP BY upper(geo_country)""", "inc_ev")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per user over the failed logins: each entry hashes its own text; links hold only where the entry
    before it exists, so most chains report their first break."""
    rows = telemetry(spark, sf_dir).where(F.col("action") == "login_failure").select(
        F.lower("user").alias("log_id"), F.col("seq"), F.col("event_id").alias("actor"), F.col("action"), F.col("host").alias("target"), F.lit("failure").alias("outcome"), F.lit("{}").alias("meta"), F.lit(Q.GENESIS).alias("prev_hash"), F.lit("2024-01-01T00:00:00").alias("timestamp"))
    return rows.where(F.col("log_id").isNotNull()).withColumn("hash", F.sha2(Q.audit_payload(), 256))


register("verify_audit_chain", lambda s, d: Q.verify_audit_chain(audit_log(s, d)).select("log_id", "entries", "valid", F.col("broken_at").cast("string").alias("broken_at"), "head"), """
WITH l AS (SELECT lower("user") AS log_id, seq, sha256('{"action": "login_failure", "actor": "' || event_id || '", "meta": {}, "outcome": "failure", "prev_hash": "' || repeat('0', 64) || '", "seq": ' || seq || ', "target": "' || host || '", "timestamp": "2024-01-01T00:00:00"}') AS hash
  FROM ev WHERE action = 'login_failure' AND "user" IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY seq) AS nth FROM l)
SELECT log_id, count(*) AS entries, count(*) = 1 AS valid, CAST(min(seq) FILTER (nth > 1) AS VARCHAR) AS broken_at, arg_max(hash, seq) AS head FROM r GROUP BY log_id""", "ev")
register("event_counters", lambda s, d: Q.event_counters(telemetry(s, d)), "SELECT tenant_id, source, count(*) AS n FROM ev GROUP BY ALL", "ev")
register("detection_counters", lambda s, d: Q.detection_counters(sample_detections(s, d)), "SELECT rule_id, severity, count(*) AS n FROM dt GROUP BY ALL", "dt")
register("open_incident_counters", lambda s, d: Q.open_incident_counters(case_incidents(s, d)).select("severity", "n"),
         "SELECT severity, count(i.incident_id) AS n FROM (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) s(severity) LEFT JOIN inc i USING (severity) GROUP BY severity", "inc")


# ------------------------------------------------------------------------------------- evaluation
def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled runs: the events of a user and day; the label comes from the labels table (toxic = attack)."""
    ev = telemetry(spark, sf_dir, keep_inputs=True)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("user_id"), F.when(F.col("toxic") == 1, "attack").otherwise("benign").alias("label"))
    day = F.floor(F.unix_micros("timestamp") / 86_400_000_000.0)
    runs = ev.groupBy("user_id", day.alias("day")).agg(F.collect_list("event_id").alias("event_ids"), F.max("k").alias("k"))
    names = F.array(*[F.lit(p) for p in PHASES])
    return runs.join(labels, "user_id").select(
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("scenario_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("run_id"), "label", "event_ids",
        F.array(F.element_at(names, F.col("k") % 13 + 1), F.lit("execution")).alias("expected_phases"), F.array(F.lit("T1078"), F.when(F.col("k") % 2 == 0, "T1041").otherwise("T1048")).alias("expected_techniques"))


part("runs", f"""SELECT 'S' || CAST(user_id % 5 AS VARCHAR) AS scenario_id, CAST(user_id AS VARCHAR) || '-' || CAST(day AS VARCHAR) AS run_id, label, ids, [{', '.join(repr(p) for p in PHASES)}][k % 13 + 1] AS p1, CASE WHEN k % 2 = 0 THEN 'T1041' ELSE 'T1048' END AS t2
FROM (SELECT user_id, CAST(floor(ts_us / 86400000000.0) AS BIGINT) AS day, list(event_id) AS ids, max(k) AS k FROM ev GROUP BY ALL) e JOIN (SELECT doc_id AS user_id, CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END AS label FROM labels) l USING (user_id)""", "ev")
part("matched", """WITH o AS (SELECT run_id, incident_id, count(DISTINCT event_id) AS n FROM (SELECT run_id, unnest(ids) AS event_id FROM runs) JOIN inc_ev USING (event_id) GROUP BY ALL)
SELECT r.*, b.incident_id, coalesce(b.n, 0) AS overlap FROM runs r LEFT JOIN (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, incident_id) = 1) b USING (run_id)""", "runs", "inc_ev")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.match_scenarios(scenarios(spark, sf_dir), case_events(spark, sf_dir))


register("match_scenarios", lambda s, d: _matched(s, d).select("run_id", "incident_id", "overlap"), "SELECT run_id, incident_id, overlap FROM matched", "matched")


def _scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = X.expected_ioc_hits(scenarios(spark, sf_dir), _observables(spark, sf_dir), sample_iocs(spark, sf_dir))
    got = case_detections(spark, sf_dir).groupBy("incident_id").agg(F.count_if(F.col("kind") == "threat_intel").alias("ioc_matched"))
    return X.scenario_scores(_matched(spark, sf_dir), case_incidents(spark, sf_dir), expected, got)


def _observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_observables(web_events(spark, sf_dir))


part("run_scores", """
WITH exp AS (SELECT run_id, CAST(sum(n) AS BIGINT) AS e FROM (SELECT run_id, unnest(ids) AS event_id FROM runs) JOIN (SELECT event_id, count(*) AS n FROM obs GROUP BY event_id) USING (event_id)
    WHERE event_id IN (SELECT h.event_id FROM hits h JOIN web w USING (event_id) WHERE NOT (h.kind = 'ip' AND h.observed <> coalesce(w.dst_ip, ''))) GROUP BY run_id),
got AS (SELECT incident_id, count(*) FILTER (kind = 'threat_intel') AS g FROM inc_det GROUP BY incident_id)
SELECT m.scenario_id, m.run_id, m.label, m.overlap > 0 AS detected, coalesce(i.risk, 0.0) AS risk, coalesce(i.severity, 'none') AS severity,
  len(list_intersect(list_distinct([p1, 'execution']), coalesce(i.phases, []))) / 2.0 AS phase_recall, len(list_intersect(['T1078', t2], coalesce(i.techniques, []))) / 2.0 AS technique_recall,
  CASE WHEN i.techniques IS NULL THEN 0.0 ELSE len(list_intersect(['T1078', t2], i.techniques)) / len(i.techniques) END AS technique_precision, coalesce(e, 0) AS ioc_expected,
  CASE WHEN coalesce(e, 0) > 0 THEN least(coalesce(g, 0), e) ELSE coalesce(g, 0) END AS ioc_matched, len(ids) AS evidence_expected, overlap AS evidence_covered, overlap / len(ids) AS evidence_coverage
FROM matched m LEFT JOIN inc i USING (incident_id) LEFT JOIN exp USING (run_id) LEFT JOIN got USING (incident_id)""", "matched", "hits", "inc_det")
register("scenario_scores", lambda s, d: _scored_runs(s, d).select("run_id", "detected", "phase_recall", "technique_recall", F.round("technique_precision", 6).alias("technique_precision"), "ioc_expected", "ioc_matched", F.round("evidence_coverage", 6).alias("evidence_coverage")),
         "SELECT run_id, detected, phase_recall, technique_recall, round(technique_precision, 6) AS technique_precision, ioc_expected, ioc_matched, round(evidence_coverage, 6) AS evidence_coverage FROM run_scores", "run_scores")
part("conf", """SELECT count(*) FILTER (label = 'attack' AND detected) AS tp, count(*) FILTER (label = 'benign' AND alarm) AS fp, count(*) FILTER (label = 'benign' AND NOT alarm) AS tn, count(*) FILTER (label = 'attack' AND NOT detected) AS fn
FROM (SELECT *, detected AND (severity IN ('high', 'critical') OR risk >= 40) AS alarm FROM run_scores)""", "run_scores")
register("confusion", lambda s, d: X.confusion(_scored_runs(s, d)), """
SELECT tp, fp, tn, fn, round(100 * coalesce(r, 0), 1) AS detection_rate, round(100 * coalesce(fp / nullif(fp + tn, 0), 0), 1) AS false_positive_rate, round(100 * coalesce(p, 0), 1) AS precision, round(100 * coalesce(2 * p * r / nullif(p + r, 0), 0), 1) AS f1
FROM (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM conf)""", "conf")
_MEAN = "round(100 * coalesce(avg({c}) FILTER ({f}), 0), 1) AS {c}"
_MEANS = ", ".join(_MEAN.format(c=c, f="{f}") for c in ("phase_recall", "technique_precision", "technique_recall", "evidence_coverage"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return X.quality_report(_scored_runs(spark, sf_dir), total)


register("quality_report", report, f"""
SELECT {_MEANS.format(f="label = 'attack' AND detected")}, round(100 * coalesce(sum(ioc_matched) FILTER (label = 'attack') / nullif(sum(ioc_expected) FILTER (label = 'attack'), 0), 1), 1) AS ioc_accuracy, fi AS false_incidents,
  round(fi / greatest((SELECT count(*) FROM events) - coalesce(sum(evidence_expected) FILTER (label = 'attack' AND detected), 0), 1) * 1000000, 2) AS false_per_million,
  round(round(fi / greatest((SELECT count(*) FROM events) - coalesce(sum(evidence_expected) FILTER (label = 'attack' AND detected), 0), 1) * 1000000, 2) * 50, 1) AS false_per_day
FROM run_scores, (SELECT fp AS fi FROM conf) GROUP BY fi""", "conf")
register("quality_by_scenario", lambda s, d: X.quality_by_scenario(_scored_runs(s, d)), f"""SELECT scenario_id, count(*) AS runs, count(*) FILTER (detected) AS detected_runs, round(100 * avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END), 1) AS detection_rate,
  {_MEANS.format(f="detected")}, round(coalesce(avg(risk) FILTER (detected), 0), 1) AS mean_risk FROM run_scores WHERE label = 'attack' GROUP BY scenario_id""", "run_scores")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source event kinds of the telemetry; registry and process ends count as inert here."""
    ev = telemetry(spark, sf_dir, keep_inputs=True)
    return X.schema_coverage(ev.select((F.col("k") % 10).alias("source_event_id"), F.when(F.col("event_type") == "process_end", "system_log").otherwise(F.col("event_type")).alias("event_type")))


register("schema_coverage", coverage, "SELECT k % 10 AS source_event_id, count(*) AS seen, count(*) FILTER (event_type <> 'process_end') AS mapped, count(*) FILTER (event_type = 'process_end') AS dropped FROM ev GROUP BY ALL", "ev")
register("schema_coverage_pct", lambda s, d: X.coverage_pct(coverage(s, d)), "SELECT count(*) AS records, count(*) FILTER (event_type <> 'process_end') AS mapped, round(100.0 * count(*) FILTER (event_type <> 'process_end') / count(*), 1) AS coverage_pct FROM ev", "ev")


def _truth(spark: SparkSession) -> DataFrame:
    return read_techniques(spark).select(F.col("technique_id").alias("technique"))


register("technique_recall", lambda s, d: X.technique_recall(case_incidents(s, d), _truth(s)), f"SELECT technique_id AS technique, technique_id IN (SELECT unnest(techniques) FROM inc) AS found FROM {_CATALOG}", "inc")
register("technique_recall_pct", lambda s, d: X.recall_pct(X.technique_recall(case_incidents(s, d), _truth(s))),
         f"SELECT count(*) AS techniques, count(*) FILTER (f) AS found, round(100.0 * count(*) FILTER (f) / count(*), 1) AS recall_pct FROM (SELECT technique_id IN (SELECT unnest(techniques) FROM inc) AS f FROM {_CATALOG})", "inc")
register("rules_fired", lambda s, d: X.rules_fired(sample_detections(s, d), 15), "SELECT rule_id, count(*) AS fired FROM dt GROUP BY rule_id ORDER BY fired DESC, rule_id LIMIT 15", "dt")
register("compare_runs", lambda s, d: X.compare_runs(_observed(s, d), M.observed_techniques(case_incidents(s, d)).select("technique")),
         """SELECT coalesce(b.t, a.t) AS technique, CASE WHEN a.t IS NULL THEN 'lost' WHEN b.t IS NULL THEN 'gained' ELSE 'kept' END AS change FROM (SELECT DISTINCT technique AS t FROM seen_techs WHERE technique IS NOT NULL) b
  FULL JOIN (SELECT DISTINCT unnest(techniques) AS t FROM inc) a ON a.t = b.t""", "seen_techs", "inc")


def incident_measures(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    """Measures of the incidents that began before, or since, the middle of the month, by severity: two runs to compare."""
    middle = F.lit("2024-01-16").cast("timestamp")
    own = case_incidents(spark, sf_dir).where(F.col("first_event_at") < middle if first else F.col("first_event_at") >= middle)
    rows = own.groupBy("severity").agg(
        F.count(F.lit(1)).alias("incidents"), F.sum("detections").alias("detections"), F.round(F.avg("risk_score"), 3).alias("mean_risk"),
        F.max(F.size("affected_hosts")).alias("most_hosts"), F.sum(F.size("techniques")).alias("techniques"))
    return X.as_metrics(rows, "severity")


_MEASURES = {"incidents": "count(*)", "detections": "sum(n)", "mean_risk": "round(avg(risk), 3)", "most_hosts": "max(len(hosts))", "techniques": "sum(len(techniques))"}
register("compare_metrics", lambda s, d: X.compare_metrics(incident_measures(s, d, True), incident_measures(s, d, False), "severity"), "WITH m AS (" + " UNION ALL ".join(
    f"SELECT first_ts < epoch_us(TIMESTAMP '2024-01-16') AS early, severity, '{name}' AS metric, CAST({sql} AS DOUBLE) AS v FROM inc GROUP BY ALL" for name, sql in _MEASURES.items()) + """)
SELECT severity, metric, b.v AS before, a.v AS after, round(a.v - b.v, 3) AS delta, round((a.v - b.v) * 100 / nullif(abs(b.v), 0), 1) AS delta_pct,
  CASE WHEN b.v IS NULL THEN 'new' WHEN a.v IS NULL THEN 'gone' WHEN a.v > b.v THEN 'up' WHEN a.v < b.v THEN 'down' ELSE 'same' END AS change
FROM (SELECT * FROM m WHERE early) b FULL JOIN (SELECT * FROM m WHERE NOT early) a USING (severity, metric)""", "inc")
register("effective_phase", lambda s, d: sample_detections(s, d).select("detection_id", effective_phase().alias("phase")), "SELECT detection_id, stage AS phase FROM cases", "cases")
