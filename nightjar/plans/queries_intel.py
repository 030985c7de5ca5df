"""Queries for threat-intelligence look-ups. Indicators are derived from the telemetry and the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightjar.operators import intel as I
from nightjar.plans.adapter import telemetry
from nightjar.plans.queries_detect import _recursive_cooldown
from nightjar.plans.registry import part, register
from nightjar.schema import seconds

# Indicator rows as portable SQL over a view of the telemetry (ev) and the pages: distinct observed values.
_IOC_VALUES = """
SELECT DISTINCT dst_ip AS value, 'ip' AS type FROM ev WHERE event_type = 'network_connection' AND k >= 92
UNION ALL SELECT DISTINCT '91.' || CAST(k AS STRING) || '.3.0/30', 'cidr' FROM ev WHERE event_type = 'network_connection' AND k >= 60 AND k < 75
UNION ALL SELECT DISTINCT '91.' || CAST(k - 2 AS STRING) || '.0.0/15', 'cidr' FROM ev WHERE event_type = 'network_connection' AND k = 72
UNION ALL SELECT DISTINCT substr(domain, 4), 'domain' FROM ev WHERE domain LIKE 'h1.badsite.%'
UNION ALL SELECT DISTINCT domain, 'domain' FROM ev WHERE domain LIKE 'h2.badsite.%' OR domain LIKE 'Files.MEGA%'
UNION ALL SELECT DISTINCT url, 'url' FROM ev WHERE url LIKE '%/p/15' OR url LIKE '%/p/55'
UNION ALL SELECT DISTINCT url, 'url' FROM pages WHERE url LIKE '%#top'
UNION ALL SELECT DISTINCT file_hash, 'hash' FROM ev WHERE file_hash IS NOT NULL AND k < 40
"""
_IOC_ATTRIBUTES = """
SELECT value, type, 'family' || CAST(length(value) % 5 AS STRING) AS threat, 'feed' || CAST(length(value) % 3 AS STRING) AS source,
  CAST(5 + length(value) % 5 AS DOUBLE) / 10 AS confidence, CASE length(value) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'odd' END AS severity,
  CASE WHEN length(value) % 2 = 0 THEN 'RU' END AS country FROM ({values})"""

part("ioc", _IOC_ATTRIBUTES.format(values=_IOC_VALUES).replace("SELECT value,", "SELECT row_number() OVER (ORDER BY type, value) - 1 AS load_seq, value,", 1), "ev")


def sample_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators with load order."""
    ev = telemetry(spark, sf_dir, keep_inputs=True)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = spark.sql(_IOC_ATTRIBUTES.format(values=_IOC_VALUES.replace("FROM ev", "FROM {ev}").replace("FROM pages", "FROM {pages}")), ev=ev, pages=pages)
    full = rows.withColumns({"first_seen": F.lit(None).cast("string"), "tags": F.array().cast("array<string>"), "reference": F.lit(None).cast("string")})
    return I.with_load_order(full, ["type", "value"])


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry plus one visit per page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("event_id"), F.lit("t0").alias("tenant_id"), F.lit("proxy").alias("host"), "url",
        (F.col("page_id") + 1_000_000_000).alias("seq"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60).alias("timestamp"))
    return telemetry(spark, sf_dir).unionByName(pages, allowMissingColumns=True)


part("web", """SELECT event_id, tenant_id, host, "user", dst_ip, src_ip, domain, url, file_hash, seq, ts_us FROM ev UNION ALL
SELECT 'page_' || CAST(page_id AS VARCHAR), 't0', 'proxy', NULL, NULL, NULL, NULL, url, NULL, page_id + 1000000000, (1704067200 + page_id * 60) * 1000000 FROM pages""", "ev")
part("obs_raw", """
SELECT event_id, 1 AS ord, 'ip' AS kind, dst_ip AS observed FROM web WHERE dst_ip <> '' UNION ALL SELECT event_id, 2, 'ip', src_ip FROM web WHERE src_ip <> ''
UNION ALL SELECT event_id, 3, 'domain', domain FROM web WHERE domain <> '' UNION ALL SELECT event_id, 4, 'url', url FROM web WHERE url <> ''
UNION ALL SELECT event_id, 5, 'domain', split_part(split_part(url, '//', 2), '/', 1) FROM web WHERE contains(url, '//') AND split_part(split_part(url, '//', 2), '/', 1) <> ''
UNION ALL SELECT event_id, 6, 'hash', file_hash FROM web WHERE file_hash <> ''""", "web")
part("obs", "SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY ord) - 1 AS pos, kind, observed FROM obs_raw", "obs_raw")
_NUM = """(CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT))"""
_V4 = "regexp_full_match({c}, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+')"
part("cidr", f"""SELECT *, (a // sz) * sz AS lo, (a // sz) * sz + sz - 1 AS hi FROM (SELECT *, {_NUM.format(c="split_part(value, '/', 1)")} AS a,
  CAST(pow(2, 32 - CAST(split_part(value, '/', 2) AS INTEGER)) AS BIGINT) AS sz FROM ioc WHERE type = 'cidr')""", "ioc")
# all ways an observed value can hit an indicator, best first
part("value_hits", f"""
WITH v AS (SELECT DISTINCT kind, observed FROM obs), n AS (SELECT observed, {_NUM.format(c="observed")} AS num FROM v WHERE kind = 'ip' AND {_V4.format(c="observed")}),
cand AS (
  SELECT v.kind, v.observed, i.load_seq, 0 AS rank FROM v JOIN ioc i ON v.kind = 'ip' AND i.type = 'ip' AND lower(i.value) = v.observed
  UNION ALL SELECT 'ip', n.observed, c.load_seq, 1 FROM n JOIN cidr c ON n.num BETWEEN c.lo AND c.hi
  UNION ALL SELECT v.kind, v.observed, i.load_seq, 1000 - length(i.value) FROM v JOIN ioc i ON v.kind = 'domain' AND i.type = 'domain' AND contains(v.observed, '.')
    AND (lower(v.observed) = lower(i.value) OR ends_with(lower(v.observed), '.' || lower(i.value)))
  UNION ALL SELECT v.kind, v.observed, i.load_seq, 0 FROM v JOIN ioc i ON v.kind = 'url' AND i.type = 'url' AND lower(i.value) = lower(v.observed)
  UNION ALL SELECT v.kind, v.observed, i.load_seq, 0 FROM v JOIN ioc i ON v.kind = 'hash' AND i.type = 'hash' AND lower(i.value) = lower(v.observed))
SELECT c.kind, c.observed, i.* FROM cand c JOIN ioc i USING (load_seq) QUALIFY row_number() OVER (PARTITION BY c.kind, c.observed ORDER BY c.rank, c.load_seq) = 1""", "obs", "cidr")
part("hits", "SELECT o.event_id, o.pos, o.kind, o.observed, h.* EXCLUDE (kind, observed) FROM obs o JOIN value_hits h USING (kind, observed)", "value_hits")


register("extract_observables", lambda s, d: I.extract_observables(web_events(s, d)).select("event_id", "pos", "kind", "observed"), "SELECT event_id, pos, kind, observed FROM obs", "obs")


def _hits_of(*kinds: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = I.ti_hits(web_events(spark, sf_dir), sample_iocs(spark, sf_dir))
        return found.where(F.col("kind").isin(list(kinds))).select("event_id", "pos", "observed", F.col("ioc.value").alias("ioc_value"), F.col("ioc.type").alias("ioc_type"))
    return run


_HIT_SQL = "SELECT event_id, pos, observed, value AS ioc_value, type AS ioc_type FROM hits WHERE kind IN ({k})"
register("lookup_ip_and_cidr", _hits_of("ip"), _HIT_SQL.format(k="'ip'"), "hits")
register("lookup_domain", _hits_of("domain"), _HIT_SQL.format(k="'domain'"), "hits")
register("lookup_url_and_hash", _hits_of("url", "hash"), _HIT_SQL.format(k="'url', 'hash'"), "hits")


def lookup_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses against the netblocks alone: the first block in load order stands."""
    iocs = sample_iocs(spark, sf_dir).where(F.col("type") == "cidr")
    seen = telemetry(spark, sf_dir).where(F.col("dst_ip").isNotNull()).select(F.col("dst_ip").alias("ip")).distinct()
    found = I.match_observables(seen.select("ip", F.lit("ip").alias("kind"), F.col("ip").alias("observed")), iocs, ["ip"])
    return found.select("ip", F.col("ioc.value").alias("netblock"))


register("lookup_cidr", lookup_cidr, f"""SELECT ip, value AS netblock FROM (SELECT DISTINCT dst_ip AS ip FROM ev WHERE {_V4.format(c="dst_ip")}) d JOIN cidr c ON {_NUM.format(c="d.ip")} BETWEEN c.lo AND c.hi
QUALIFY row_number() OVER (PARTITION BY ip ORDER BY load_seq) = 1""", "cidr")


def ti_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.ti_match(web_events(spark, sf_dir), sample_iocs(spark, sf_dir), 86_400)
    e = F.col("entities")
    return d.select(F.element_at("evidence_event_ids", 1).alias("event_id"), "rule_id", "severity", F.round("score", 4).alias("score"), "confidence", F.array_join("techniques", ",").alias("techniques"), "phase",
                    e["user"].alias("user"), e["host"].alias("host"), e["dst_ip"].alias("dst_ip"), e["domain"].alias("domain"), F.col("details")["ioc_value"].alias("ioc_value"))


_TI_SOURCE = """SELECT w.tenant_id || '|' || coalesce(w.host, '?') || '|' || h.value AS gkey, w.ts_us, w.seq * 8 + h.pos AS ord, h.*, w."user", w.host, w.dst_ip, w.domain FROM hits h JOIN web w USING (event_id)"""
register("ti_match", ti_detections, _recursive_cooldown(_TI_SOURCE, seconds(86_400), """event_id, 'TI-' || upper(type) AS rule_id, CASE WHEN severity = 'odd' THEN 'high' ELSE severity END AS severity,
  round(CASE severity WHEN 'low' THEN 20.0 WHEN 'medium' THEN 35.0 WHEN 'critical' THEN 75.0 ELSE 55.0 END * (0.7 + 0.3 * confidence), 4) AS score, confidence,
  CASE type WHEN 'domain' THEN 'T1071.001,T1568' WHEN 'url' THEN 'T1105,T1566.002' WHEN 'hash' THEN 'T1204.002' ELSE 'T1071.001' END AS techniques,
  CASE type WHEN 'url' THEN 'initial_access' WHEN 'hash' THEN 'execution' ELSE 'command_and_control' END AS phase,
  "user", host, CASE WHEN kind = 'ip' THEN dst_ip END AS dst_ip, domain, value AS ioc_value"""), "hits")
register("ti_cooldown", lambda s, d: I.ti_cooldown(I.ti_hits(web_events(s, d), sample_iocs(s, d))).select("event_id", "pos", F.col("ioc.value").alias("ioc_value")),
         _recursive_cooldown(_TI_SOURCE, seconds(900), "event_id, pos, value AS ioc_value"), "hits")
register("ioc_stats", lambda s, d: I.ioc_stats(sample_iocs(s, d)), """SELECT 'type' AS facet, type AS name, count(*) AS n FROM
  (SELECT type, CASE WHEN type = 'cidr' THEN value ELSE lower(value) END AS key FROM ioc GROUP BY ALL) GROUP BY type
UNION ALL SELECT 'feed', source, count(*) FROM ioc GROUP BY source""", "ioc")


def lookup_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free search: every observed value through all look-ups."""
    values = I.extract_observables(web_events(spark, sf_dir)).select(F.col("observed").alias("value"))
    found = I.ioc_lookup(values, sample_iocs(spark, sf_dir))
    return found.select("searched", "found_as", "ioc_value", "threat", "country")


register("ioc_lookup", lookup_values, f"""
WITH s AS (SELECT DISTINCT observed AS searched FROM obs), n AS (SELECT searched, {_NUM.format(c="searched")} AS num FROM s WHERE {_V4.format(c="searched")}),
cand AS (
  SELECT searched, 'ip' AS found_as, 0 AS pri, 0 AS rank, load_seq FROM s JOIN ioc i ON i.type = 'ip' AND lower(i.value) = searched
  UNION ALL SELECT searched, 'ip', 0, 1, c.load_seq FROM n JOIN cidr c ON num BETWEEN lo AND hi
  UNION ALL SELECT searched, 'domain', 1, 1000 - length(i.value), load_seq FROM s JOIN ioc i ON i.type = 'domain' AND contains(searched, '.') AND (lower(searched) = lower(i.value) OR ends_with(lower(searched), '.' || lower(i.value)))
  UNION ALL SELECT searched, 'hash', 2, 0, load_seq FROM s JOIN ioc i ON i.type = 'hash' AND lower(i.value) = lower(searched)
  UNION ALL SELECT searched, 'url', 3, 0, load_seq FROM s JOIN ioc i ON i.type = 'url' AND lower(i.value) = lower(searched))
SELECT searched, found_as, i.value AS ioc_value, i.threat, i.country FROM cand JOIN ioc i USING (load_seq) QUALIFY row_number() OVER (PARTITION BY searched ORDER BY pri, rank, load_seq) = 1""", "obs", "cidr")
