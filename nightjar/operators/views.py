"""Reporting views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightjar.operators.attack import phase_table
from nightjar.operators.incidents import is_open
from nightjar.operators.intel import match_observables
from nightjar.schema import SEVERITIES, filled

TOP_INCIDENTS, LIST_LIMIT, ORIGIN_USERS = 10, 100, 6  # fixed values
INTERNAL_SUFFIXES = [".local", ".corp"]  # fixed value
GENESIS = "0" * 64  # fixed value: hash before the first audit entry


def overview(incidents: DataFrame) -> DataFrame:
    """Threat level and counts over open incidents, one row."""
    opened = incidents.where(is_open())
    counts = opened.agg(
        F.count(F.lit(1)).alias("active_incidents"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    users = opened.select(F.explode("affected_users").alias("u")).agg(F.count_distinct("u").alias("suspicious_users"))
    hosts = opened.select(F.explode("affected_hosts").alias("h")).agg(F.count_distinct("h").alias("affected_hosts"))
    level = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 0, "HIGH").when(F.col("active_incidents") > 0, "ELEVATED").otherwise("LOW")
    one = F.lit(1).alias("one")
    return counts.select("*", one).join(users.select("*", one), "one").join(hosts.select("*", one), "one").select(
        level.alias("threat_level"), "active_incidents", "critical", "high", "suspicious_users", "affected_hosts")


def severity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(SEVERITIES)], "severity_rank int, severity string")


def severity_distribution(incidents: DataFrame) -> DataFrame:
    counts = incidents.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return severity_table(incidents.sparkSession).join(counts, "severity", "left").select("severity", "severity_rank", F.coalesce("n", F.lit(0)).alias("n"))


def phase_distribution(incidents: DataFrame) -> DataFrame:
    counts = incidents.select(F.explode("phases").alias("phase")).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(phase_table(incidents.sparkSession)), "phase").select("phase", "label", "n").orderBy(F.desc("n"), "phase")


def top_incidents(incidents: DataFrame, n: int = TOP_INCIDENTS) -> DataFrame:
    return incidents.orderBy(F.desc("risk_score"), "first_event_at", "incident_id").limit(n)


def list_incidents(incidents: DataFrame, severity: str | None = None, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Incidents by risk, all of them unless ``limit`` says how many a page shows (``LIST_LIMIT`` is the usual size)."""
    rows = incidents
    if severity:
        rows = rows.where(F.col("severity") == severity)
    if status:
        rows = rows.where(F.col("status") == status)
    rows = rows.orderBy(F.desc("risk_score"), "first_event_at", "incident_id")
    return rows if limit is None else rows.limit(limit)


def threat_map_nodes(incidents: DataFrame, iocs: DataFrame) -> DataFrame:
    """Outside addresses and domains of incidents with their listing; the riskiest incident per value stands."""
    items = F.concat(
        F.transform("external_ips", lambda v: F.struct(F.lit("ip").alias("type"), v.alias("value"))), F.transform("domains", lambda v: F.struct(F.lit("domain").alias("type"), v.alias("value"))))
    rows = incidents.select("incident_id", "risk_score", F.inline(items))
    best = rows.groupBy("type", "value").agg(F.max_by(F.struct("incident_id", "risk_score"), F.struct("risk_score", "incident_id")).alias("top")).select("type", "value", "top.*")
    listed = match_observables(best.select("value", F.col("type").alias("kind"), F.col("value").alias("observed")), iocs, ["value", "kind"]) \
        .select("value", F.col("kind").alias("type"), F.col("ioc.threat").alias("threat"), F.col("ioc.country").alias("country"), F.lit(True).alias("known"))
    inside = F.lit(False)
    for s in INTERNAL_SUFFIXES:
        inside = inside | F.col("value").endswith(s)
    joined = best.join(listed, ["value", "type"], "left").withColumn("known_malicious", F.coalesce("known", F.lit(False)))
    return joined.where((F.col("type") == "ip") | F.col("known_malicious") | ~inside).select("type", "value", "incident_id", "risk_score", "known_malicious", "threat", "country")


def threat_map_origins(incidents: DataFrame, incident_events: DataFrame, home: str = "IN", users: int | None = None) -> DataFrame:
    """Foreign login countries in incident evidence, with all users, or the first ``users`` (``ORIGIN_USERS`` fit a map label)."""
    country = F.upper("geo_country")
    rows = incident_events.where(filled(F.col("geo_country")) & (country != home.upper())).groupBy("incident_id", country.alias("country"), "user").agg(F.count(F.lit(1)).alias("n")) \
        .join(incidents.select("incident_id", "risk_score"), "incident_id")
    named = F.array_sort(F.collect_set(F.when(filled(F.col("user")), F.col("user"))))
    return rows.groupBy("country").agg(
        F.count_distinct("incident_id").alias("incidents"), F.max("risk_score").alias("max_risk"),
        (named if users is None else F.slice(named, 1, users)).alias("users")).orderBy(F.desc("max_risk"), "country")


# ------------------------------------------------------------------------------------------- audit
def audit_payload() -> Column:
    """Canonical text of an audit entry: keys in name order, as JSON."""
    def text(name: str) -> Column:
        quoted = F.to_json(F.array(F.col(name)))
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)

    parts = ['{"action": ', text("action"), ', "actor": ', text("actor"), ', "meta": ', F.coalesce(F.col("meta"), F.lit("{}")), ', "outcome": ', text("outcome"),
             ', "prev_hash": ', text("prev_hash"), ', "seq": ', F.col("seq").cast("string"), ', "target": ', text("target"), ', "timestamp": ', text("timestamp"), "}"]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def verify_audit_chain(log: DataFrame) -> DataFrame:
    """Recompute every entry hash and its link to the entry before; report the first break.

    The link needs the previous hash only: an equi-join on ``seq`` in one log, no ordering of the whole log.
    """
    entries = log.withColumn("own", F.sha2(audit_payload(), 256))
    before = log.select("log_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before_hash"))
    first = log.groupBy("log_id").agg(F.min("seq").alias("first_seq"))
    linked = entries.join(before, ["log_id", "seq"], "left").join(first, "log_id")
    expected = F.when(F.col("seq") == F.col("first_seq"), F.lit(GENESIS)).otherwise(F.col("before_hash"))
    broken = (F.col("own") != F.col("hash")) | ~F.col("prev_hash").eqNullSafe(expected)
    return linked.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("entries"), F.min(F.when(broken, F.col("seq"))).alias("broken_at"), F.max_by("hash", "seq").alias("head")) \
        .withColumn("valid", F.col("broken_at").isNull())


def event_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant_id", "source").agg(F.count(F.lit(1)).alias("n"))


def detection_counters(detections: DataFrame) -> DataFrame:
    return detections.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def open_incident_counters(incidents: DataFrame) -> DataFrame:
    return severity_distribution(incidents.where(is_open()))
