"""Clusters -> incidents: scoring, admission, phases, titles, numbering, slow burn, status carry-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from nightjar.functions.net import is_private_ip
from nightjar.operators.attack import phase_table, tactic_of
from nightjar.operators.ordered import with_row_index
from nightjar.schema import OPEN_STATUSES, PHASES, SEVERITIES, STATUSES, filled, micros, rank_of
from nightjar.session import materialize

# --- fixed values -------------------------------------------------------------------------------
PHASE_WEIGHT = {
    "initial_access": 4, "execution": 4, "persistence": 5, "privilege_escalation": 6, "defense_evasion": 5,
    "credential_access": 6, "discovery": 3, "lateral_movement": 7, "collection": 5, "command_and_control": 6,
    "exfiltration": 9, "impact": 10,
}
OTHER_PHASE_WEIGHT, CHAIN_FACTOR, CHAIN_CAP = 3, 0.6, 25.0
CRITICAL_HOST_PREFIXES = ["DC-", "DB-", "FS-", "API-", "PRD-", "SRV-", "ERP-"]
CRITICAL_USER_PREFIXES = ["adm-", "da-", "administrator", "svc-backup", "svc-sql"]
TI_STEP, TI_CAP, HOST_BONUS, USER_BONUS, BREADTH_STEP, BREADTH_CAP = 6.0, 12.0, 8.0, 6.0, 3.0, 10.0
SEVERITY_STEPS = [(85, "critical"), (65, "high"), (40, "medium"), (20, "low")]
RISK_FLOOR = 40.0
# ------------------------------------------------------------------------------------------------


def weighted_score() -> Column:
    """Score dampened by confidence, clamped to 0..100."""
    return F.least(F.greatest(F.col("score") * (0.6 + 0.4 * F.col("confidence")), F.lit(0.0)), F.lit(100.0))


def noisy_or() -> Column:
    """Aggregate: independent evidence compounds and never exceeds 100."""
    return 100.0 * (1.0 - F.product(1.0 - weighted_score() / 100.0))


def effective_phase() -> Column:
    """Phase of a detection, or the tactic of its first technique."""
    return F.coalesce("phase", tactic_of(F.try_element_at("techniques", F.lit(1))))


def _phase_weight(phase: Column) -> Column:
    known = F.create_map(*[F.lit(v) for p, w in PHASE_WEIGHT.items() for v in (p, float(w))])
    return F.coalesce(F.try_element_at(known, phase), F.lit(float(OTHER_PHASE_WEIGHT)))


def _starts_with_any(values: Column, prefixes: list[str]) -> Column:
    def test(v: Column) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | v.startswith(p)
        return out
    return F.exists(values, test)


def severity_bucket(risk: Column) -> Column:
    out = F.lit("info")
    for floor, name in reversed(SEVERITY_STEPS):
        out = F.when(risk >= floor, name).otherwise(out)
    return out


def score_clusters(detections: DataFrame) -> DataFrame:
    """Risk, its terms, confidence and severity per ``cluster``; one aggregation with map-side combine."""
    d = detections.withColumn("stage", effective_phase())
    ents = F.col("entities")
    agg = d.groupBy("tenant_id", "cluster").agg(
        noisy_or().alias("base"), F.collect_set("stage").alias("stages"),
        F.count_if(F.col("kind") == "threat_intel").alias("ti_hits"), F.collect_set("kind").alias("kinds"),
        F.array_sort(F.collect_set(F.when(filled(ents["host"]), ents["host"]))).alias("affected_hosts"),
        F.array_sort(F.collect_set(F.when(filled(ents["user"]), ents["user"]))).alias("affected_users"),
        F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("detections"),
        F.max(rank_of(SEVERITIES, F.col("severity"))).alias("worst"), F.count_distinct("rule_id").alias("rules"),
        F.array_sort(F.flatten(F.collect_set("techniques"))).alias("all_techniques"),
        F.min("timestamp").alias("first_detection"), F.max("timestamp").alias("last_detection"),
        F.min(F.struct("timestamp", "detection_id")).alias("first_key"),
        F.max_by("title", F.struct(F.col("score"), -micros(F.col("timestamp")), "detection_id")).alias("top_title"),
        F.array_distinct(F.flatten(F.collect_set(F.split(F.coalesce(F.nullif(F.col("details")["tags"], F.lit("")), F.lit("")), ",")))).alias("detail_tags"),
    )
    chain = F.aggregate("stages", F.lit(0.0), lambda a, p: a + _phase_weight(p)) * CHAIN_FACTOR
    hosts, users = F.col("affected_hosts"), F.col("affected_users")
    scored = agg.withColumns({
        "chain_bonus": F.when(F.size("stages") >= 2, F.least(chain, F.lit(CHAIN_CAP))).otherwise(0.0),
        "ti_bonus": F.least(F.lit(TI_CAP), TI_STEP * F.col("ti_hits")),
        "asset_bonus": F.when(_starts_with_any(F.transform(hosts, F.upper), CRITICAL_HOST_PREFIXES), HOST_BONUS).otherwise(0.0)
        + F.when(_starts_with_any(F.transform(users, F.lower), CRITICAL_USER_PREFIXES), USER_BONUS).otherwise(0.0),
        "breadth_bonus": F.when(F.size(hosts) > 1, F.least(F.lit(BREADTH_CAP), BREADTH_STEP * (F.size(hosts) - 1))).otherwise(0.0),
    }).withColumn("raw_total", F.col("base") + F.col("chain_bonus") + F.col("ti_bonus") + F.col("asset_bonus") + F.col("breadth_bonus"))
    confidence = (
        F.col("mean_confidence") * F.least(F.lit(1.0), 0.55 + 0.15 * F.size("kinds")) * F.least(F.lit(1.0), 0.6 + 0.1 * F.col("detections"))
        + F.when(F.col("ti_hits") > 0, 0.05).otherwise(0.0)
    )
    return (
        scored.withColumn("risk_score", F.round(F.least(F.lit(100.0), F.col("raw_total")), 1))
        .withColumn("confidence", F.round(F.least(F.lit(0.99), confidence), 2))
        .withColumn("severity", severity_bucket(F.col("risk_score")))
        .withColumn("techniques", F.array_distinct("all_techniques"))
        .withColumn("phases", F.filter(F.array(*[F.lit(p) for p in PHASES]), lambda p: F.array_contains(F.col("stages"), p)))
        .withColumn("score_breakdown", F.struct(
            F.round("base", 1).alias("detections_noisy_or"), F.round("chain_bonus", 1).alias("kill_chain_bonus"),
            F.round("ti_bonus", 1).alias("threat_intel_bonus"), F.round("asset_bonus", 1).alias("asset_criticality_bonus"),
            F.round("breadth_bonus", 1).alias("breadth_bonus"), F.round("raw_total", 1).alias("raw_total"), F.col("risk_score").alias("capped")))
    )


def admission_filter(scored: DataFrame, floor: float = RISK_FLOOR) -> DataFrame:
    """Drop a lone anomaly, and weak single-rule clusters below the risk floor."""
    lone = (F.col("detections") == 1) & (F.col("kinds")[0] == "anomaly")
    weak = (F.col("risk_score") < floor) & (F.col("worst") < SEVERITIES.index("high")) & (F.col("rules") < 2)
    return scored.where(~lone & ~weak)


def incident_title() -> Column:
    """Headline from the present phases, in a fixed order of precedence."""
    phases, users, hosts = F.col("phases"), F.col("affected_users"), F.col("affected_hosts")
    host = F.try_element_at(hosts, F.lit(1))
    who = F.coalesce(F.try_element_at(users, F.lit(1)), host, F.lit("unknown"))
    target = F.coalesce(host, who)
    place = F.concat(who, F.when((F.size(hosts) > 0) & (F.size(users) > 0), F.concat(F.lit(" on "), host)).otherwise(""))

    def has(p: str) -> Column:
        return F.array_contains(phases, p)

    return (
        F.when((has("exfiltration") | has("collection")) & has("execution"), F.concat(F.lit("Compromise with execution and data theft: "), place))
        .when(has("impact"), F.concat(F.lit("Destructive activity on "), target))
        .when(has("lateral_movement"), F.concat(who, F.lit(" moving across "), F.size(hosts).cast("string"), F.lit(" host(s)")))
        .when(has("credential_access") & has("initial_access"), F.concat(F.lit("Account break-in: "), who))
        .when(has("exfiltration"), F.concat(F.lit("Data leaving "), target))
        .when(has("persistence") | has("privilege_escalation"), F.concat(F.lit("Foothold or elevation on "), target))
        .when(has("command_and_control"), F.concat(F.lit("Remote-control traffic from "), target))
        .otherwise(F.concat(F.col("top_title"), F.lit(": "), place))
    )


def incident_evidence(detections: DataFrame) -> DataFrame:
    """Child table ``(cluster, event_id)`` of cited events."""
    return detections.select("tenant_id", "cluster", F.explode("evidence_event_ids").alias("event_id")).distinct()


def _network_context(detections: DataFrame, events: DataFrame | None) -> DataFrame | None:
    """Public addresses, domains and the time span of the cited events per cluster."""
    own = detections.select("tenant_id", "cluster", F.col("entities")["dst_ip"].alias("dst_ip"), F.lit(None).cast("string").alias("domain"),
                            F.lit(None).cast("timestamp").alias("event_time"))
    if events is not None:
        cited = incident_evidence(detections).join(events.select("tenant_id", "event_id", "dst_ip", "domain", F.col("timestamp").alias("event_time")), ["tenant_id", "event_id"])
        own = own.unionByName(cited.select(*own.columns))
    ip = F.col("dst_ip")
    return own.groupBy("tenant_id", "cluster").agg(
        F.array_sort(F.collect_set(F.when(filled(ip) & ~is_private_ip(ip), ip))).alias("external_ips"),
        F.array_sort(F.collect_set(F.when(filled(F.col("domain")), F.col("domain")))).alias("domains"),
        F.min("event_time").alias("first_cited"), F.max("event_time").alias("last_cited"))


def number_incidents(incidents: DataFrame) -> DataFrame:
    """``SEC-0001`` upwards in order of the first detection, numbered block by block."""
    keyed = incidents.withColumn("order_ts", micros(F.col("first_key.timestamp"))).withColumn("order_id", F.col("first_key.detection_id"))
    indexed = with_row_index(keyed, [], ["order_ts", "order_id"])
    number = (F.col("row_index") + 1).cast("string")
    return indexed.withColumn("incident_id", F.concat(F.lit("SEC-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))) \
        .drop("row_index", "order_ts", "order_id")


def build_incidents(detections: DataFrame, events: DataFrame | None = None, floor: float = RISK_FLOOR, admit: bool = True) -> DataFrame:
    """Incidents of clustered detections (column ``cluster``), scored, admitted, titled and numbered."""
    scored = score_clusters(detections)
    admitted = admission_filter(scored, floor) if admit else scored
    context = _network_context(detections, events)
    full = admitted.join(context, ["tenant_id", "cluster"], "left").withColumns({
        "title": incident_title(),
        "first_event_at": F.least("first_detection", F.coalesce("first_cited", "first_detection")),
        "last_event_at": F.greatest("last_detection", F.coalesce("last_cited", "last_detection")),
        "tags": F.array_sort(F.array_remove(F.array_union("detail_tags", "kinds"), "")),
        "status": F.lit("open"), "summary": F.lit(""),
    })
    return number_incidents(full).select(
        "incident_id", "tenant_id", "cluster", "title", "status", "severity", "risk_score", "confidence", "first_event_at", "last_event_at",
        "affected_users", "affected_hosts", "external_ips", "domains", "techniques", "phases", "kinds", "detections", "rules", "score_breakdown",
        "tags", "summary", "first_key")


def incident_detections(incidents: DataFrame, detections: DataFrame) -> DataFrame:
    """Child table: detections with their incident id."""
    return detections.join(incidents.select("tenant_id", "cluster", "incident_id"), ["tenant_id", "cluster"])


def incident_events(incidents: DataFrame, detections: DataFrame, events: DataFrame) -> DataFrame:
    """Child table: the cited events of each incident."""
    cited = incident_evidence(detections).join(incidents.select("tenant_id", "cluster", "incident_id"), ["tenant_id", "cluster"])
    return cited.select("incident_id", "tenant_id", "event_id").distinct().join(events, ["tenant_id", "event_id"])


def phase_matrix(incident_dets: DataFrame, incidents: DataFrame) -> DataFrame:
    """Thirteen rows per incident: present or not, techniques, detections and first time."""
    grid = incidents.select("incident_id", F.explode(F.array(*[F.lit(p) for p in PHASES])).alias("phase"))
    staged = incident_dets.select("incident_id", effective_phase().alias("phase"), "techniques", "detection_id", "timestamp")
    seen = staged.where(F.col("phase").isNotNull()).groupBy("incident_id", "phase").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("techniques")))).alias("techniques"),
        F.array_sort(F.collect_list(F.struct("timestamp", "detection_id"))).getField("detection_id").alias("detection_ids"),
        F.min("timestamp").alias("first_seen"))
    empty = F.array().cast("array<string>")
    return grid.join(seen, ["incident_id", "phase"], "left").join(F.broadcast(phase_table(incidents.sparkSession)), "phase").select(
        "incident_id", "phase_rank", "phase", "label", F.col("first_seen").isNotNull().alias("present"),
        F.coalesce("techniques", empty).alias("techniques"), F.coalesce("detection_ids", empty).alias("detection_ids"), "first_seen")


# --------------------------------------------------------------------------------------- slow burn
def admit_slow_burn(candidates: DataFrame, admitted: DataFrame, min_fresh: int = 2) -> DataFrame:
    """Candidates that still bring ``min_fresh`` detections nobody explained, taken in rank order.

    ``candidates`` is (tenant_id, entity, rank, detection_ids). A candidate can be decided as soon as no better
    ranked open candidate shares a fresh detection with it, so every round decides many at once and equals the
    one-by-one order exactly.
    """
    pairs = candidates.select("tenant_id", "entity", "rank", F.explode("detection_ids").alias("detection_id"))
    links = materialize(pairs.join(admitted.select("detection_id").distinct(), "detection_id", "left_anti"))
    open_, chosen = candidates.select("tenant_id", "entity", "rank"), None
    while True:
        best = Window.partitionBy("detection_id")
        marked = links.withColumn("best", F.min("rank").over(best))
        state = open_.join(marked.groupBy("tenant_id", "entity").agg(
            F.count(F.lit(1)).alias("fresh"), F.max(F.when(F.col("best") < F.col("rank"), 1).otherwise(0)).alias("blocked")), ["tenant_id", "entity"], "left")
        state = materialize(state.withColumns({"fresh": F.coalesce("fresh", F.lit(0)), "blocked": F.coalesce("blocked", F.lit(0))}))
        ready = state.where(F.col("blocked") == 0)
        taken = ready.where(F.col("fresh") >= min_fresh).select("tenant_id", "entity", "rank", "fresh")
        chosen = materialize(taken if chosen is None else chosen.unionByName(taken))
        open_ = state.where(F.col("blocked") == 1).select("tenant_id", "entity", "rank")
        if open_.limit(1).count() == 0:
            return chosen
        explained = links.join(taken.select("tenant_id", "entity"), ["tenant_id", "entity"], "left_semi").select("detection_id").distinct()
        links = materialize(links.join(open_.select("tenant_id", "entity"), ["tenant_id", "entity"], "left_semi").join(explained, "detection_id", "left_anti"))


def slow_burn_incidents(candidates: DataFrame, detections: DataFrame, admitted: DataFrame, events: DataFrame | None = None, min_fresh: int = 2) -> DataFrame:
    """Incidents of entities whose decayed risk crossed the ledger threshold.

    ``candidates`` comes from the ledger (optionally merged with its sticky groups); sticky ones go first.
    """
    sticky = F.col("sticky") if "sticky" in candidates.columns else F.lit(False)
    ranked = with_row_index(candidates.withColumn("order_key", F.struct((~sticky).cast("int").alias("a"), (-F.col("balance")).alias("b"), F.col("entity").alias("c"), F.col("tenant_id").alias("d"))), [], ["order_key"]) \
        .withColumnRenamed("row_index", "rank").drop("order_key")
    chosen = admit_slow_burn(ranked, admitted, min_fresh).select("tenant_id", "entity", "rank")
    groups = ranked.join(chosen, ["tenant_id", "entity", "rank"])
    members = groups.select("tenant_id", F.col("entity").alias("cluster"), F.explode("detection_ids").alias("detection_id"))
    base = build_incidents(members.join(detections.drop("cluster"), ["tenant_id", "detection_id"]), events, admit=False)
    info = groups.select("tenant_id", F.col("entity").alias("cluster"), "balance", "span_hours", "rank")
    lifted = base.join(info, ["tenant_id", "cluster"])
    risk = F.round(F.least(F.lit(100.0), F.greatest(F.col("risk_score"), F.least(F.lit(95.0), F.col("balance")))), 1)
    name = F.substring_index("cluster", ":", -1)
    return lifted.withColumns({
        "risk_score": risk,
        "severity": F.when(risk >= 85, "critical").when(risk >= 65, "high").when(risk >= 40, "medium").otherwise(F.col("severity")),
        "title": F.format_string("Slow build-up on %s (%.0f h, %d signals)", name, "span_hours", "detections"),
        "tags": F.array_sort(F.array_union("tags", F.array(F.lit("slow_burn"), F.lit("ledger")))),
        "ledger_balance": F.col("balance"), "ledger_span_hours": F.col("span_hours"),
    }).drop("balance", "span_hours")


def sort_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(F.desc("risk_score"), "first_event_at", "incident_id")


# ---------------------------------------------------------------------------------- analyst updates
def carry_over_status(new: DataFrame, new_detections: DataFrame, old: DataFrame, old_detections: DataFrame) -> DataFrame:
    """Give a new incident the id, status and summary of the old incident it shares a detection with.

    Each old id is inherited once, by the best-ranked new incident; a new id that is still taken gets a suffix.
    """
    shared = new_detections.select(F.col("incident_id").alias("new_id"), "detection_id", "timestamp").join(
        old_detections.groupBy("detection_id").agg(F.min("incident_id").alias("old_id")), "detection_id")
    first = shared.groupBy("new_id", "old_id").agg(F.min(F.struct("timestamp", "detection_id")).alias("met"))
    ranked = first.join(new.select(F.col("incident_id").alias("new_id"), F.struct((-F.col("risk_score")).alias("r"), F.col("first_event_at").alias("t"), F.col("incident_id").alias("i")).alias("place")), "new_id")
    pairs, open_ = None, materialize(ranked)
    while True:
        # the best placed open incident takes its first still unclaimed old id, all independent picks at once
        wish = open_.withColumn("nth", F.row_number().over(Window.partitionBy("new_id").orderBy("met", "old_id"))).where(F.col("nth") == 1)
        rivals = open_.groupBy("old_id").agg(F.min("place").alias("best_place"))
        won = wish.join(rivals, "old_id").where(F.col("place") == F.col("best_place")).select("new_id", "old_id")
        pairs = materialize(won if pairs is None else pairs.unionByName(won))
        open_ = materialize(open_.join(pairs.select("new_id"), "new_id", "left_anti").join(pairs.select("old_id"), "old_id", "left_anti"))
        if open_.limit(1).count() == 0:
            break
    keep = old.select(F.col("incident_id").alias("old_id"), F.col("status").alias("old_status"), F.col("summary").alias("old_summary"))
    joined = new.join(pairs, new["incident_id"] == pairs["new_id"], "left").join(keep, "old_id", "left")
    renamed = joined.withColumn("base_id", F.coalesce("old_id", "incident_id")) \
        .withColumn("status", F.coalesce("old_status", "status")).withColumn("summary", F.coalesce("old_summary", "summary"))
    clash = Window.partitionBy("base_id").orderBy(F.desc("risk_score"), "first_event_at", "incident_id")
    n = F.row_number().over(clash) - 1
    return renamed.withColumn("incident_id", F.when(n == 0, F.col("base_id")).otherwise(F.concat("base_id", F.lit("-"), n.cast("string")))) \
        .drop("old_id", "new_id", "old_status", "old_summary", "base_id")


def set_status(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply analyst updates ``(incident_id, status, updated_at)``; the latest valid one wins."""
    latest = updates.where(F.col("status").isin(STATUSES)).groupBy("incident_id").agg(F.max_by("status", "updated_at").alias("new_status"))
    return incidents.join(latest, "incident_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def is_open() -> Column:
    return F.col("status").isin(OPEN_STATUSES)
