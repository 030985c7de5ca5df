"""Batch entry point: raw records -> events, detections and, when asked, incidents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from nightjar.operators import baselines as B
from nightjar.operators import correlate as C
from nightjar.operators import graph as G
from nightjar.operators import incidents as I
from nightjar.operators import intel as T
from nightjar.operators import ledger as L
from nightjar.operators import rules as R
from nightjar.operators.events import deduplicate
from nightjar.operators.normalize import normalize, with_violations
from nightjar.plans.rulepack import RULES
from nightjar.session import materialize


@dataclass
class Ingested:
    """Tables of one run."""

    events: DataFrame
    quarantine: DataFrame
    detections: DataFrame
    incidents: DataFrame | None
    counts: DataFrame


def detect(events: DataFrame, rules: list[R.RuleSpec] | None = None, iocs: DataFrame | None = None, with_baselines: bool = True) -> DataFrame:
    """Detections of rules, baselines and threat intelligence together."""
    parts = [R.run_rules(events, RULES if rules is None else rules)]
    if with_baselines:
        parts += B.run_baselines(events)
    if iocs is not None:
        parts.append(T.ti_match(events, iocs))
    return R.union_detections(*parts)


def ingest_batch(records: DataFrame, collector: str | None = None, tenant: str = "default", rules: list[R.RuleSpec] | None = None,
                 iocs: DataFrame | None = None, correlate: bool = True, before: tuple[DataFrame, DataFrame] | None = None) -> Ingested:
    """Normalise, validate, deduplicate, detect and correlate; ``records`` carries ``raw`` and ``seq``.

    Incidents come from links in time, entity and topology; entities whose decayed risk builds up slowly add theirs, from
    detections that no incident explains yet. ``before`` (incidents, their detections) of an earlier run passes ids, status
    and summary on. ``normalize`` runs once: its checked rows are kept for events, quarantine and counts.
    """
    checked = materialize(with_violations(normalize(records, collector, tenant)))
    accepted, quarantine = checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
    events = materialize(deduplicate(accepted))
    detections = materialize(detect(events, rules, iocs))
    incidents = None
    if correlate:
        reached = materialize(G.contacted_ips(G.derive_edges(events)).distinct())  # read several times
        grouped = materialize(C.correlate(detections, reached))
        window = materialize(I.build_incidents(grouped, events))
        linked = I.incident_detections(window, grouped)
        slow = I.slow_burn_incidents(L.slow_burn_candidates(L.ledger_deposits(detections)), detections, linked.select("detection_id"), events)
        slow = slow.withColumn("incident_id", F.concat(F.lit("LED-"), F.substring_index("incident_id", "-", -1)))
        incidents = window.unionByName(slow, allowMissingColumns=True)
        if before is not None:
            incidents = I.carry_over_status(incidents, linked, *before)
    one = F.lit(1).alias("one")
    counts = accepted.agg(F.count(F.lit(1)).alias("accepted"), one).join(events.agg(F.count(F.lit(1)).alias("kept"), one), "one") \
        .join(detections.agg(F.count(F.lit(1)).alias("detections"), one), "one")
    if incidents is not None:
        counts = counts.join(incidents.where(I.is_open()).agg(F.count(F.lit(1)).alias("open_incidents"), one), "one")
    return Ingested(events, quarantine, detections, incidents, counts.withColumn("deduplicated", F.col("accepted") - F.col("kept")).drop("one"))
