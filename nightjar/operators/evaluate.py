"""Detection quality against labelled scenarios, and audit summaries of real telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nightjar.operators.incidents import RISK_FLOOR
from nightjar.operators.intel import match_observables

PER_DAY = 50_000_000  # fixed value: events per day in the projection


def match_scenarios(scenarios: DataFrame, incident_events: DataFrame) -> DataFrame:
    """Incident that shares most events with each scenario run."""
    wanted = scenarios.select("run_id", F.explode(F.array_distinct("event_ids")).alias("event_id"))
    overlap = wanted.join(incident_events.select("incident_id", "event_id").distinct(), "event_id").groupBy("run_id", "incident_id").agg(F.count(F.lit(1)).alias("overlap"))
    best = overlap.groupBy("run_id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "incident_id")).alias("b"))
    return scenarios.join(best, "run_id", "left").select(scenarios["*"], F.col("b.incident_id").alias("incident_id"), F.coalesce(-F.col("b.o"), F.lit(0)).alias("overlap"))


def expected_ioc_hits(scenarios: DataFrame, observables: DataFrame, iocs: DataFrame) -> DataFrame:
    """Observables per run of events whose destination, domain or hash is listed."""
    per_event = observables.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    listed = match_observables(observables.where(~((F.col("kind") == "ip") & (F.col("observed") != F.coalesce("dst_ip", F.lit(""))))), iocs, ["event_id", "pos"]).select("event_id").distinct()
    wanted = scenarios.select("run_id", F.explode(F.array_distinct("event_ids")).alias("event_id"))
    return wanted.join(per_event.join(listed, "event_id", "left_semi"), "event_id").groupBy("run_id").agg(F.sum("n").alias("ioc_expected"))


def _share(a: Column, b: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(whole)), F.lit(0.0))


def scenario_scores(matched: DataFrame, incidents: DataFrame, ioc_expected: DataFrame | None = None, ioc_matched: DataFrame | None = None) -> DataFrame:
    """Phase recall, technique precision and recall, indicator and evidence coverage per run."""
    info = incidents.select("incident_id", "phases", "techniques", "risk_score", "severity")
    none = F.array().cast("array<string>")
    rows = matched.join(info, "incident_id", "left").withColumns({"phases": F.coalesce("phases", none), "techniques": F.coalesce("techniques", none)})
    rows = rows.join(ioc_expected, "run_id", "left") if ioc_expected is not None else rows.withColumn("ioc_expected", F.lit(0))
    rows = rows.join(ioc_matched, "incident_id", "left") if ioc_matched is not None else rows.withColumn("ioc_matched", F.lit(0))
    rows = rows.fillna(0, ["ioc_expected", "ioc_matched"])
    return rows.select(
        "scenario_id", "run_id", "label", "incident_id", (F.col("overlap") > 0).alias("detected"), F.coalesce("risk_score", F.lit(0.0)).alias("risk"), F.coalesce("severity", F.lit("none")).alias("severity"),
        _share(F.array_distinct("expected_phases"), F.col("phases"), F.col("expected_phases")).alias("phase_recall"),
        _share(F.array_distinct("expected_techniques"), F.col("techniques"), F.col("expected_techniques")).alias("technique_recall"),
        _share(F.array_distinct("expected_techniques"), F.col("techniques"), F.col("techniques")).alias("technique_precision"),
        "ioc_expected", F.when(F.col("ioc_expected") > 0, F.least("ioc_matched", "ioc_expected")).otherwise(F.col("ioc_matched")).alias("ioc_matched"),
        F.size(F.array_distinct("event_ids")).alias("evidence_expected"), F.col("overlap").alias("evidence_covered"),
        F.coalesce(F.try_divide(F.col("overlap"), F.size(F.array_distinct("event_ids"))), F.lit(0.0)).alias("evidence_coverage"))


def raises_alarm() -> Column:
    """An incident an analyst would see as an alarm."""
    return F.col("severity").isin("high", "critical") | (F.col("risk") >= RISK_FLOOR)


def _pct(value: Column) -> Column:
    return F.round(value * 100, 1)


def confusion(scores: DataFrame) -> DataFrame:
    """Counts and rates: attacks count when detected, benign runs when they raise an alarm."""
    attack, benign = F.col("label") == "attack", F.col("label") == "benign"
    alarm = F.col("detected") & raises_alarm()
    counts = scores.agg(F.count_if(attack & F.col("detected")).alias("tp"), F.count_if(benign & alarm).alias("fp"), F.count_if(benign & ~alarm).alias("tn"), F.count_if(attack & ~F.col("detected")).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = rate(tp, tp + fp), rate(tp, tp + fn)
    return counts.select("tp", "fp", "tn", "fn", _pct(r).alias("detection_rate"), _pct(rate(fp, fp + tn)).alias("false_positive_rate"), _pct(p).alias("precision"), _pct(rate(2 * p * r, p + r)).alias("f1"))


def _means(detected: Column) -> list[Column]:
    return [_pct(F.coalesce(F.avg(F.when(detected, F.col(c))), F.lit(0.0))).alias(c) for c in ("phase_recall", "technique_precision", "technique_recall", "evidence_coverage")]


def quality_report(scores: DataFrame, total_events: int, latencies: DataFrame | None = None) -> DataFrame:
    """Means over detected attacks, indicator accuracy, false incidents per million events, optional latency."""
    attack = F.col("label") == "attack"
    false_alarm = (F.col("label") == "benign") & F.col("detected") & raises_alarm()
    out = scores.agg(
        *_means(attack & F.col("detected")), F.sum(F.when(attack, F.col("ioc_matched"))).alias("ioc_num"), F.sum(F.when(attack, F.col("ioc_expected"))).alias("ioc_den"),
        F.count_if(false_alarm).alias("false_incidents"), F.coalesce(F.sum(F.when(attack & F.col("detected"), F.col("evidence_expected"))), F.lit(0)).alias("attack_events"))
    benign = F.greatest(F.lit(total_events) - F.col("attack_events"), F.lit(1))
    per_million = F.round(F.col("false_incidents") / benign * 1_000_000, 2)
    out = out.select(
        "phase_recall", "technique_precision", "technique_recall", "evidence_coverage", _pct(F.coalesce(F.try_divide("ioc_num", "ioc_den"), F.lit(1.0))).alias("ioc_accuracy"),
        "false_incidents", per_million.alias("false_per_million"), F.round(per_million * (PER_DAY / 1_000_000), 1).alias("false_per_day"))
    if latencies is None:
        return out
    speed = latencies.agg(F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"), F.round(F.percentile("latency_ms", F.lit(0.95)), 2).alias("p95_latency_ms"),
                          F.round(F.coalesce(F.try_divide(F.lit(float(total_events)), F.sum("latency_ms") / 1000), F.lit(0.0)), 0).alias("events_per_second"))
    return out.withColumn("one", F.lit(1)).join(speed.withColumn("one", F.lit(1)), "one").drop("one")


def quality_by_scenario(scores: DataFrame) -> DataFrame:
    found = F.col("detected")
    return scores.where(F.col("label") == "attack").groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(found).alias("detected_runs"), _pct(F.avg(found.cast("double"))).alias("detection_rate"), *_means(found),
        F.round(F.coalesce(F.avg(F.when(found, F.col("risk"))), F.lit(0.0)), 1).alias("mean_risk"))


def schema_coverage(records: DataFrame) -> DataFrame:
    """Per source event id: seen, mapped and inert or rejected records. Needs ``source_event_id`` and ``event_type``
    (null when rejected)."""
    inert = F.col("event_type").isNull() | (F.col("event_type") == "system_log")
    return records.groupBy("source_event_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(~inert).alias("mapped"), F.count_if(inert).alias("dropped"))


def coverage_pct(per_id: DataFrame) -> DataFrame:
    return per_id.agg(F.sum("seen").alias("records"), F.sum("mapped").alias("mapped"), F.round(F.coalesce(F.try_divide(F.sum("mapped") * 100.0, F.sum("seen")), F.lit(0.0)), 1).alias("coverage_pct"))


def technique_recall(incidents: DataFrame, truth: DataFrame) -> DataFrame:
    """Ground-truth techniques with a found flag."""
    found = incidents.select(F.explode("techniques").alias("technique")).distinct().withColumn("found", F.lit(True))
    return truth.select("technique").distinct().join(found, "technique", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def recall_pct(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count(F.lit(1)).alias("techniques"), F.count_if("found").alias("found"), F.round(F.coalesce(F.try_divide(F.count_if("found") * 100.0, F.count(F.lit(1))), F.lit(0.0)), 1).alias("recall_pct"))


def rules_fired(detections: DataFrame, top: int = 25) -> DataFrame:
    return detections.groupBy("rule_id").agg(F.count(F.lit(1)).alias("fired")).orderBy(F.desc("fired"), "rule_id").limit(top)


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Techniques two runs found: kept, gained or lost. Inputs are (technique)."""
    b, a = before.select("technique").distinct().withColumn("b", F.lit(1)), after.select("technique").distinct().withColumn("a", F.lit(1))
    state = F.when(F.col("a").isNull(), "lost").when(F.col("b").isNull(), "gained").otherwise("kept")
    return b.join(a, "technique", "full_outer").select("technique", state.alias("change"))


def as_metrics(row: DataFrame, *keys: str) -> DataFrame:
    """Numeric columns of a table as ``(keys, metric, value)``."""
    names = [f.name for f in row.schema.fields if f.name not in keys and f.dataType.simpleString().split("(")[0] in ("int", "bigint", "double", "float", "decimal")]
    return row.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))


def compare_metrics(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Measures of two runs side by side, from ``(keys, metric, value)`` of each: values, difference, relative change, direction.

    A measure that only one run has is new or gone; a change from zero has no relative size.
    """
    by = [*keys, "metric"]
    both = before.select(*by, F.col("value").alias("before")).join(after.select(*by, F.col("value").alias("after")), by, "full_outer")
    delta = F.col("after") - F.col("before")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(delta > 0, "up").when(delta < 0, "down").otherwise("same")
    return both.select(*by, "before", "after", F.round(delta, 3).alias("delta"), F.round(F.try_divide(delta * 100, F.abs("before")), 1).alias("delta_pct"), change.alias("change"))
