"""ATT&CK mapping and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightjar.schema import PHASES, phase_label
from nightjar.sources.techniques import TECHNIQUES


def tactic_of(technique: Column) -> Column:
    """Tactic of a technique id; a sub-technique falls back to its parent. One look-up in a fixed map."""
    known = F.create_map(*[F.lit(v) for tid, _, tactic in TECHNIQUES for v in (tid, tactic)])
    return F.coalesce(F.try_element_at(known, technique), F.try_element_at(known, F.split(technique, r"\.")[0]))


def technique_url(technique: Column) -> Column:
    parts = F.split(technique, r"\.")
    return F.concat(F.lit("https://attack.mitre.org/techniques/"), F.array_join(parts, "/"), F.lit("/"))


def map_techniques(rows: DataFrame, techniques: DataFrame, column: str = "technique") -> DataFrame:
    """Add name, tactic and link to technique ids (catalogue of fixed size, so both joins broadcast)."""
    exact = F.broadcast(techniques.select(F.col("technique_id").alias(column), "name", "tactic", F.col("technique_id").alias("known_id")))
    parent = F.broadcast(techniques.select(F.col("technique_id").alias("parent_id"), F.col("name").alias("p_name"), F.col("tactic").alias("p_tactic")))
    out = rows.join(exact, column, "left").withColumn("parent_id", F.split(column, r"\.")[0]).join(parent, "parent_id", "left")
    found = F.coalesce("known_id", F.when(F.col("p_name").isNotNull(), F.col("parent_id")))
    return out.select(*rows.columns, F.coalesce("name", "p_name").alias("technique_name"), F.coalesce("tactic", "p_tactic").alias("tactic"),
                      technique_url(found).alias("url"), found.alias("catalog_id"))


def phase_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, phase_label(p)) for i, p in enumerate(PHASES)], "phase_rank int, phase string, label string")


def tactic_coverage(observed: DataFrame, column: str = "technique") -> DataFrame:
    """Observations per tactic, all thirteen phases listed."""
    counted = observed.select(tactic_of(F.col(column)).alias("phase")).where(F.col("phase").isNotNull()).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))
    return phase_table(observed.sparkSession).join(counted, "phase", "left").select("phase_rank", F.col("phase").alias("tactic"), "label", F.coalesce("n", F.lit(0)).alias("n"))


def rule_techniques(spark: SparkSession, rules, built_in: dict[str, list[str]]) -> DataFrame:
    """Techniques of the rules and of the built-in detectors."""

    rows = [(r.id, t) for r in rules for t in r.techniques] + [(r, t) for r, ts in built_in.items() for t in ts]
    return spark.createDataFrame(rows, "rule_id string, technique string")


def rule_coverage(rule_techs: DataFrame, techniques: DataFrame) -> DataFrame:
    """Covered and total catalogue techniques per tactic, plus the rule techniques the catalogue lacks."""
    mapped = map_techniques(rule_techs, techniques)
    covered = mapped.where(F.col("catalog_id").isNotNull()).select(F.col("catalog_id").alias("technique_id")).distinct().withColumn("covered", F.lit(1))
    per = techniques.join(covered, "technique_id", "left").groupBy("tactic").agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce("covered", F.lit(0))).alias("covered"))
    return phase_table(techniques.sparkSession).join(per, F.col("phase") == F.col("tactic"), "left").select(
        "phase_rank", F.col("phase").alias("tactic"), "label", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("covered", F.lit(0)).alias("covered"))


def unmapped_techniques(rule_techs: DataFrame, techniques: DataFrame) -> DataFrame:
    """Rule techniques without an own entry in the catalogue."""
    return rule_techs.select("technique").distinct().join(techniques.select(F.col("technique_id").alias("technique")), "technique", "left_anti")


def observed_techniques(incidents: DataFrame) -> DataFrame:
    return incidents.select(F.explode("techniques").alias("technique")).groupBy("technique").agg(F.count(F.lit(1)).alias("incidents"))


def rule_catalog(rules_df: DataFrame, detections: DataFrame) -> DataFrame:
    """Rules with the number of detections they raised."""
    fired = detections.groupBy("rule_id").agg(F.count(F.lit(1)).alias("fired"))
    return rules_df.join(fired, "rule_id", "left").withColumn("fired", F.coalesce("fired", F.lit(0)))
