"""Attack graph of each incident, for all incidents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from nightjar.session import materialize

# --- fixed values -------------------------------------------------------------------------------
LAYER = {"user": 0, "host": 1, "process": 2, "file": 3, "service": 3, "domain": 4, "ip": 4, "ioc": 5}
OTHER_LAYER = 2
RELATION_PHASE = {
    "logged_into": "initial_access", "failed_login": "credential_access", "authenticated_as": "initial_access",
    "spawned": "execution", "executed": "execution", "ran": "execution", "wrote": "collection", "modified": "impact",
    "read": "collection", "connected_to": "command_and_control", "resolved": "command_and_control",
    "resolves_to": "command_and_control", "escalated_on": "privilege_escalation", "granted_privilege": "privilege_escalation",
    "created_account": "persistence", "installed": "persistence", "created": "persistence", "known_as": "command_and_control",
}
IOC_RISK = 90.0
GRAPH = ["tenant_id", "incident_id"]
# ------------------------------------------------------------------------------------------------


def _lookup(mapping: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair]), key)


def evidence_edges(edges: DataFrame, incident_dets: DataFrame) -> DataFrame:
    """Edges of the cited events with the detections that cite them, per incident.

    Cited events are reduced to one row per (incident, event) before they meet the edges.
    """
    cites = incident_dets.select("tenant_id", "incident_id", "timestamp", "detection_id", "score", "techniques", F.col("phase").alias("det_phase"), F.explode("evidence_event_ids").alias("event_id"))
    per_event = cites.groupBy("tenant_id", "incident_id", "event_id").agg(
        F.max("score").alias("score"), F.flatten(F.collect_set("techniques")).alias("det_techniques"),
        F.min_by("det_phase", F.when(F.col("det_phase").isNotNull(), F.struct("timestamp", "detection_id"))).alias("det_phase"))
    return edges.select("tenant_id", "event_id", "timestamp", "seq", "src", "dst", "relation").join(per_event, ["tenant_id", "event_id"])


def attack_graph_edges(evidence: DataFrame, ioc_edges: DataFrame | None = None, shown_ids: int | None = None) -> DataFrame:
    """Parallel edges collapsed per (incident, source, target, relation)."""
    grouped = evidence.groupBy("tenant_id", "incident_id", "src", "dst", "relation").agg(
        F.min("timestamp").alias("first_time"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("det_techniques")))).alias("techniques"),
        F.min_by("det_phase", F.when(F.col("det_phase").isNotNull(), F.struct("timestamp", "seq"))).alias("det_phase"),
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tenant_id", "incident_id", "src", "dst", "relation").orderBy("timestamp", "seq")
    shown = evidence.withColumn("nth", F.row_number().over(w)).where(F.lit(True) if shown_ids is None else F.col("nth") <= shown_ids) \
        .groupBy("tenant_id", "incident_id", "src", "dst", "relation").agg(F.array_sort(F.collect_list(F.struct("nth", "event_id"))).getField("event_id").alias("evidence_event_ids"))
    out = grouped.join(shown, ["tenant_id", "incident_id", "src", "dst", "relation"]).select(
        "tenant_id", "incident_id", "src", "dst", "relation", "first_time", F.coalesce(_lookup(RELATION_PHASE, F.col("relation")), "det_phase").alias("phase"), "techniques", "evidence_event_ids", "n")
    if ioc_edges is None:
        return out
    touched = out.select("tenant_id", "incident_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    listed = touched.join(ioc_edges.select("tenant_id", F.col("src").alias("node"), "dst"), ["tenant_id", "node"]).distinct()
    none = F.array().cast("array<string>")
    return out.unionByName(listed.select(
        "tenant_id", "incident_id", F.col("node").alias("src"), "dst", F.lit("known_as").alias("relation"), F.lit(None).cast("timestamp").alias("first_time"),
        F.lit(RELATION_PHASE["known_as"]).alias("phase"), none.alias("techniques"), none.alias("evidence_event_ids"), F.lit(1).cast("long").alias("n")))


def attack_graph_nodes(graph_edges: DataFrame, evidence: DataFrame, shown_ids: int | None = None) -> DataFrame:
    """Nodes with layer, risk, evidence and first time; indicator nodes carry at least the listed risk."""
    def ends(df: DataFrame, *more: str) -> DataFrame:
        return df.select("tenant_id", "incident_id", *more, F.inline(F.array(
            F.struct(F.col("src").alias("node"), (F.col("relation") == "authenticated_as").alias("is_source")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("is_source")))))

    shape = ends(graph_edges, "first_time").groupBy("tenant_id", "incident_id", "node").agg(F.min("first_time").alias("first_time"), F.max("is_source").alias("is_source"))
    cited = ends(evidence, "event_id", "score").groupBy("tenant_id", "incident_id", "node").agg(F.max("score").alias("score"))
    ids = ends(evidence, "event_id").select("tenant_id", "incident_id", "node", "event_id").distinct()
    w = Window.partitionBy("tenant_id", "incident_id", "node").orderBy("event_id")
    shown = ids.withColumn("nth", F.row_number().over(w)).where(F.lit(True) if shown_ids is None else F.col("nth") <= shown_ids).groupBy("tenant_id", "incident_id", "node").agg(F.array_sort(F.collect_list("event_id")).alias("evidence_event_ids"))
    kind = F.substring_index("node", ":", 1)
    layer = F.when((kind == "ip") & F.col("is_source"), 0).otherwise(F.coalesce(_lookup(LAYER, kind), F.lit(OTHER_LAYER)))
    risk = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(kind == "ioc", IOC_RISK).otherwise(0.0))
    return shape.join(cited, ["tenant_id", "incident_id", "node"], "left").join(shown, ["tenant_id", "incident_id", "node"], "left").select(
        "tenant_id", "incident_id", "node", kind.alias("kind"), layer.alias("layer"), F.round(risk, 1).alias("risk"), "first_time",
        F.coalesce("evidence_event_ids", F.array().cast("array<string>")).alias("evidence_event_ids"))


def order_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("incident_id", "layer", F.col("first_time").asc_nulls_last(), "node")


def _cycle_core(edges: DataFrame) -> DataFrame:
    """Edges left after repeatedly trimming those no cycle can use: no way into the source or out of the target."""
    core = edges
    while True:
        before = core.count()
        into = core.select("tenant_id", "incident_id", F.col("dst").alias("src")).distinct()
        out = core.select("tenant_id", "incident_id", F.col("src").alias("dst")).distinct()
        core = materialize(core.join(into, [*GRAPH, "src"], "left_semi").join(out, [*GRAPH, "dst"], "left_semi"))
        if core.count() == before:
            return core


def story_spine(graph_edges: DataFrame) -> DataFrame:
    """Longest path through each incident's graph, for all incidents together.

    Cycles are broken first: of the edges a cycle can use, those that do not lead forward in (layer, name) order
    are dropped. Paths then grow backwards from the sinks, one join and one aggregation per step, so neither a
    large graph nor a large number of them lands on one task. Ties take the greatest path by name.
    """
    pairs = materialize(graph_edges.where(F.col("src") != F.col("dst")).select(*GRAPH, "src", "dst").distinct())

    def place(node: str) -> Column:
        return F.struct(F.coalesce(_lookup(LAYER, F.substring_index(node, ":", 1)), F.lit(OTHER_LAYER)), F.col(node))

    closing = _cycle_core(pairs).where(place("src") >= place("dst"))
    kept = materialize(pairs.join(closing, [*GRAPH, "src", "dst"], "left_anti"))
    nodes = pairs.select(*GRAPH, F.explode(F.array("src", "dst")).alias("node")).distinct()
    best = materialize(nodes.withColumn("tail", F.struct(F.lit(1).alias("size"), F.array("node").alias("path"))))
    while True:
        longer = kept.join(best.select(*GRAPH, F.col("node").alias("dst"), "tail"), [*GRAPH, "dst"]).groupBy(*GRAPH, F.col("src").alias("node")).agg(
            F.max(F.struct((F.col("tail.size") + 1).alias("size"), F.concat(F.array("src"), "tail.path").alias("path"))).alias("grown"))
        grown = materialize(best.join(longer, [*GRAPH, "node"], "left").select(*GRAPH, "node", F.col("tail").alias("was"), F.greatest("tail", F.coalesce("grown", "tail")).alias("tail")))
        changed = grown.where(F.col("was") != F.col("tail")).limit(1).count()
        best = grown.drop("was")
        if not changed:
            return best.groupBy(*GRAPH).agg(F.max("tail").alias("tail")).select(*GRAPH, F.col("tail.path").alias("path"))
