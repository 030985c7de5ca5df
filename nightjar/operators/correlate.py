"""Detections -> clusters: shared entities in time, then host topology."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from nightjar.operators.ordered import BLOCK, Fold, block_window, fold_ordered, order_blocks, with_carry
from nightjar.schema import filled, micros, seconds
from nightjar.session import materialize

WINDOW_SECONDS = 3600  # fixed value: how close two signals of one entity must be
TOPOLOGY_DAYS = 14  # fixed value: how far apart clusters of neighbouring hosts may be


def entity_keys(entities: Column) -> Column:
    """Correlation keys of a detection: user, host, address and session."""
    def key(name: str, prefix: str, change) -> Column:
        value = entities[name]
        return F.when(filled(value), F.concat(F.lit(prefix), change(value)))

    same = lambda c: c
    return F.array_distinct(F.array_compact(F.array(
        key("user", "user:", F.lower), key("host", "host:", F.upper), key("ip", "ip:", same), key("dst_ip", "ip:", same),
        key("session", "session:", same))))


def detection_entity_keys(detections: DataFrame) -> DataFrame:
    return detections.select("detection_id", "tenant_id", "timestamp", F.explode(entity_keys(F.col("entities"))).alias("entity"))


def strong_keys(detections: DataFrame) -> DataFrame:
    """Keys that link on their own. A detection carries one address key at most, and an address links only
    when another key is shared too; that other key links already, so address keys add nothing."""
    return detection_entity_keys(detections).where(~F.col("entity").startswith("ip:"))


def temporal_islands(detections: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Runs of detections per entity without a gap above the window; ``island_start`` names the run.

    Linking each row to its predecessor connects everything any pair within the window would, with n links.
    """
    keys = ["tenant_id", "entity"]
    rows = strong_keys(detections).withColumn("ts_us", micros(F.col("timestamp")))
    laid = order_blocks(rows, keys, ["ts_us", "detection_id"])
    w = block_window(keys, ["ts_us", "detection_id"])
    linked = with_carry(laid, keys, {"earlier_ts": (F.max("ts_us"), F.max)})
    linked = (
        linked.withColumn("previous_ts", F.coalesce(F.lag("ts_us").over(w), F.col("earlier_ts")))
        .withColumn("opens", F.when(F.col("previous_ts").isNull() | (F.col("ts_us") - F.col("previous_ts") > seconds(window_seconds)), F.col("ts_us")))
        .drop("earlier_ts")
    )
    named = with_carry(linked, keys, {"earlier_start": (F.max("opens"), F.max)})
    here = F.max("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return named.withColumn("island_start", F.coalesce(here, F.col("earlier_start"))).drop("earlier_start", "opens")


def temporal_links(detections: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Consecutive detections of an entity within the window: ``(entity, detection_id, ts_us, previous_ts)``."""
    return temporal_islands(detections, window_seconds).where(F.col("island_start") < F.col("ts_us")) \
        .select("tenant_id", "entity", "detection_id", "ts_us", "previous_ts")


def island_edges(islands: DataFrame) -> DataFrame:
    """Detection -> run -> whole island. Runs are cut at block borders, so no node gathers an unbounded star."""
    island = F.concat_ws("|", F.lit("island"), "tenant_id", "entity", F.col("island_start").cast("string"))
    run = F.concat_ws("|", island, F.col(BLOCK).cast("string"))
    members = islands.select(F.concat(F.lit("d|"), F.col("detection_id")).alias("src"), run.alias("dst"), island.alias("island"))
    runs = members.select(F.col("dst").alias("src"), F.col("island").alias("dst")).distinct()
    return members.select("src", "dst").unionByName(runs)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` with the smallest node name of each component.

    Every round takes the smallest label of the neighbours (partial aggregation first) and then the label of
    the label, so long chains shrink geometrically. Each round is checkpointed; the loop stops on no change.
    """
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    names = both.select(F.col("src").alias("node"))
    if nodes is not None:
        names = names.unionByName(nodes.select("node"))
    labels = materialize(names.distinct().withColumn("component", F.col("node")))
    while True:
        offered = both.join(labels, both["src"] == labels["node"]).groupBy("dst").agg(F.min("component").alias("offer"))
        lower = labels.join(offered, labels["node"] == offered["dst"], "left").select(
            "node", F.col("component").alias("before"), F.least("component", F.coalesce("offer", "component")).alias("component"))
        heads = lower.select(F.col("node").alias("head"), F.col("component").alias("head_component"))
        jumped = lower.join(heads, lower["component"] == heads["head"], "left").select(
            "node", "before", F.least("component", F.coalesce("head_component", "component")).alias("component"))
        jumped = materialize(jumped)
        changed = jumped.where(F.col("before") != F.col("component")).limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels


def cluster_detections(detections: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """``(detection_id, cluster)`` from shared entities in time; a detection without links stands alone."""
    edges = island_edges(temporal_islands(detections, window_seconds))
    nodes = detections.select(F.concat(F.lit("d|"), F.col("detection_id")).alias("node"))
    found = connected_components(edges, nodes)
    return found.where(F.col("node").startswith("d|")).select(
        F.substr("node", F.lit(3)).alias("detection_id"), F.substr("component", F.lit(3)).alias("cluster"))


# ----------------------------------------------------------------------------------------- topology
PRUNE_AT = 64  # waiting intervals from which ended ones are looked for


class NeighbourSweep(Fold):
    """Sweep over cluster intervals of the hosts that share an address, in start order.

    Intervals of different hosts that are active together belong to one group, so it is enough to remember the
    longest active interval of each of two hosts; intervals of a lone host wait until another host appears. Those that have
    ended are dropped when they would be linked, or when the list has doubled, so a row costs no walk over all that wait.
    """

    columns = ["lo", "hi", "host", "cluster"]
    schema = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def start(self, key: str) -> dict:
        return {"longest": {}, "waiting": [], "prune_at": PRUNE_AT}

    def step(self, key: str, state: dict, row: tuple) -> Iterable[dict]:
        lo, hi, host, cluster = row
        longest = {h: v for h, v in state["longest"].items() if v[0] + self.gap_us >= lo}
        waiting, links = state["waiting"], []
        others = [h for h in longest if h != host]
        if others or len(waiting) >= state["prune_at"]:
            waiting = [w for w in waiting if w[0] + self.gap_us >= lo]
            state["prune_at"] = max(PRUNE_AT, 2 * len(waiting))
        if others:
            best = longest[max(others, key=lambda h: longest[h])][1]
            links = [{"src": c, "dst": cluster} for c in dict.fromkeys([best, *[w[1] for w in waiting]])]
            waiting = []
        else:
            waiting.append((hi, cluster))
        longest[host] = max(longest.get(host, (hi, cluster)), (hi, cluster))
        keep = sorted(longest, key=lambda h: longest[h], reverse=True)[:2]
        state["longest"], state["waiting"] = {h: longest[h] for h in keep}, waiting
        return links


def topology_links(clusters: DataFrame, detections: DataFrame, host_ips: DataFrame, days: float = TOPOLOGY_DAYS) -> DataFrame:
    """Links between clusters of different hosts that reached a common address, at most ``days`` apart.

    ``host_ips`` is (tenant_id, host, ip). Addresses reached by the same set of hosts tell the same story, so
    one of them is enough (sets are compared by an order-free digest, never collected).
    """
    span = clusters.join(detections, "detection_id").groupBy("tenant_id", "cluster").agg(
        F.min(micros(F.col("timestamp"))).alias("lo"), F.max(micros(F.col("timestamp"))).alias("hi"))
    at_host = clusters.join(detections, "detection_id").where(filled(F.col("entities")["host"])) \
        .select("tenant_id", F.upper(F.col("entities")["host"]).alias("host"), "cluster").distinct()
    reached = host_ips.select("tenant_id", "host", "ip").distinct()
    sets = reached.groupBy("tenant_id", "ip").agg(
        F.count(F.lit(1)).alias("hosts"), F.bit_xor(F.xxhash64("host")).alias("x"), F.sum(F.xxhash64("host").cast("decimal(38,0)")).alias("s"))
    chosen = sets.where(F.col("hosts") > 1).groupBy("tenant_id", "hosts", "x", "s").agg(F.min("ip").alias("ip"))
    rows = (
        reached.join(chosen.select("tenant_id", "ip"), ["tenant_id", "ip"], "left_semi")
        .join(at_host, ["tenant_id", "host"]).join(span, ["tenant_id", "cluster"])
        .select(F.concat_ws("|", "tenant_id", "ip").alias("fold_key"), "lo", "hi", "host", "cluster")
    )
    return fold_ordered(rows, NeighbourSweep(seconds(days * 86_400)), ["lo", "hi", "host", "cluster"]).where(F.col("src") != F.col("dst")).distinct()


def merge_by_topology(clusters: DataFrame, detections: DataFrame, host_ips: DataFrame, days: float = TOPOLOGY_DAYS) -> DataFrame:
    """Merge clusters along :func:`topology_links`; same shape as the input."""
    links = topology_links(clusters, detections, host_ips, days)
    merged = connected_components(links)
    return clusters.join(merged, clusters["cluster"] == merged["node"], "left").select(
        "detection_id", F.coalesce("component", "cluster").alias("cluster"))


def correlate(detections: DataFrame, host_ips: DataFrame | None = None, window_seconds: float = WINDOW_SECONDS, days: float = TOPOLOGY_DAYS) -> DataFrame:
    """Detections with their final ``cluster``."""
    clusters = cluster_detections(detections, window_seconds)
    if host_ips is not None:
        clusters = merge_by_topology(clusters, detections, host_ips, days)
    return detections.join(clusters, "detection_id")
