"""The registered correlation merges clusters of hosts that reached a common address."""

from nightjar.operators import correlate as C
from nightjar.operators import graph as G
from nightjar.plans import queries_cases as Q
from nightjar.plans.adapter import sample_detections, telemetry

SF = "/root/testdata/sf0.001"


def test_correlate_merges_by_topology(spark):
    dets = sample_detections(spark, SF)
    alone = {r["cluster"] for r in C.correlate(dets, None, Q.HOURS_6).select("cluster").collect()}
    merged = {r["cluster"] for r in C.correlate(dets, G.contacted_ips(G.derive_edges(telemetry(spark, SF))), Q.HOURS_6).select("cluster").collect()}
    got = {r["cluster"] for r in Q.correlated(spark, SF).select("cluster").collect()}
    assert alone - merged and not got & (alone - merged)
    print(len(alone), len(merged), len(got))
