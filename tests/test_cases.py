import random
import time

from helpers import START, event, frame
from pyspark.sql import functions as F

from nightjar.operators import attack_graph as A
from nightjar.operators import correlate as C
from nightjar.operators import incidents as I
from nightjar.operators.ordered import fold_ordered
from nightjar.operators.rules import RuleSpec, run_rules


def components(pairs, nodes):
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_topology_sweep_links_the_same_groups_as_all_pairs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        lo = rng.randrange(0, 3000)
        rows.append((f"ip{i % 2}", lo, lo + rng.randrange(0, 40), rng.choice("ABCD"), f"c{i:03d}"))
    gap = 15
    pairs = [(x[4], y[4]) for x in rows for y in rows if x[0] == y[0] and x[3] != y[3] and max(x[1], y[1]) - min(x[2], y[2]) <= gap]
    df = spark.createDataFrame(rows, "fold_key string, lo long, hi long, host string, cluster string")
    got = fold_ordered(df, C.NeighbourSweep(gap), ["lo", "hi", "host", "cluster"], blocks=7).collect()
    names = [r[4] for r in rows]
    assert components([(r["src"], r["dst"]) for r in got], names) == components(pairs, names)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.format_string("n%04d", "id").alias("src"), F.format_string("n%04d", F.col("id") + 1).alias("dst")).where("id % 50 != 49")
    got = C.connected_components(edges).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [50, 50, 50, 50]


def test_scores_caps_and_bonuses(spark):
    def score(*dets):
        rows = [(f"d{i}", "t", "c", k, f"r{i}", s, 1.0, p, START, {"host": "H", "user": "u"}) for i, (k, s, p) in enumerate(dets)]
        df = spark.createDataFrame(rows, "detection_id string, tenant_id string, cluster string, kind string, rule_id string, score double, confidence double, phase string, timestamp timestamp, entities map<string,string>")
        df = df.withColumns({"title": F.lit("t"), "severity": F.lit("low"), "techniques": F.array().cast("array<string>"), "details": F.create_map().cast("map<string,string>"), "evidence_event_ids": F.array("detection_id")})
        return df, I.score_clusters(df).first()

    assert score(*[("rule", 80.0, "execution")] * 5)[1]["risk_score"] <= 100
    assert score(("rule", 40.0, "execution"), ("rule", 40.0, "impact"))[1]["risk_score"] > score(("rule", 40.0, "execution"), ("rule", 40.0, "execution"))[1]["risk_score"]
    assert score(("rule", 40.0, "execution"), ("threat_intel", 40.0, "execution"))[1]["ti_bonus"] == 6
    assert I.build_incidents(score(("anomaly", 90.0, "execution"))[0]).count() == 0


def test_greedy_slow_burn_equals_one_by_one(spark):
    rng = random.Random(3)
    cands = [(f"e{i}", i, sorted({f"d{rng.randrange(30)}" for _ in range(rng.randrange(1, 6))})) for i in range(25)]
    used, want = {"d0", "d1"}, []
    for e, _, ids in cands:
        if len(set(ids) - used) >= 2:
            want.append(e)
            used |= set(ids)
    df = spark.createDataFrame([("t", e, r, ids) for e, r, ids in cands], "tenant_id string, entity string, rank long, detection_ids array<string>")
    got = I.admit_slow_burn(df, spark.createDataFrame([("d0",), ("d1",)], "detection_id string"))
    assert sorted(r["entity"] for r in got.collect()) == sorted(want)


def test_story_spine_breaks_cycles(spark):
    rows = [("t", "i", "user:a", "host:H"), ("t", "i", "host:H", "process:p"), ("t", "i", "process:p", "ip:1"), ("t", "i", "process:p", "process:q"), ("t", "i", "process:q", "process:p")]
    got = A.story_spine(spark.createDataFrame(rows, "tenant_id string, incident_id string, src string, dst string")).first()
    assert got["path"] == ["user:a", "host:H", "process:p", "process:q"]


def test_plans_have_no_nested_loop(spark):
    df = frame(spark, [event(i, i, host="h", user="u") for i in range(5)])
    dets = run_rules(df, [RuleSpec(id="M", title="m", group_by=["host"], where={"action": "login_failure"})])
    plan = C.temporal_links(dets)._jdf.queryExecution().toString() + dets._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_waiting_intervals_cost_no_walk_per_row():
    """20,000 intervals of one host wait; each of them is linked once another host appears, ended ones are not (F14)."""
    sweep, started = C.NeighbourSweep(10**9), time.process_time()
    state = sweep.start("t|ip")
    for i in range(20_000):
        assert not sweep.step("t|ip", state, (i, i, "A", f"c{i:05d}"))
    assert time.process_time() - started < 4
    got = sweep.step("t|ip", state, (10**9 + 10_000, 10**9 + 10_000, "B", "other"))
    assert [link["src"] for link in got] == ["c19999"] + [f"c{i:05d}" for i in range(10_000, 19_999)]
    assert len(sweep.step("t|ip", state, (10**9 + 10_001, 10**9 + 10_001, "A", "late"))) == 1
