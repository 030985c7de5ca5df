import json

from helpers import event, frame
from pyspark.sql import functions as F

from nightjar.operators.rules import RuleSpec, run_rules
from nightjar.schema import EVENT_SCHEMA
from nightjar.streaming import jobs as J

FAILED = {"event_type": "authentication", "action": "login_failure"}
PASSED = {"event_type": "authentication", "action": "login_success"}
RULES = [
    RuleSpec(id="M", title="", group_by=["host"], where=FAILED, cooldown_seconds=30),
    RuleSpec(id="T", title="", kind="threshold", group_by=["host"], where=FAILED, window_seconds=60, count_gte=3, cooldown_seconds=10),
    RuleSpec(id="S", title="", kind="sequence", group_by=["host"], window_seconds=60, steps=[FAILED, PASSED]),
]


def test_stream_equals_batch(spark, tmp_path):
    rows = [event(i, (i * 37) % 400, host="A" if i % 3 else "b", action="login_failure" if i % 4 else "login_success") for i in range(60)]
    closing = [event(1000 + i, 5000, host=h, action="logoff") for i, h in enumerate(["A", "b"])]
    columns = [c for c in EVENT_SCHEMA.names if c != "raw"]
    for part in (0, 1):
        frame(spark, rows[part::2]).select(columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame(spark, closing).select(columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = frame(spark, rows).select(columns).schema
    # a last, later hit of every rule key moves the watermark past all others
    late = [event(2000 + i, 9000, host=h) for i, h in enumerate(["A", "b"])]
    frame(spark, late).select(columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = J.run_available(J.stream_rules(stream, RULES, "0 seconds"), str(tmp_path / "cp"), J.append_to(str(tmp_path / "out")))
    query.awaitTermination(150)
    got = {(r["rule_id"], tuple(r["evidence_event_ids"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["rule_id"], tuple(r["evidence_event_ids"])) for r in run_rules(frame(spark, rows), RULES).collect()}
    assert want and want <= got
    assert all(any(e.startswith("evt_0007") for e in ids) for _, ids in got - want)


def test_quarantine_and_dedup(spark, tmp_path):
    good = {"collector": "zeek", "ts": 1709542800, "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "orig_bytes": 10}
    lines = [json.dumps(good), json.dumps(good), "not json", json.dumps({"source": "nowhere", "event_type": "authentication", "action": "x", "timestamp": "2024-01-01T00:00:00Z"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    J.stream_events(J.stream_records(spark, str(tmp_path / "in")), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp1"), once=True).awaitTermination(90)
    good = spark.read.parquet(str(tmp_path / "good"))
    assert good.count() == 2
    reasons = {r["v"] for r in spark.read.parquet(str(tmp_path / "bad")).select(F.explode("violations").alias("v")).collect()}
    assert reasons == {"not a JSON object", "unknown source"}
    stream = spark.readStream.schema(good.schema).parquet(str(tmp_path / "good")).drop("raw")
    J.run_available(J.stream_dedup(stream), str(tmp_path / "cp2"), J.append_to(str(tmp_path / "unique"))).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "unique")).count() == 1


def test_correlation_and_ledger_follow_detections(spark, tmp_path):
    rows = [event(i, i * 60, host="A", user="bob") for i in range(4)]
    dets = run_rules(frame(spark, rows), [RuleSpec(id="M", title="m", severity="high", group_by=["host"], where=FAILED, cooldown_seconds=0)])
    dets.write.parquet(str(tmp_path / "dets"))
    stream = spark.readStream.schema(dets.schema).parquet(str(tmp_path / "dets"))
    J.stream_correlate(stream, str(tmp_path / "table"), str(tmp_path / "inc"), str(tmp_path / "cp3"), once=True).awaitTermination(90)
    inc = spark.read.parquet(str(tmp_path / "inc")).collect()
    assert [(r["detections"], r["affected_users"]) for r in inc] == [(4, ["bob"])]
    J.stream_ledger(stream, str(tmp_path / "bal"), str(tmp_path / "cp4"), once=True).awaitTermination(60)
    assert {r["entity"] for r in spark.read.parquet(str(tmp_path / "bal")).collect()} == {"host:A", "user:bob"}


def _detections(spark, rows):
    """Detections of (id, tenant, day, host, user), scored so that single ones are admitted."""
    from datetime import timedelta

    from helpers import START

    schema = "detection_id string, tenant_id string, kind string, rule_id string, title string, description string, severity string, score double, confidence double, techniques array<string>, phase string, timestamp timestamp, entities map<string,string>, evidence_event_ids array<string>, details map<string,string>"
    return spark.createDataFrame([
        (i, tenant, "rule", "R", "t", "d", "high", 60.0, 0.9, ["T1078"], "execution", START + timedelta(days=day), {"host": host, "user": user}, [f"evt_{i}"], {}) for i, tenant, day, host, user in rows], schema)


def test_batches_over_forty_days_and_two_tenants(spark, tmp_path):
    """Old incidents stay, new detections join them or merge them, ids and statuses last, tenants keep apart."""
    table, incidents = str(tmp_path / "dets"), str(tmp_path / "inc")
    batches = [
        [("a1", "t", 0.0, "A", "ann"), ("b1", "t", 0.0, "B", "bob"), ("x1", "u", 0.0, "A", "ann")],
        [("c1", "t", 40.0, "C", "cid"), ("x2", "u", 40.0, "X", "xen")],
        [("m1", "t", 0.01, "A", "bob"), ("c2", "t", 40.01, "C", "cid")],
    ]
    seen = []
    for n, rows in enumerate(batches):
        fresh = _detections(spark, rows)
        J.append_to(table)(fresh, n)
        J.correlate_batch(fresh, n, table, incidents)
        seen.append({(r["tenant_id"], r["incident_id"]): r for r in J.current_incidents(spark, incidents).collect()})
    assert [len(x) for x in seen] == [3, 5, 4]
    assert len({i for _, i in seen[1]}) == 5 and set(seen[0]) < set(seen[1])
    assert sorted((t, r["detections"]) for (t, _), r in seen[2].items()) == [("t", 2), ("t", 3), ("u", 1), ("u", 1)]
    assert set(seen[2]) < set(seen[1])  # merged and grown incidents keep an id they had
    J.correlate_batch(_detections(spark, batches[2]), 2, table, incidents)  # a repeated batch changes nothing
    assert {(r["tenant_id"], r["incident_id"]) for r in J.current_incidents(spark, incidents).collect()} == set(seen[2])


def test_ledger_batches_equal_one_ledger(spark, tmp_path):
    """Batches overlap by one detection and are out of order; each touches only the state of its own entities."""
    from nightjar.operators import ledger as L

    rows = [(f"d{i}", "t", i * 3.7 % 20, "AB"[i % 2], "ann") for i in range(12)] + [("late", "t", 0.5, "C", "cid")]
    for n in range(4):
        part = _detections(spark, rows[n * 4:n * 4 + 5])
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.stream_ledger(stream, str(tmp_path / "bal"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    want = {r["entity"]: r for r in L.ledger_balance(L.ledger_deposits(_detections(spark, rows))).collect()}
    got = {r["entity"]: r for r in J.current_balances(spark, str(tmp_path / "bal")).collect()}
    assert set(got) == set(want) == {"host:A", "host:B", "host:C", "user:ann", "user:cid"}
    for k, r in want.items():
        assert got[k]["deposits"] == r["deposits"] and got[k]["updated"] == r["updated"] and abs(got[k]["balance"] - r["balance"]) < 1e-9
    changed = spark.read.parquet(str(tmp_path / "bal")).where("batch = 2").select("entity").collect()
    assert {r["entity"] for r in changed} == {"host:A", "host:B", "host:C", "user:ann", "user:cid"}
    assert not spark.read.parquet(str(tmp_path / "bal")).where("batch = 3").count()  # the last batch repeats a detection


def test_rule_state_ends(spark):
    from nightjar.operators.rules import RuleFold

    fold = RuleFold(RULES)
    state = fold.start("0002|t|a")
    fold.step("0002|t|a", state, (1_000_000, 1, 2, 1, None, {"action": "x"}))
    assert fold.horizon("0002|t|a", state) == 61_000_000
    state = fold.start("0000|t|a")
    fold.step("0000|t|a", state, (5_000_000, 1, 0, 1, None, {"action": "x"}))
    assert fold.horizon("0000|t|a", state) == 35_000_000


def test_every_completed_sequence_fires_without_a_cooldown(spark):
    rows = [event(0, 0, host="a"), event(1, 5, host="a"), event(2, 10, host="a", action="login_success")]
    found = run_rules(frame(spark, rows), [RuleSpec(id="S", title="", kind="sequence", group_by=["host"], window_seconds=60, cooldown_seconds=0, steps=[FAILED, PASSED])]).collect()
    assert {tuple(r["evidence_event_ids"]) for r in found} == {("evt_000000", "evt_000002"), ("evt_000001", "evt_000002")}
