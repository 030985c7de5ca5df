import random
import time
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from helpers import event, frame
from pyspark.sql import functions as F

from nightjar.functions.conditions import for_type, holds
from nightjar.operators import ordered as O
from nightjar.operators.ordered import cooldown, with_row_index
from nightjar.operators.rules import RuleFold, RuleSpec, run_rules, scan_conditions
from nightjar.plans.rulepack import RULES

FAILED = {"event_type": "authentication", "action": "login_failure"}
PASSED = {"event_type": "authentication", "action": "login_success"}


def fires(spark, rows, *rules, blocks=None):
    got = run_rules(frame(spark, rows), list(rules), blocks=blocks).select("rule_id", F.unix_micros("timestamp").alias("t"), "evidence_event_ids").collect()
    return sorted((r["rule_id"], r["t"], tuple(r["evidence_event_ids"])) for r in got)


def test_cooldown_hides_second_match(spark):
    rule = RuleSpec(id="M", title="m", group_by=["host"], where=FAILED, cooldown_seconds=600)
    rows = [event(0, 0, host="A"), event(1, 10, host="A"), event(2, 600, host="a")]
    assert [e for _, _, e in fires(spark, rows, rule)] == [("evt_000000",), ("evt_000002",)]


def test_threshold_then_fires_at_success(spark):
    rule = RuleSpec(id="T", title="t", kind="threshold", window_seconds=180, count_gte=5, where=FAILED, then=PASSED)
    rows = [event(i, i, user="bob") for i in range(5)] + [event(5, 10, user="bob", action="login_success")]
    assert [len(e) for _, _, e in fires(spark, rows, rule)] == [6]


def test_threshold_distinct(spark):
    rule = RuleSpec(id="D", title="d", kind="threshold", group_by=["src_ip"], count_gte=3, distinct="user", where=FAILED)
    rows = [event(i, i, user=f"u{i}", src_ip="1.2.3.4") for i in range(3)]
    assert len(fires(spark, rows, rule)) == 1


def test_sequence_order_and_window(spark):
    rule = RuleSpec(id="S", title="s", kind="sequence", group_by=["host"], window_seconds=60, steps=[FAILED, PASSED])
    near = [event(0, 0, host="H"), event(1, 5, host="H", action="login_success")]
    far = [event(0, 0, host="H"), event(1, 120, host="H", action="login_success")]
    assert [len(e) for _, _, e in fires(spark, near, rule)] == [2]
    assert fires(spark, far, rule) == []


def test_pack_is_complete():
    kinds = [r.kind for r in RULES]
    assert (len(RULES), kinds.count("match"), kinds.count("threshold"), kinds.count("sequence")) == (66, 43, 14, 9)
    assert len({r.id for r in RULES}) == 66


def model(rows, rule):
    """Plain one-key-at-a-time model of the rule semantics, used as the yardstick."""
    out, last, windows, armed, partials = [], {}, {}, {}, {}

    def cooled(key, t):
        if key in last and t - last[key] < rule.cooldown_seconds:
            return True
        last[key] = t
        return False

    def is_(spec, r):
        return all(r[k] == v for k, v in spec.items())

    for r in sorted(rows, key=lambda r: (r["timestamp"], r["seq"])):
        key, t = r[rule.group_by[0]], r["timestamp"].timestamp()
        if key is None and rule.kind != "match":
            continue
        key = (key or r["event_id"]).lower()
        if rule.kind == "match":
            if is_(rule.where, r) and not cooled(key, t):
                out.append((t, [r]))
        elif rule.kind == "threshold":
            if rule.then and key in armed and is_(rule.then, r):
                seed = armed.pop(key)
                if t <= seed[0]["timestamp"].timestamp() + rule.window_seconds and not cooled(key, t):
                    out.append((t, seed + [r]))
                continue
            if is_(rule.where, r):
                dq = windows.setdefault(key, deque())
                dq.append(r)
                while dq[0]["timestamp"].timestamp() < t - rule.window_seconds:
                    dq.popleft()
                size = len({x[rule.distinct] for x in dq}) if rule.distinct else len(dq)
                if size >= rule.count_gte:
                    evs = list(dq)
                    dq.clear()
                    if rule.then:
                        armed[key] = evs
                    elif not cooled(key, t):
                        out.append((t, evs))
        else:
            live = [p for p in partials.get(key, []) if t - p[0]["timestamp"].timestamp() <= rule.window_seconds]
            nxt, done = [], False
            for p in live:
                if is_(rule.steps[len(p)], r):
                    if len(p) + 1 == len(rule.steps):
                        done = True
                        if not cooled(key, t):
                            out.append((t, p + [r]))
                    else:
                        nxt.append(p + [r])
                else:
                    nxt.append(p)
            if done:
                nxt = []
            elif is_(rule.steps[0], r):
                nxt.append([r])
            partials[key] = nxt[-64:]
    return sorted((rule.id, round(t * 1e6), tuple(e["event_id"] for e in evs)) for t, evs in out)


RANDOM_RULES = [
    RuleSpec(id="R1", title="", group_by=["host"], where=FAILED, cooldown_seconds=40),
    RuleSpec(id="R3", title="", kind="threshold", group_by=["host"], where=FAILED, window_seconds=30, count_gte=4, cooldown_seconds=50),
    RuleSpec(id="R4", title="", kind="threshold", group_by=["host"], where=FAILED, window_seconds=60, count_gte=3, distinct="user", cooldown_seconds=20),
    RuleSpec(id="R5", title="", kind="threshold", group_by=["user"], where=FAILED, then=PASSED, window_seconds=60, count_gte=2, cooldown_seconds=30),
    RuleSpec(id="R6", title="", kind="sequence", group_by=["host"], window_seconds=45, cooldown_seconds=10, steps=[FAILED, PASSED, {"event_type": "authentication"}]),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_match_model_with_a_hot_key_over_many_blocks(spark, seed):
    rng = random.Random(seed)
    rows = [event(i, rng.randrange(0, 900) if i % 5 else 450, host="HOT" if rng.random() < 0.6 else rng.choice(["a", "B", None]), user=rng.choice(["u1", "u2", "u3", None]),
                  action=rng.choice(["login_failure", "login_failure", "login_success"])) for i in range(500)]
    expected = sorted(x for r in RANDOM_RULES for x in model(rows, r))
    assert fires(spark, rows, *RANDOM_RULES, blocks=13) == expected
    assert fires(spark, rows, *RANDOM_RULES, blocks=2) == expected


def test_cooldown_boundary_and_ties(spark):
    rows = [event(i, t, host="h") for i, t in enumerate([0, 0, 9.999999, 10, 15, 20, 20])]
    df = frame(spark, rows).withColumn("ts_us", F.unix_micros("timestamp"))
    assert sorted(r["seq"] for r in cooldown(df, ["host"], 10_000_000, ["seq"], blocks=4).collect()) == [0, 3, 5]


def test_row_index_spans_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    got = with_row_index(df, ["k"], ["o"]).where(F.col("row_index") != F.floor(F.col("o") / 3))
    assert got.count() == 0


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_greedy_spacing_of_a_key_over_many_blocks(spark, blocks):
    """One key over all blocks, some small keys, ties and a quiet gap: the walk of a single task."""
    rng = random.Random(5)
    rows, ts = [], 0
    for i in range(900):
        ts += rng.choice([0, 1, 3, 10]) if i != 400 else 5_000
        rows.append(("hot", ts, i))
    rows += [(f"k{i % 37}", rng.randrange(300), 1_000 + i) for i in range(200)]
    for gap in (1, 25, 400, 10**6):
        want, last = set(), {}
        for key, at, seq in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
            if key not in last or at - last[key] >= gap:
                last[key] = at
                want.add(seq)
        frame = spark.createDataFrame(rows, "user string, ts_us long, seq long").repartition(5)
        got = [r["seq"] for r in cooldown(frame, ["user"], gap, ["seq"], blocks).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_step_functions_compose_like_the_walk():
    rng = np.random.default_rng(2)
    for _ in range(200):
        at = np.sort(rng.integers(0, 60, 12))
        then = np.maximum.accumulate(at + rng.integers(0, 30, 12))
        cut = int(rng.integers(1, 11))

        def walk(a, t, limit):
            for x, y in zip(a, t, strict=True):
                limit = y if x >= limit else limit
            return limit

        parts = [O._pieces(at[:cut], then[:cut]), O._pieces(at[cut:], then[cut:])]
        table = [pa.table({"fold_key": ["k"] * len(b), "place": pa.array([1] * len(b), pa.int32()), "bound": b, "value": v}) for b, v in parts]
        both = O._compose(table[1], table[0])
        for limit in range(-2, 100, 3):
            assert O._through(*parts[0], np.array([limit]))[0] == walk(at[:cut], then[:cut], limit)
            assert O._through(np.asarray(both["bound"]), np.asarray(both["value"]), np.array([limit]))[0] == walk(at, then, limit)


def test_open_sequences_cost_no_walk_per_row():
    """40,000 rows in one window: a row that moves no open sequence does not touch them (F13, F14, F20, F21)."""
    rule = RuleSpec(id="S", title="s", kind="sequence", group_by=["host"], window_seconds=10**6, cooldown_seconds=0, steps=[FAILED, PASSED, FAILED])
    fold, key = RuleFold([rule]), "0000|t|h"
    state, started = fold.start(key), time.process_time()
    for i in range(20_000):
        assert not fold.step(key, state, (i, i, 0, 1, None, {"event_id": i}))
    for i in range(20_000, 40_000):
        assert not fold.step(key, state, (i, i, 0, 4, None, {"event_id": i}))
    assert time.process_time() - started < 10
    assert not fold.step(key, state, (40_000, 40_000, 0, 2, None, {"event_id": 40_000}))
    fired = fold.step(key, state, (40_001, 40_001, 0, 4, None, {"event_id": 40_001}))
    assert [[e["event_id"] for e in f["evidence"]] for f in fired[:2]] == [[0, 40_000, 40_001], [1, 40_000, 40_001]] and len(fired) == 20_000
    assert not state["partials"]


def test_conditions_by_event_type_hold_as_whole(spark):
    """What is left of a condition for a type holds for the same events as the whole condition (F13, F14, F20, F21)."""
    assert for_type({"event_type": {"in": ["A", "b"]}, "user": "x"}, "a") == {"user": "x"}
    assert for_type({"any_of": [{"event_type": "a"}, {"event_type": "b", "host": "h"}]}, "b") == {"any_of": [{"host": "h"}]}
    assert for_type({"any_of": [{"event_type": "a"}, {"event_type": "b"}]}, "c") is None
    assert for_type({"not": {"event_type": "a"}, "event_type": {"not_in": ["b"]}}, "a") == {"not": {"event_type": "a"}, "event_type": {"not_in": ["b"]}}
    specs = [FAILED, {"event_type": {"in": ["PROCESS_START", "file_read"]}}, {"not": {"event_type": "file_read"}}, {"event_type": {"not_in": ["file_read"]}}, {"event_type": None},
             {"any_of": [{"event_type": "file_read", "bytes_out": {"gte": 5}}, {"user": {"startswith": "Ä"}}]}, {"dst_ip": {"private": True}}, {"event_type": "dns_query", "domain": {"exists": False}}, {}]
    kinds = ["authentication", "Process_Start", "file_read", "other", "dns_query", None]
    rows = [event(i, i, event_type=kinds[i % 6], user=[None, "", "äb", "bob"][i % 4], bytes_out=[None, 3, 9][i % 3], dst_ip=[None, "10.0.0.1", "8.8.8.8", "x"][i % 4], domain=[None, "a.b"][i % 2])
            for i in range(48)]
    events = frame(spark, rows)
    rules = [RuleSpec(id=f"R{i}", title="", where=s) for i, s in enumerate(specs)] + [RuleSpec(id="S", title="", kind="sequence", steps=specs[:4])]
    got = sorted((r["rule_idx"], r["event_id"], r["mask"]) for r in scan_conditions(events, rules).collect())
    bits = events.select("event_id", *[holds(events, s).cast("int").alias(f"h{i}") for i, s in enumerate(specs)]).collect()
    want = [(i, r["event_id"], 1) for r in bits for i in range(len(specs)) if r[f"h{i}"]]
    want += [(len(specs), r["event_id"], m) for r in bits if (m := sum(r[f"h{i}"] << i for i in range(4)))]
    assert got == sorted(want)


def test_payload_comes_back_as_it_was(spark):
    odd = 'a"b\\c\n{|}é\u0001'
    rule = RuleSpec(id="T", title="t", kind="threshold", group_by=["host"], window_seconds=180, count_gte=2, where=FAILED, then=PASSED)
    rows = [event(0, 0, host=odd, user=""), event(1, 1, host=odd, user=odd), event(2, 2, host=odd, action="login_success", src_ip=None)]
    got = run_rules(frame(spark, rows), [rule, RuleSpec(id="M", title="m", group_by=["host"], where=PASSED)]).collect()
    assert {r["rule_id"]: r["entities"] for r in got} == {"T": {"user": odd, "host": odd}, "M": {"host": odd}}
    assert {r["rule_id"]: r["details"].get("followed_by") for r in got} == {"T": "login_success", "M": None}
