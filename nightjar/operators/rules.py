"""Rule operators: one scan for all conditions, then one ordered fold for all stateful rules."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from nightjar.functions.conditions import ConditionCompiler, event_types_of, fields_of, for_type, with_raw_fields
from nightjar.operators.ordered import Fold, fold_ordered, keep_spaced
from nightjar.schema import DEFAULT_SCORE, DETECTION_COLUMNS, S, digest_id, micros, seconds
from nightjar.session import materialize

WHERE, THEN = 1, 2


@dataclass
class RuleSpec:
    """A detection rule as plain data. ``kind`` is match, threshold or sequence."""

    id: str
    title: str
    kind: str = "match"
    severity: str = "medium"
    score: float | None = None
    techniques: list[str] = field(default_factory=list)
    phase: str | None = None
    description: str = ""
    group_by: list[str] = field(default_factory=lambda: ["user"])
    window_seconds: float = 300
    where: dict[str, Any] | None = None
    count_gte: int = 1
    then: dict[str, Any] | None = None
    steps: list[dict[str, Any]] = field(default_factory=list)
    distinct: str | None = None
    cooldown_seconds: float = 600
    confidence: float = 0.85
    tags: list[str] = field(default_factory=list)
    enabled: bool = True
    sum_field: str | None = None  # with sum_gte: fire on a windowed total instead of a count
    sum_gte: float | None = None

    def __post_init__(self) -> None:
        if self.score is None:
            self.score = DEFAULT_SCORE[self.severity]
        if self.kind not in ("match", "threshold", "sequence"):
            raise ValueError(f"unknown rule kind {self.kind!r} in {self.id}")
        if self.kind == "sequence" and not self.steps:
            raise ValueError(f"sequence rule {self.id} has no steps")

    @property
    def conditions(self) -> list[dict | None]:
        if self.kind == "sequence":
            return list(self.steps)
        return [self.where] + ([self.then] if self.then is not None else [])

    @property
    def detection_kind(self) -> str:
        return "rule" if self.kind == "match" else self.kind


def enabled_rules(rules: list[RuleSpec]) -> list[RuleSpec]:
    return [r for r in rules if r.enabled]


def rule_table(spark, rules: list[RuleSpec]) -> DataFrame:
    """Rule metadata; one row per rule, so its size is fixed by the rule pack."""
    schema = ("rule_idx int, rule_id string, title string, description string, kind string, rule_kind string, severity string, "
              "score double, confidence double, techniques array<string>, phase string, tags array<string>, "
              "group_by array<string>, window_seconds double")
    return spark.createDataFrame(
        [(i, r.id, r.title, r.description, r.detection_kind, r.kind, r.severity, float(r.score), float(r.confidence),
          r.techniques, r.phase, r.tags, r.group_by, float(r.window_seconds)) for i, r in enumerate(rules)], schema)


# --------------------------------------------------------------------------------------------- scan
def scan_conditions(events: DataFrame, rules: list[RuleSpec], max_chars: int | None = None) -> DataFrame:
    """Every condition of every rule in one pass: rows ``(rule_idx, mask, <event columns>)`` for the hits.

    Bit i of ``mask`` tells that condition i of the rule holds (threshold: where, then; sequence: its steps).
    """
    conditions = [c for r in rules for c in r.conditions]
    wanted = set().union(*[fields_of(c) for c in conditions]) if rules else set()
    source = with_raw_fields(events, wanted)
    plain = ConditionCompiler(source, max_chars)
    kinds = sorted(set().union(*[event_types_of(c) for c in conditions])) if rules and plain.field("event_type").is_text else []
    kind = F.lit(-1)
    for i, name in enumerate(kinds):
        kind = F.when(plain.field("event_type").lowered == name, i).otherwise(kind)
    source = source.withColumns(plain.prepared(conditions))
    source = source.withColumn("event_kind", kind)
    compiler = ConditionCompiler(source, max_chars)
    masks = {f"mask_{i}": _mask(compiler, rule, kinds) for i, rule in enumerate(rules)}
    told = source.select(*events.columns, *[m.alias(name) for name, m in masks.items()])
    hits = [F.when(F.col(name) > 0, F.struct(F.lit(i).alias("rule_idx"), F.col(name).alias("mask"))) for i, name in enumerate(masks)]
    return told.select(*events.columns, F.inline(F.array_compact(F.array(*hits))))


def _mask(compiler: ConditionCompiler, rule: RuleSpec, kinds: list[str]) -> Column:
    """Bits of the conditions that hold; an event is held against what the conditions say about its own type alone."""
    if not kinds:
        return _bits(compiler, rule.conditions)
    cases: dict[str, tuple[list, list[int]]] = {}
    for i, name in enumerate([*kinds, None]):
        left = [for_type(c, name) for c in rule.conditions]
        cases.setdefault(repr(left), (left, []))[1].append(i if name is not None else -1)
    mask = F.lit(0)
    for left, at in cases.values():
        if any(c is not None for c in left):
            mask = F.when(F.col("event_kind").isin(at), _bits(compiler, left, True)).otherwise(mask)
    return mask


def _bits(compiler: ConditionCompiler, conditions: list[dict | None], never: bool = False) -> Column:
    """Sum of the bits of the conditions that hold; with ``never`` a condition that is None holds for no row."""
    mask = F.lit(0)
    for bit, condition in enumerate(conditions):
        if condition is not None or not never:
            mask = mask + F.when(compiler.holds(condition), F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


def _pick(rules: list[RuleSpec], value) -> Column:
    """CASE over distinct per-rule values, so that each value is one branch."""
    branches: dict[Any, list[int]] = {}
    for i, r in enumerate(rules):
        branches.setdefault(value(r), []).append(i)
    out = F.lit(None).cast("string")
    for v, idx in branches.items():
        if v is not None:
            out = F.when(F.col("rule_idx").isin(idx), v if isinstance(v, Column) else _value_of(v)).otherwise(out)
    return out


def _escaped(part: Column) -> Column:
    """A part of a joined key, without the joint."""
    return F.replace(F.replace(part, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))


def _value_of(spec: tuple) -> Column:
    kind, names = spec[0], spec[1:]
    if kind == "group":
        values = [F.lower(F.col(n).cast("string")) for n in names]
        return F.when(_all_present(names), values[0] if len(values) == 1 else F.concat_ws("|", *[_escaped(v) for v in values]))
    return F.col(names[0]).cast("string")


def _all_present(names: tuple) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


PAYLOAD_FIELDS = {
    "event_id": "event_id", "tenant_id": "tenant_id", "action": "action", "user": "user", "host": "host",
    "dst_ip": "dst_ip", "src_ip": "src_ip", "domain": "domain", "process": "process_name", "session": "session_id",
}
PAYLOAD_TYPE = T.StructType([T.StructField(n, S) for n in PAYLOAD_FIELDS])
ENTITY_FIELDS = ["user", "host", "dst_ip", "src_ip", "domain", "process", "session"]


def keyed_hits(hits: DataFrame, rules: list[RuleSpec]) -> DataFrame:
    """Fold input: ``fold_key``, time, mask, the counted value and the evidence payload."""
    group = _pick(rules, lambda r: ("group", *r.group_by))
    counted = _pick(rules, lambda r: ("field", r.distinct or r.sum_field) if (r.distinct or r.sum_field) else None)
    match_idx = [i for i, r in enumerate(rules) if r.kind == "match"]
    is_match = F.col("rule_idx").isin(match_idx) if match_idx else F.lit(False)
    key = F.when(is_match, F.coalesce(F.nullif(group, F.lit("")), F.col("event_id"))).otherwise(group)
    payload = F.struct(*[F.col(source).alias(name) for name, source in PAYLOAD_FIELDS.items()])
    return (
        hits.withColumn("group_key", key)
        .where(F.col("group_key").isNotNull())
        .select(
            F.concat_ws("|", F.lpad(F.col("rule_idx").cast("string"), 4, "0"), _escaped(F.col("tenant_id")), F.col("group_key")).alias("fold_key"),
            micros(F.col("timestamp")).alias("ts_us"), "seq", "rule_idx", "mask", counted.alias("counted"), payload.alias("payload"),
        )
    )


# --------------------------------------------------------------------------------------------- fold
def _cooled(state: dict, ts: int, gap: int) -> bool:
    """True when the alert is hidden; otherwise remembers this firing."""
    if state["last"] is not None and ts - state["last"] < gap:
        return True
    state["last"] = ts
    return False


class RuleFold(Fold):
    """Cooldown, threshold, threshold-then and sequence state, chosen by the rule of the row."""

    columns = ["ts_us", "seq", "rule_idx", "mask", "counted", "payload"]
    schema = T.StructType([
        T.StructField("rule_idx", T.IntegerType()), T.StructField("group_key", S), T.StructField("ts_us", T.LongType()),
        T.StructField("seq", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("followed_by", S),
        T.StructField("evidence", T.ArrayType(PAYLOAD_TYPE)),
    ])

    def __init__(self, rules: list[RuleSpec], packed: bool = False):
        """``packed``: the payload of a row is one text, which is cheaper to hand to Python, and so is each piece of evidence."""
        if packed:
            self.schema = T.StructType([T.StructField("evidence", T.ArrayType(S)) if f.name == "evidence" else f for f in self.schema.fields])
        self.rules = [
            dict(kind=r.kind, window=seconds(r.window_seconds), gap=seconds(r.cooldown_seconds), need=r.count_gte,
                 distinct=bool(r.distinct), then=r.then is not None, steps=len(r.steps), total=r.sum_gte)
            for r in rules
        ]

    def start(self, key: str) -> dict:
        return {"last": None, "window": deque(), "tally": {}, "armed": None, "partials": []}

    def step(self, key: str, state: dict, row: tuple) -> Iterable[dict]:
        rule = self.rules[row[2]]
        if rule["kind"] == "match":
            fired = [] if _cooled(state, row[0], rule["gap"]) else [([row[4:]], None, None)]
        elif rule["kind"] == "threshold":
            found = self._threshold(rule, state, row)
            fired = [] if found is None else [found]
        else:
            fired = self._sequence(rule, state, row)
        return [{"rule_idx": row[2], "group_key": key.split("|", 2)[2], "ts_us": row[0], "seq": row[1], "n": n,
                 "followed_by": followed_by, "evidence": [i[-1] for i in items]} for items, n, followed_by in fired]

    def memory(self, key: str) -> int | None:
        """Windows, open sequences and cooldowns have lapsed; an armed rule stays armed until the next row that it waits for."""
        rule = self.rules[int(key.split("|", 1)[0])]
        return None if rule["then"] else max(rule["window"], rule["gap"])

    def horizon(self, key: str, state: dict) -> int:
        rule = self.rules[int(key.split("|", 1)[0])]
        ends = [0] if state["last"] is None else [state["last"] + rule["gap"]]
        ends += [state["window"][-1][0] + rule["window"]] if state["window"] else []
        ends += [state["armed"][0][0] + rule["window"]] if state["armed"] else []
        return max(ends + [level[-1][0] + rule["window"] for level in state["partials"] if level])

    @staticmethod
    def _threshold(rule: dict, state: dict, row: tuple):
        ts, _, _, mask, counted, payload = row
        if rule["then"] and state["armed"] is not None and mask & THEN:
            seed, state["armed"] = state["armed"], None
            if ts <= seed[0][0] + rule["window"] and not _cooled(state, ts, rule["gap"]):
                return seed + [(ts, counted, payload)], len(seed), _unpacked(payload)["action"]
            return None
        if not mask & WHERE:
            return None
        window, tally = state["window"], state["tally"]
        window.append((ts, counted, payload))
        tally[counted] = tally.get(counted, 0) + 1
        while window[0][0] < ts - rule["window"]:
            gone = window.popleft()[1]
            tally[gone] -= 1
            if not tally[gone]:
                del tally[gone]
        if rule["total"] is not None:
            reached = sum(float(v or 0) * n for v, n in tally.items()) >= rule["total"]
        else:
            reached = (len(tally) if rule["distinct"] else len(window)) >= rule["need"]
        if not reached:
            return None
        items = list(window)
        window.clear()
        tally.clear()
        if rule["then"]:
            state["armed"] = items
            return None
        return None if _cooled(state, ts, rule["gap"]) else (items, len(items), None)

    @staticmethod
    def _sequence(rule: dict, state: dict, row: tuple) -> list:
        """Every sequence that this event completes fires, unless the cooldown hides it; open ones live as long as the window.

        ``partials[k]`` holds the open sequences with k + 1 steps done as (time of the first, (.., item)), oldest first. All of
        them wait for the same step, so an event moves a whole level or none of it, and a row costs as many steps as the rule has.
        """
        ts, _, _, mask, _, payload = row
        item, levels, fired, completed = (ts, payload), state["partials"], [], False
        for level in levels:
            while level and ts - level[0][0] > rule["window"]:
                level.popleft()
        for done in range(len(levels), 0, -1):
            level = levels[done - 1]
            if not level or not mask >> done & 1:
                continue
            if done + 1 < rule["steps"]:
                if done == len(levels):
                    levels.append(deque())
                levels[done].extend((first, (chain, item)) for first, chain in level)  # those there are older
                level.clear()
            else:
                completed = True
                fired += [(_items(chain) + [item], rule["steps"], None) for _, chain in level if not _cooled(state, ts, rule["gap"])]
        if completed:
            state["partials"] = []
        elif mask & 1:
            if not levels:
                levels.append(deque())
            levels[0].append((ts, (None, item)))
        return fired


def _items(chain: tuple | None) -> list:
    """Items of a chain of (what came before, item), first to last."""
    out = []
    while chain is not None:
        chain, item = chain
        out.append(item)
    return out[::-1]


def _unpacked(payload: Any) -> Any:
    return {name: None for name in PAYLOAD_FIELDS} | json.loads(payload) if isinstance(payload, str) else payload


def _first_filled(evidence: Column, name: str) -> Column:
    values = F.filter(evidence.getField(name), lambda v: v.isNotNull() & (v != ""))
    return F.try_element_at(values, F.lit(1))


def entities_of(evidence: Column) -> Column:
    """First non-empty value of each entity, in evidence order."""
    pairs = [p for name in ENTITY_FIELDS for p in (F.lit(name), _first_filled(evidence, name))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def detections_from_fires(fires: DataFrame, rules: list[RuleSpec]) -> DataFrame:
    """Fires -> detections with rule metadata, entities and evidence."""
    table = rule_table(fires.sparkSession, rules)
    joined = fires.join(F.broadcast(table), "rule_idx")
    ids = F.col("evidence").getField("event_id")
    detail_keys = F.map_filter(
        F.create_map(
            F.lit("rule_kind"), F.col("rule_kind"),
            F.lit("count"), F.when(F.col("rule_kind") == "threshold", F.col("n").cast("string")),
            F.lit("followed_by"), F.col("followed_by"),
            F.lit("steps"), F.when(F.col("rule_kind") == "sequence", F.col("n").cast("string")),
        ), lambda _, v: v.isNotNull())
    return joined.select(
        digest_id("det_", F.col("rule_id"), F.col("group_key"), F.col("ts_us"), F.array_join(ids, ",")).alias("detection_id"),
        F.element_at("evidence", -1)["tenant_id"].alias("tenant_id"),
        "kind", "rule_id", "title", "description", "severity", "score", "confidence", "techniques", "phase",
        F.timestamp_micros("ts_us").alias("timestamp"),
        entities_of(F.col("evidence")).alias("entities"),
        ids.alias("evidence_event_ids"),
        detail_keys.alias("details"),
    )


def match_fires(hits: DataFrame, rules: list[RuleSpec], blocks: int | None = None) -> DataFrame:
    """Fires of the match rules among keyed hits: rows that their rule's cooldown leaves."""
    by_gap: dict[int, list[int]] = {}
    for i, r in enumerate(rules):
        by_gap.setdefault(seconds(r.cooldown_seconds), []).append(i)
    gap = F.lit(0)
    for us, idx in by_gap.items():
        gap = F.when(F.col("rule_idx").isin(idx), us).otherwise(gap)
    spaced = hits.select("fold_key", "ts_us", "seq", "rule_idx", "payload", F.col("ts_us").alias("at"), (F.col("ts_us") + gap).alias("then"))
    kept = keep_spaced(spaced, ["ts_us", "seq"], blocks)
    return kept.select("rule_idx", F.split("fold_key", r"\|", 3)[2].alias("group_key"), "ts_us", "seq", F.lit(None).cast("int").alias("n"),
                       F.lit(None).cast("string").alias("followed_by"), F.array("payload").alias("evidence"))


def run_rules(events: DataFrame, rules: list[RuleSpec], max_chars: int | None = None, blocks: int | None = None) -> DataFrame:
    """Detections of a rule pack: one scan; match rules by greedy spacing, rules with windows or steps by one ordered fold."""
    active = enabled_rules(rules)
    # range partitioning samples its input: keep the hits, so that the conditions run once per event; a payload travels as one text
    hits = materialize(keyed_hits(scan_conditions(events, active, max_chars), active).withColumn("payload", F.to_json("payload")))
    plain = [i for i, r in enumerate(active) if r.kind == "match"]
    parts = []
    if plain:
        parts.append(match_fires(hits.where(F.col("rule_idx").isin(plain)), active, blocks))
    if len(plain) < len(active):
        parts.append(fold_ordered(hits.where(~F.col("rule_idx").isin(plain)), RuleFold(active, packed=True), ["ts_us", "seq"], blocks))
    if not parts:
        parts.append(hits.sparkSession.createDataFrame([], RuleFold(active, packed=True).schema))
    fires = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return detections_from_fires(fires.withColumn("evidence", F.transform("evidence", lambda x: F.from_json(x, PAYLOAD_TYPE))), active)


def union_detections(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*DETECTION_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*DETECTION_COLUMNS))
    return out


def fired_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("rule_id").agg(F.count(F.lit(1)).alias("fired"))


def hit_counts(hits: DataFrame, rules: list[RuleSpec]) -> DataFrame:
    """Matching events per rule before any state."""
    counted = hits.groupBy("rule_idx").agg(F.count(F.lit(1)).alias("hits"))
    table = rule_table(hits.sparkSession, rules).select("rule_idx", "rule_id")
    return table.join(F.broadcast(counted), "rule_idx", "left").select("rule_id", F.coalesce("hits", F.lit(0)).alias("hits"))


