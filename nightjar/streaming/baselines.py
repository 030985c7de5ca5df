"""Statistical baselines over a stream: per-key state in event-time order, equal to the batch operators.

Every event is dealt to the keys it teaches (user for logins, host for starts, transfers and queries). Its row waits in a
sorted part until the watermark has passed it (``WaitingRows``); what a key has learned is read and written once a call, not
per row. Rareness of a process over all hosts is a second state, keyed by the process, that sees only first starts on a host.

State ends in event time: ``idle`` after the last row of a key its state is removed (state TTL of Spark counts
processing time, with which a replay would not give the same result).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from nightjar.functions.net import is_private_ip
from nightjar.functions.text import shannon_entropy
from nightjar.operators import baselines as B
from nightjar.schema import filled, micros, seconds
from nightjar.streaming.jobs import WaitingRows, use_rocksdb

PAYLOAD = T.StructType([
    *[T.StructField(n, T.TimestampType() if n == "timestamp" else T.StringType()) for n in B.CARRIED if n != "timestamp"], T.StructField("seq", T.LongType()),
    T.StructField("ts_us", T.LongType()), T.StructField("hour", T.IntegerType()), T.StructField("src_ip", T.StringType()), T.StructField("geo_country", T.StringType()),
    T.StructField("public_src", T.BooleanType()), T.StructField("bytes_out", T.LongType()), T.StructField("wanted", T.BooleanType()),
    T.StructField("process_name", T.StringType()), T.StructField("parent_process_name", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("label_entropy", T.DoubleType()), T.StructField("label_length", T.IntegerType()), T.StructField("odd_label", T.BooleanType())])
MEASURES = T.StructType([
    T.StructField("history", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("peak_hour", T.IntegerType()), T.StructField("by_country", T.IntegerType()),
    T.StructField("by_ip", T.IntegerType()), T.StructField("median_x", T.DoubleType()), T.StructField("z", T.DoubleType()), T.StructField("org_hosts", T.IntegerType())])
FOUND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("timestamp", T.TimestampType()), *PAYLOAD.fields, *MEASURES.fields])
NAMES = PAYLOAD.names
NOTHING = dict.fromkeys(MEASURES.names)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``step`` in (time, seq) order once the watermark has passed them; ends idle keys."""

    output: T.StructType = FOUND

    def __init__(self, idle_us: int | None):
        self.idle_ms = None if idle_us is None else max(1, idle_us // 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, {}
        self.waiting = WaitingRows(handle)
        self.alive = handle.getValueState("alive", "last bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, kind: str, row: dict) -> Iterator[tuple[str, dict]]:
        """(kind, measures) of what this row shows."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def at_once(self, kind: str, row: dict) -> bool:
        """True for rows that need no state and no order."""
        return False

    def recall(self, name: Any, load: Callable[[], Any]) -> Any:
        """What a state says, read once a call."""
        if name not in self.held:
            self.held[name] = load()
        return self.held[name]

    def store(self) -> None:
        """Write what a call has changed in ``held``."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802 - Spark API
        passed: list[Row] = []

        def values() -> Iterator[tuple]:
            for row in rows:
                held = row.asDict()
                if self.at_once(held["kind"], held):
                    passed.append(self.made(held["kind"], held, {n: held.get(n) for n in MEASURES.names}))
                else:
                    yield held["ts_us"], held["seq"], held

        self.waiting.add(values())
        return iter(passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802 - Spark API
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self.held = {}
        before = self.alive.get()[0] if self.idle_ms is not None and self.alive.exists() else None
        last, ran = before, False
        for piece in self.waiting.take(now):
            for due, rows in groupby(piece, WaitingRows.due):
                if self.idle_ms is not None and last is not None and due - last > self.idle_ms:
                    self.forget()  # the watermark has passed the pause and this row in one step
                    self.held = {}
                last, ran = due, True
                for _, _, row in rows:
                    for kind, measures in self.step(row["kind"], row):
                        yield self.made(kind, row, NOTHING | measures)
        if ran:
            self.store()
        if self.idle_ms is not None and last is not None:
            if last + self.idle_ms <= now:
                self.alive.clear()
                self.forget()
            else:
                self.alive.update((last,))
                if before != last or expiredTimerInfo.getExpiryTimeInMs() >= last + self.idle_ms:
                    self.handle.registerTimer(last + self.idle_ms)

    def made(self, kind: str, row: dict, measures: dict) -> Row:
        return Row(**{n: kind if n == "kind" else measures[n] if n in MEASURES.names else row[n] for n in self.output.names})

    def close(self) -> None:
        pass


class KeyBaselines(InOrder):
    """State of one user or host: hours, places, processes, transfers, queries."""

    def __init__(self, idle_us: int | None, burst: tuple[float, int, float]):
        super().__init__(idle_us)
        self.burst_us, self.burst_count, self.quiet_us = seconds(burst[0]), burst[1], seconds(burst[2])

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", "hour int", "n bigint")
        self.seen = handle.getMapState("seen", "what string", "n bigint")
        self.rows = handle.getValueState("rows", "n bigint")
        self.volumes = handle.getValueState("volumes", "last binary")
        self.lookups = handle.getValueState("lookups", "last binary, fired bigint")

    def forget(self) -> None:
        for state in (self.hours, self.seen, self.rows, self.volumes, self.lookups):
            state.clear()

    def at_once(self, kind: str, row: dict) -> bool:
        return kind == "odd_label"

    def store(self) -> None:
        for name, value in self.held.items():
            if name == "rows":
                self.rows.update((value,))
            elif name == "hours":
                for hour, n in value.items():
                    self.hours.updateValue((hour,), (n,))
            elif name == "volumes":
                self.volumes.update((value.tobytes(),))
            elif name == "lookups":
                self.lookups.update((value[0].tobytes(), value[1]))
            elif value:
                self.seen.updateValue((name[1],), (1,))

    def count(self) -> int:
        """Rows of this key before this one."""
        before = self.recall("rows", lambda: self.rows.get()[0] if self.rows.exists() else 0)
        self.held["rows"] = before + 1
        return before

    def first(self, what: str) -> bool:
        """True once per value; ``held`` tells those that are new in this call."""
        name = ("seen", what)
        if name in self.held:
            return False
        self.held[name] = not self.seen.containsKey((what,))
        return self.held[name]

    def step(self, kind: str, row: dict) -> Iterator[tuple[str, dict]]:
        return getattr(self, kind)(row)

    def login(self, row: dict) -> Iterator[tuple[str, dict]]:
        before, hist = self.count(), self.recall("hours", lambda: {k[0]: v[0] for k, v in self.hours.iterator()})
        share = sum(hist.get((row["hour"] + off) % 24, 0) * w for off, w in ((23, 0.5), (0, 1.0), (1, 0.5))) / (2.0 * before) if before else None
        if before >= B.LOGIN_HISTORY and share < B.LOGIN_SHARE:
            most = max(hist.values())
            yield "login_hour", {"history": before, "share": share, "peak_hour": min(h for h, n in hist.items() if n == most)}
        hist[row["hour"]] = hist.get(row["hour"], 0) + 1
        new_country = bool(row["geo_country"]) and self.first("country:" + row["geo_country"])
        new_ip = bool(row["src_ip"]) and bool(row["public_src"]) and self.first("ip:" + row["src_ip"])
        if before >= B.LOCATION_HISTORY and (new_country or new_ip):
            yield "location", {"by_country": int(new_country), "by_ip": int(new_ip)}

    def start(self, row: dict) -> Iterator[tuple[str, dict]]:
        before = self.count()
        if self.first(row["process_name"].lower()):
            yield "first_start", {"history": before}

    def transfer(self, row: dict) -> Iterator[tuple[str, dict]]:
        past = self.recall("volumes", lambda: np.frombuffer(bytes(self.volumes.get()[0]), dtype=np.float64) if self.volumes.exists() else np.empty(0))
        x = float(np.log1p(row["bytes_out"]))
        if row["wanted"] and len(past) >= B.VOLUME_HISTORY:
            middle = float(np.median(past))
            if x > middle:
                z = B.Z_SCALE * (x - middle) / (float(np.median(np.abs(past - middle))) or B.MAD_FLOOR)
                if z >= B.VOLUME_Z:
                    yield "egress", {"median_x": middle, "z": z}
        self.held["volumes"] = np.append(past, x)[-B.VOLUME_KEEP:]

    def lookup(self, row: dict) -> Iterator[tuple[str, dict]]:
        last, fired = self.recall("lookups", self.known_lookups)
        times = np.append(last, row["ts_us"])[-self.burst_count:]
        if len(times) == self.burst_count and times[0] >= row["ts_us"] - self.burst_us and (fired is None or row["ts_us"] - fired > self.quiet_us):
            fired = row["ts_us"]
            yield "burst", {}
        self.held["lookups"] = (times, fired)

    def known_lookups(self) -> tuple[np.ndarray, int | None]:
        last, fired = self.lookups.get() if self.lookups.exists() else (b"", None)
        return np.frombuffer(bytes(last), dtype=np.int64), fired


class ProcessSpread(InOrder):
    """How many hosts have started one process; other findings pass."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.hosts = handle.getValueState("hosts", "n int")

    def store(self) -> None:
        self.hosts.update((self.held["hosts"],))

    def forget(self) -> None:
        self.hosts.clear()

    def at_once(self, kind: str, row: dict) -> bool:
        return kind != "first_start"

    def step(self, kind: str, row: dict) -> Iterator[tuple[str, dict]]:
        known = self.recall("hosts", lambda: self.hosts.get()[0] if self.hosts.exists() else 0)
        self.held["hosts"] = known + 1
        if row["history"] >= B.PROCESS_HISTORY and known <= B.PROCESS_HOSTS:
            yield "rare_process", {"org_hosts": known}


def dealt(events: DataFrame) -> DataFrame:
    """``(key, kind, timestamp, <payload>)``: each event once per baseline that it teaches."""
    labels = F.split(F.lower("domain"), r"\.")
    label = F.when(F.size(labels) > 2, labels[0]).otherwise(F.lit(""))
    shown = events.withColumns({
        "ts_us": micros(F.col("timestamp")), "hour": F.hour("timestamp"), "public_src": ~is_private_ip(F.col("src_ip")), "label": label,
        "wanted": ~B.sanctioned_upload() & ~is_private_ip(F.col("dst_ip"))})
    shown = shown.withColumns({"label_entropy": shannon_entropy(F.col("label")), "label_length": F.length("label")})
    odd = ((F.col("label_entropy") >= B.DNS_ENTROPY) & (F.col("label_length") >= B.DNS_ENTROPY_LENGTH)) | (F.col("label_length") >= B.DNS_LONG_LABEL)
    asked = (F.col("event_type") == "dns_query") & filled(F.col("domain"))

    def row(when: Column, kind: str, name: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.to_json(F.array(F.lit(kind), F.col("tenant_id"), name)).alias("key")))

    targets = F.array_compact(F.array(
        row(B.is_login(), "login", F.lower("user")), row(B.is_start(), "start", F.upper("host")), row(B.has_volume(), "transfer", F.upper("host")),
        row(asked & ~odd & filled(F.col("host")), "lookup", F.upper("host")), row(asked & odd, "odd_label", F.upper("host"))))
    shown = shown.withColumn("odd_label", odd)
    return shown.select("timestamp", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAYLOAD.fields], F.inline(targets))


def stream_baselines(events: DataFrame, delay: str = "10 minutes", idle_seconds: float | None = None,
                     burst: tuple[float, int, float] = (B.BURST_SECONDS, B.BURST_COUNT, B.BURST_QUIET)) -> DataFrame:
    """Detections of all six baselines over a stream of events; for rows inside the watermark they equal the batch result.

    ``idle_seconds`` ends the state of a user, host or process that long after its last row; it then learns anew.
    """
    use_rocksdb(events.sparkSession)
    idle = None if idle_seconds is None else seconds(idle_seconds)
    rows = dealt(events).withWatermark("timestamp", delay)
    first = rows.groupBy("key").transformWithState(KeyBaselines(idle, burst), FOUND, "Append", "EventTime", eventTimeColumnName="timestamp")
    process = F.to_json(F.array(F.lit("process"), F.col("tenant_id"), F.lower("process_name")))
    spread = first.withColumn("key", F.when(F.col("kind") == "first_start", process).otherwise(F.col("key"))).groupBy("key").transformWithState(
        ProcessSpread(idle), FOUND, "Append", "EventTime", eventTimeColumnName="timestamp")
    found = {"login_hour": B.login_hour_found(), "location": B.location_found(), "egress": B.egress_found(), "rare_process": B.rare_process_found(),
             "odd_label": B.odd_label_found(), "burst": B.burst_found(burst[0], burst[1])}
    shape = F.lit(None)
    for kind, columns in found.items():
        shape = F.when(F.col("kind") == kind, columns).otherwise(shape)
    return spread.select(shape.alias("found")).where("found IS NOT NULL").select("found.*")
