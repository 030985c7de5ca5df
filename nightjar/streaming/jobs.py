"""Structured Streaming jobs: the batch operators over streams, with event-time order restored."""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from nightjar.operators import correlate as C
from nightjar.operators import incidents as I
from nightjar.operators import ledger as L
from nightjar.operators.events import with_fingerprint
from nightjar.operators.normalize import normalize, with_violations
from nightjar.operators.ordered import Fold
from nightjar.operators.rules import RuleFold, RuleSpec, detections_from_fires, enabled_rules, keyed_hits, scan_conditions
from nightjar.schema import S, seconds
from nightjar.session import materialize

TOPOLOGY_DAYS = 14
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory: keep it in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_records(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON-lines files as they arrive (columns ``raw``, ``raw_json``, ``seq``). A Kafka source only needs to
    offer its value as ``raw_json``; the checkpoint keeps the offsets in both cases."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path).where(F.trim("value") != "").withColumnRenamed("value", "raw_json")
    return parse_stream(lines)


def parse_stream(lines: DataFrame) -> DataFrame:
    """``seq`` must not depend on the partition: a digest of the record breaks time ties the same way on a rerun."""
    return lines.select("raw_json", F.try_parse_json("raw_json").alias("raw"), F.xxhash64("raw_json").alias("seq"))


def split_records(records: DataFrame, collector: str | None = None, tenant: str = "default") -> tuple[DataFrame, DataFrame]:
    """(canonical events, quarantine) of a batch of parsed lines."""
    good_json = F.col("raw").isNotNull() & F.ltrim("raw_json").startswith("{")
    checked = materialize(with_violations(normalize(records.where(good_json), collector, tenant)))
    events = checked.where(F.size("violations") == 0).drop("violations")
    broken = records.where(~good_json).select("raw_json", F.array(F.lit("not a JSON object")).alias("violations"))
    rejected = checked.where(F.size("violations") > 0).select(F.to_json("raw").alias("raw_json"), "violations")
    return events, broken.unionByName(rejected)


def stream_events(records: DataFrame, events: str, quarantine: str, checkpoint: str, collector: str | None = None, tenant: str = "default", once: bool = False) -> StreamingQuery:
    """Raw stream -> event table and quarantine table. A bad row is set aside and the stream goes on; each batch
    is normalised once for both outputs and owns its folders, so a repeated batch replaces itself."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_records(batch, collector, tenant)
        append_to(events)(good, batch_id)
        append_to(quarantine)(bad, batch_id)

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def stream_dedup(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One event per fingerprint inside the watermark; later rows are dropped and counted by Spark."""
    return with_fingerprint(events).withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["fingerprint"]).drop("fingerprint")


class WaitingRows:
    """Rows ``(ts_us, seq, value)`` of one key until the watermark has passed them, kept in sorted parts.

    A call adds one part, or parts of one hour each when it brings many rows; a list of the parts' spans tells which are due.
    So a call reads and writes state once per part, not per row; one timer a key stands at its earliest waiting row. Rows that
    are due come back in pieces that do not overlap in time, so a busy key is never held as a whole.
    """

    CHUNK, SPAN_MS = 10_000, 3_600_000

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.rows = handle.getMapState("waiting", "part bigint", "rows binary")
        self.plan = handle.getValueState("parts", "parts binary, timer bigint")

    @staticmethod
    def due(row: tuple) -> int:
        return row[0] // 1000 + 1

    @staticmethod
    def order(row: tuple) -> tuple:
        return row[0], row[1] is not None, row[1] or 0

    def _read(self) -> tuple[list, int | None]:
        held = self.plan.get() if self.plan.exists() else None
        return (pickle.loads(bytes(held[0])), held[1]) if held else ([], None)

    def _save(self, parts: list, timer: int | None) -> None:
        if not parts:
            self.plan.clear()
            return
        first = min(p[0] for p in parts)
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.plan.update((pickle.dumps(parts), timer))

    def _store(self, rows: list, number: int) -> tuple[int, int, int]:
        self.rows.updateValue((number,), (pickle.dumps(rows),))
        return self.due(rows[0]), self.due(rows[-1]), number

    def add(self, rows: Iterable[tuple]) -> None:
        parts, timer = self._read()
        number, chunk, busy = max((p[2] for p in parts), default=-1) + 1, [], False
        for row in chain(rows, (None,)):
            if row is not None:
                chunk.append(row)
                if len(chunk) < self.CHUNK:
                    continue
                busy = True
            chunk.sort(key=self.order)
            for _, part in groupby(chunk, lambda r: self.due(r) // self.SPAN_MS if busy else 0):
                parts.append(self._store(list(part), number))
                number += 1
            chunk = []
        self._save(parts, timer)

    def take(self, upto: int) -> Iterator[list]:
        """Rows due at ``upto`` in order, piece by piece; they no longer wait."""
        parts, timer = self._read()
        ready, later = sorted(p for p in parts if p[0] <= upto), [p for p in parts if p[0] > upto]
        at = 0
        while at < len(ready):
            end, start = ready[at][1], at
            while at < len(ready) and ready[at][0] <= end:
                end, at = max(end, ready[at][1]), at + 1
            rows = []
            for _, _, number in ready[start:at]:
                rows += pickle.loads(bytes(self.rows.getValue((number,))[0]))
                self.rows.removeKey((number,))
            rows.sort(key=self.order)
            cut = bisect_right(rows, upto, key=self.due)
            if cut < len(rows):
                later.append(self._store(rows[cut:], ready[start][2]))
            yield rows[:cut]
        if ready:
            self._save(later, None if timer is not None and timer <= upto else timer)


class OrderedFoldProcessor(StatefulProcessor):
    """Runs a fold per key in event-time order.

    Rows wait (:class:`WaitingRows`) until the watermark has passed them and then run, in (time, seq) order, through the same
    fold as the batch job. The fold state is read and written once a call, as one binary value, until nothing in it can matter
    to a later row.
    """

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = WaitingRows(handle)
        self.state = handle.getValueState("state", "value binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802 - Spark API
        def values() -> Iterator[tuple]:
            for row in rows:
                d = row.asDict(recursive=True)
                yield d["ts_us"], d["seq"], [d[c] for c in self.fold.columns]

        self.waiting.add(values())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802 - Spark API
        now, changed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), False
        state, wake = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else (None, None)
        for piece in self.waiting.take(now):
            for _, _, row in piece:
                if state is None:
                    state = self.fold.start(key[0])
                changed = True
                for e in self.fold.step(key[0], state, row):
                    yield Row(**{f.name: self._plain(e[f.name]) for f in self.fold.schema.fields})
        if state is None:
            return
        end = self.fold.horizon(key[0], state)
        if end is not None and end // 1000 + 1 < now:
            self.state.clear()
            return
        if end is not None and (wake is None or wake <= now):
            wake, changed = end // 1000 + 2, True
            if wake <= now:
                wake = now + 1
            self.handle.registerTimer(wake)
        if changed:
            self.state.update((pickle.dumps((state, wake)),))

    @staticmethod
    def _plain(value):
        if isinstance(value, list):
            return [Row(**v) if isinstance(v, dict) else v for v in value]
        return value

    def close(self) -> None:
        pass


def stream_rules(events: DataFrame, rules: list[RuleSpec], delay: str = "10 minutes") -> DataFrame:
    """Detections of a rule pack over a stream; equals the batch result for rows inside the watermark."""
    use_rocksdb(events.sparkSession)
    active = enabled_rules(rules)
    hits = keyed_hits(scan_conditions(events, active), active).withColumn("timestamp", F.timestamp_micros("ts_us")).withWatermark("timestamp", delay)
    fold = RuleFold(active)
    fires = hits.groupBy("fold_key").transformWithState(OrderedFoldProcessor(fold), fold.schema, "Append", "EventTime")
    return detections_from_fires(fires, active)


def run_available(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is there and stop: the final run, and the way to catch up."""
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """Idempotent file sink: every batch owns its folder, so a repeated batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def log_of(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All batches of an append-only table (those before a batch, when repeated), empty if there is none yet."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        rows = spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], full)
    return rows if before is None else rows.where(F.col("batch") < before)


def _latest(log: DataFrame, *keys: str) -> DataFrame:
    """The row of the newest batch per key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")


def current_incidents(spark: SparkSession, incidents: str, schema: T.StructType | None = None, before: int | None = None) -> DataFrame:
    """The incidents that stand: the newest row of each cluster, unless a later batch merged it away."""
    log = spark.read.parquet(incidents) if schema is None else log_of(spark, incidents, schema, before)
    return _latest(log, "tenant_id", "cluster").where(~F.col("retired")).drop("retired", "batch")


CLUSTER_LOG = T.StructType([T.StructField("tenant_id", S), T.StructField("detection_id", S), T.StructField("cluster", S)])


def _touched(fresh: DataFrame, earlier: DataFrame, host_ips: DataFrame | None, window_seconds: float) -> DataFrame:
    """Earlier detections that new ones may link to: by an entity in time, or by hosts that share an address."""
    keys = lambda df: C.strong_keys(df).select("detection_id", "tenant_id", "entity", F.unix_micros("timestamp").alias("ts"))
    new, old = keys(fresh).drop("detection_id").distinct().alias("n"), keys(earlier).alias("o")
    near = F.abs(F.col("n.ts") - F.col("o.ts")) <= seconds(window_seconds)
    found = old.join(new, (F.col("n.tenant_id") == F.col("o.tenant_id")) & (F.col("n.entity") == F.col("o.entity")) & near, "left_semi").select("tenant_id", "detection_id")
    if host_ips is None:
        return found.distinct()
    at_host = lambda df: df.select("detection_id", "tenant_id", F.upper(F.col("entities")["host"]).alias("host"), F.unix_micros("timestamp").alias("ts"))
    reached = host_ips.select("tenant_id", "host", "ip").distinct()
    ends = at_host(fresh).groupBy("tenant_id", "host").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    around = ends.join(reached, ["tenant_id", "host"]).groupBy("tenant_id", "ip").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    beside = reached.join(around, ["tenant_id", "ip"]).groupBy("tenant_id", "host").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("b")
    span, own = seconds(TOPOLOGY_DAYS * 86_400), at_host(earlier).alias("a")
    same = (F.col("a.tenant_id") == F.col("b.tenant_id")) & (F.col("a.host") == F.col("b.host")) & F.col("a.ts").between(F.col("b.lo") - span, F.col("b.hi") + span)
    return found.unionByName(own.join(beside, same, "left_semi").select("tenant_id", "detection_id")).distinct()


def correlate_batch(fresh: DataFrame, batch_id: int, table: str, incidents: str, window_seconds: float = C.WINDOW_SECONDS, host_ips: DataFrame | None = None) -> None:
    """Fold one batch of detections into the incidents.

    Only clusters that the new detections touch are built again, from all their members, however old. Incident ids come
    from the tenant and the earliest detection, so they don't change between batches; ids, status and summary of an incident
    carry over to its successor. Clusters and incidents are append-only tables with a folder per batch, so a repeated
    batch replaces itself.
    """
    spark = fresh.sparkSession
    detection_schema = T.StructType(fresh.schema.fields)
    earlier = log_of(spark, table, detection_schema, batch_id).drop("batch")
    known = _latest(log_of(spark, f"{table}-clusters", CLUSTER_LOG, batch_id), "tenant_id", "detection_id").drop("batch")
    touched = known.join(_touched(fresh, earlier, host_ips, window_seconds), ["tenant_id", "detection_id"], "left_semi").select("tenant_id", "cluster").distinct()
    members = materialize(known.join(touched, ["tenant_id", "cluster"], "left_semi"))
    group = fresh.unionByName(earlier.join(members, ["tenant_id", "detection_id"], "left_semi")).dropDuplicates(["tenant_id", "detection_id"])
    result = materialize(C.correlate(group, host_ips, window_seconds))
    built = I.build_incidents(result, None)
    stable = F.concat(F.lit("SEC-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "tenant_id", "first_key.detection_id"), 256), 1, 12)))
    built = materialize(built.withColumn("incident_id", stable))
    schema = T.StructType([*built.schema.fields, T.StructField("retired", T.BooleanType())])
    old = materialize(current_incidents(spark, incidents, schema, batch_id).join(members.select("tenant_id", "cluster").distinct(), ["tenant_id", "cluster"], "left_semi"))
    if old.limit(1).count():
        old_members = members.join(old.select("tenant_id", "cluster", "incident_id"), ["tenant_id", "cluster"])
        built = I.carry_over_status(built, I.incident_detections(built, result), old, old_members).select(built.columns)
    gone = old.join(built.select("tenant_id", "cluster"), ["tenant_id", "cluster"], "left_anti").withColumn("retired", F.lit(True))
    append_to(incidents)(built.withColumn("retired", F.lit(False)).unionByName(gone.select(*built.columns, "retired")), batch_id)
    append_to(f"{table}-clusters")(result.select("tenant_id", "detection_id", "cluster"), batch_id)


def stream_correlate(detections: DataFrame, table: str, incidents: str, checkpoint: str, seconds: int = 5, window_seconds: float = C.WINDOW_SECONDS,
                     once: bool = False, host_ips: DataFrame | None = None) -> StreamingQuery:
    """Append detections to a table and fold each batch into the incidents; :func:`current_incidents` reads what stands.

    ``host_ips`` (tenant, host, address) adds the links along shared addresses.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        append_to(table)(batch, batch_id)
        fresh = batch.sparkSession.read.schema(batch.schema).parquet(f"{table}/batch={batch_id}")
        if fresh.limit(1).count():
            correlate_batch(fresh, batch_id, table, incidents, window_seconds, host_ips)

    writer = detections.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


BALANCE_LOG = T.StructType([
    T.StructField("tenant_id", S), T.StructField("entity", S), T.StructField("balance", T.DoubleType()), T.StructField("deposits", T.LongType()),
    T.StructField("updated_us", T.LongType()), T.StructField("at_us", T.LongType())])
REMEMBER_DAYS = 60
DAY_US = 86_400_000_000


class LedgerProcessor(StatefulProcessor):
    """Balance of one entity, decayed only when it is touched, and the detections that it has counted, by their day.

    A batch reads and writes the state of the entities and days that it touches, and nothing else. Days older than
    ``remember_days`` before the newest detection of the entity are forgotten; a detection older than that is not counted
    (by then next to nothing of it is left). Time is that of the detections, so a replay gives the same balances.
    """

    def __init__(self, half_life_hours: float, remember_days: int):
        self.unit, self.remember_days = half_life_hours * 3_600_000_000.0, remember_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "balance double, deposits bigint, updated_us bigint, at_us bigint, first_day bigint")
        self.counted = handle.getMapState("counted", "day bigint", "ids binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802 - Spark API
        balance, deposits, updated, at, first_day = self.balance.get() if self.balance.exists() else (0.0, 0, 0, None, None)
        before, days = deposits, {}
        for row in rows:
            day = row["ts_us"] // DAY_US
            if at is not None and day < at // DAY_US - self.remember_days:
                continue
            if day not in days:
                days[day] = pickle.loads(bytes(self.counted.getValue((day,))[0])) if self.counted.containsKey((day,)) else set()
            if row["detection_id"] in days[day]:
                continue
            days[day].add(row["detection_id"])
            now = row["ts_us"] if at is None else max(at, row["ts_us"])
            balance = balance * 0.5 ** ((now - (now if at is None else at)) / self.unit) + row["amount"] * 0.5 ** ((now - row["ts_us"]) / self.unit)
            at, deposits, updated, first_day = now, deposits + 1, max(updated, row["ts_us"]), day if first_day is None else min(first_day, day)
        if deposits > before:
            for day, ids in days.items():
                self.counted.updateValue((day,), (pickle.dumps(ids),))
            while first_day < at // DAY_US - self.remember_days:
                self.counted.removeKey((first_day,))
                first_day += 1
            self.balance.update((balance, deposits, updated, at, first_day))
            yield Row(tenant_id=key[0], entity=key[1], balance=balance, deposits=deposits, updated_us=updated, at_us=at)

    def close(self) -> None:
        pass


def ledger_rows(detections: DataFrame, half_life_hours: float = L.HALF_LIFE_HOURS, remember_days: int = REMEMBER_DAYS) -> DataFrame:
    """The new balance of every entity that a batch of detections touches; a detection counts once, whichever batch it came in."""
    use_rocksdb(detections.sparkSession)
    keys = F.explode(C.entity_keys(F.col("entities"))).alias("entity")
    rows = detections.select("tenant_id", "detection_id", F.unix_micros("timestamp").alias("ts_us"), L.deposit_amount().alias("amount"), keys)
    rows = rows.where(F.col("entity").startswith("user:") | F.col("entity").startswith("host:"))
    return rows.groupBy("tenant_id", "entity").transformWithState(LedgerProcessor(half_life_hours, remember_days), BALANCE_LOG, "Update", "None")


def current_balances(spark: SparkSession, balances: str, half_life_hours: float = L.HALF_LIFE_HOURS) -> DataFrame:
    """The newest balance of each entity, decayed to the newest deposit of all."""
    rows = _latest(log_of(spark, balances, BALANCE_LOG), "tenant_id", "entity").drop("batch")
    now = rows.agg(F.max("at_us")).first()[0] or 0
    balance = F.col("balance") * L.decay(F.lit(now) - F.col("at_us"), half_life_hours)
    return rows.select("tenant_id", "entity", balance.alias("balance"), "deposits", F.timestamp_micros("updated_us").alias("updated"), F.lit(now).alias("at_us"))


def stream_ledger(detections: DataFrame, balances: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep balances as detections arrive; each batch appends the balances it changed, :func:`current_balances` reads what stands."""
    writer = ledger_rows(detections).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(append_to(balances))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def event_rates(events: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Tumbling event counts per source, closed by the watermark."""
    return events.withWatermark("timestamp", delay).groupBy(F.window("timestamp", window), "tenant_id", "source").agg(F.count(F.lit(1)).alias("n"))


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over all progress reports of a query."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
