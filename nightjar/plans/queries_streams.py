"""Queries that replay the given tables as streams: file batches in arrival order, until nothing is left.

Each returns what the batch operator returns over the whole table, so the batch checks hold. The last files of a replay
carry rows of a tenant of their own, far in the future: they move the watermark past all others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightjar.operators.events import fingerprint
from nightjar.plans.adapter import sample_detections, telemetry
from nightjar.plans.queries_detect import BRUTE_FORCE, DAY, DISTINCT_RULE, MATCH_RULE, SEQUENCE_RULE, THRESHOLD_RULE, _flat
from nightjar.plans.queries_events import FINGERPRINT_SQL
from nightjar.plans.queries_ingest import vendor_records
from nightjar.plans.registry import CHECKS, register
from nightjar.schema import seconds
from nightjar.session import ensure_checkpoint_dir
from nightjar.streaming import jobs as J
from nightjar.streaming.baselines import stream_baselines

CLOSING = "~closing"
CUTS = ("2024-01-11", "2024-01-21")  # arrival batches of a replay, by event time


def folder(spark: SparkSession, purpose: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/replay-{purpose}-{uuid.uuid4().hex}"


def arrival_batch() -> Column:
    """Number of the batch in which an event arrives when nothing is late."""
    return sum((F.when(F.col("timestamp") >= F.lit(c).cast("timestamp"), 1).otherwise(0) for c in CUTS), F.lit(0))


ROWS_PER_FILE = 200_000


def closing_rows(events: DataFrame, days: int, files: int = 1) -> DataFrame:
    """Two rows per file of the closing tenant: a failed login and a look-up, each on a host, for every kind of operator."""
    blank = {c: F.lit(None).cast(events.schema[c].dataType) for c in events.columns}
    rows = events.sparkSession.range(0, 2 * files, 1, files).select(*[v.alias(c) for c, v in blank.items()], "id")
    is_login = F.col("id") % 2 == 0
    return rows.withColumns({
        "event_id": F.concat(F.lit(f"closing-{days}-"), F.col("id")), "tenant_id": F.lit(CLOSING), "seq": -1 - F.col("id"), "host": F.lit("h"), "user": F.lit("u"), "domain": F.lit("a.b"),
        "timestamp": F.lit("2024-03-01").cast("timestamp") + F.make_interval(days=F.lit(days)), "event_type": F.when(is_login, "authentication").otherwise("dns_query"),
        "action": F.when(is_login, "login_failure").otherwise("query")}).drop("id")


def replayed(events: DataFrame, batch: Column, batches: int) -> DataFrame:
    """A stream of ``events``, one batch per trigger, then the closing rows.

    Every batch is the same number of files, more for a larger table, so no task writes or reads a batch alone; a batch with
    fewer rows than files is filled up with empty files.
    """
    spark, path = events.sparkSession, folder(events.sparkSession, "in")
    files = -(-events.count() // (ROWS_PER_FILE * batches)) or 1
    empty = events.limit(0)
    for n in range(batches):
        own = events.where(batch == n)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)
        for _ in range(files * (n + 1) - len(spark.read.schema(events.schema).parquet(path).inputFiles()) if files > 1 else 0):
            empty.coalesce(1).write.mode("append").parquet(path)
    for days in (400, 800, 1200):
        closing_rows(events, days, files).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def outcome(stream: DataFrame) -> DataFrame:
    """What a stream has written when all there is has been processed."""
    spark, out = stream.sparkSession, folder(stream.sparkSession, "out")
    query = J.run_available(stream, folder(spark, "checkpoint"), J.append_to(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def over_stream(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return outcome(operator(replayed(telemetry(spark, sf_dir), arrival_batch(), 3))).where(F.col("tenant_id") != CLOSING)
    return run


# ------------------------------------------------------------------------------------------ detections
_BASELINES = ["anomaly_login_hour", "anomaly_first_seen_location", "anomaly_egress_volume", "anomaly_rare_process", "anomaly_dns_entropy", "anomaly_dns_burst"]
_COLUMNS = "event_id, rule_id, score, severity, confidence, phase"


def baselines_over_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six baselines over the events as they arrive; they equal the batch operators."""
    found = over_stream(lambda s: stream_baselines(s, "1 second", burst=(2 * DAY, 5, DAY)))(spark, sf_dir)
    return found.select(F.element_at("evidence_event_ids", 1).alias("event_id"), "rule_id", "score", "severity", "confidence", "phase")


register("stream_baselines", baselines_over_stream, "\nUNION ALL ".join(f"SELECT {_COLUMNS} FROM ({CHECKS[name]})" for name in _BASELINES))

_RULES = {"match_rule": MATCH_RULE, "threshold_rule": THRESHOLD_RULE, "threshold_distinct": DISTINCT_RULE, "threshold_then": BRUTE_FORCE, "sequence_rule": SEQUENCE_RULE}
register("stream_rules", lambda s, d: _flat(over_stream(lambda e: J.stream_rules(e, list(_RULES.values()), "1 second"))(s, d)),
         "\nUNION ALL ".join(f"SELECT * FROM ({CHECKS[name]})" for name in _RULES))


# ------------------------------------------------------------------------------------------ events
def deduplicated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event arrives again, with another id, in the same file; one of each is kept."""
    again = telemetry(spark, sf_dir)
    again = again.unionByName(again.where(F.col("seq") % 3 == 0).withColumn("event_id", F.concat(F.col("event_id"), F.lit("x"))))
    kept = outcome(J.stream_dedup(replayed(again, arrival_batch(), 3), "1 second")).where(F.col("tenant_id") != CLOSING)
    return kept.groupBy(fingerprint().alias("fingerprint")).agg(F.count(F.lit(1)).alias("kept"))


register("stream_dedup", deduplicated_stream, f"SELECT DISTINCT {FINGERPRINT_SQL} AS fingerprint, CAST(1 AS BIGINT) AS kept FROM ev", "ev")


def routed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor records as JSON lines, a tenth of the lines cut short: rows of the event table and of the quarantine."""
    lines = vendor_records(spark, sf_dir).select("seq", F.to_json("raw").alias("line"))
    path, good, bad = folder(spark, "lines"), folder(spark, "events"), folder(spark, "quarantine")
    short = F.when(F.col("seq") % 10 == 3, F.concat(F.lit("cut "), F.col("line"))).otherwise(F.col("line"))
    for n in range(2):
        lines.where(F.col("seq") % 2 == n).select(short).coalesce(1).write.mode("append").text(path)
    J.stream_events(J.stream_records(spark, path, 1), good, bad, folder(spark, "checkpoint"), once=True).awaitTermination()
    kept = spark.read.parquet(good).groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("n"))
    set_aside = spark.read.parquet(bad).groupBy(F.array_join("violations", "; ").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(set_aside.select(F.lit("quarantine").alias("source"), "event_type", "n"))


register("stream_events", routed_stream, """
WITH told AS (SELECT *, seq % 10 = 3 AS short FROM vendor)
SELECT source, event_type, count(*) AS n FROM told WHERE NOT short AND k <> 50 AND source <> 'nowhere' GROUP BY ALL
UNION ALL SELECT 'quarantine', concat_ws('; ', CASE WHEN short THEN 'not a JSON object' END, CASE WHEN NOT short AND k = 50 THEN 'timestamp missing or unreadable' END,
  CASE WHEN NOT short AND source = 'nowhere' THEN 'unknown source' END) AS why, count(*) FROM told WHERE short OR k = 50 OR source = 'nowhere' GROUP BY why""", "vendor")

register("stream_windows", lambda s, d: over_stream(lambda e: J.event_rates(e, "1 second", "1 hour"))(s, d).select("tenant_id", "source", F.unix_micros("window.start").alias("start_us"), "n"),
         "SELECT tenant_id, source, ts_us // 3600000000 * 3600000000 AS start_us, count(*) AS n FROM ev GROUP BY ALL", "ev")


LATE_DAYS = 2


def late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event arrives two batches late: it counts only if its window had not ended at the watermark of the batch before."""
    ev = telemetry(spark, sf_dir)
    batch = arrival_batch() + F.when(F.col("seq") % 10 == 0, 2).otherwise(0)
    rates = outcome(J.event_rates(replayed(ev, batch, len(CUTS) + 3), f"{LATE_DAYS} days", "1 hour")).where(F.col("tenant_id") != CLOSING)
    return rates.select("tenant_id", "source", F.unix_micros("window.start").alias("start_us"), "n")


_ARRIVAL = " + ".join(f"CASE WHEN ts_us >= epoch_us(TIMESTAMP '{c}') THEN 1 ELSE 0 END" for c in CUTS)
register("stream_late_rows", late_stream, f"""
WITH told AS (SELECT *, {_ARRIVAL} + CASE WHEN seq % 10 = 0 THEN 2 ELSE 0 END AS batch, ts_us // 3600000000 * 3600000000 AS start_us FROM ev),
marks AS (SELECT b.batch, (SELECT max(ts_us) // 1000 * 1000 FROM told t WHERE t.batch < b.batch - 1) - {seconds(LATE_DAYS * DAY)} AS mark FROM (SELECT DISTINCT batch FROM told) b)
SELECT tenant_id, source, start_us, count(*) AS n FROM told JOIN marks USING (batch) WHERE mark IS NULL OR start_us + 3600000000 > mark GROUP BY ALL""", "ev")


def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in three arrival batches, every fifth delivered twice, through the keyed balances."""
    dets, path, balances = sample_detections(spark, sf_dir), folder(spark, "detections"), folder(spark, "balances")
    for n in range(3):
        own = dets.where(arrival_batch() == n)
        again = dets.where((arrival_batch() == n - 1) & (F.crc32(F.col("detection_id")) % 5 == 0))
        own.unionByName(again).coalesce(1).write.mode("append").parquet(path)
    J.stream_ledger(spark.readStream.schema(dets.schema).option("maxFilesPerTrigger", 1).parquet(path), balances, folder(spark, "checkpoint"), once=True).awaitTermination()
    return J.current_balances(spark, balances).select("tenant_id", "entity", F.round("balance", 6).alias("balance"), "deposits")


register("stream_ledger", ledger_stream, CHECKS["ledger_balance"])
