"""Queries for sources and sinks: given tables are written in each format into the shared folder, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightjar.plans.adapter import telemetry
from nightjar.plans.queries_intel import sample_iocs
from nightjar.plans.registry import register
from nightjar.session import ensure_checkpoint_dir
from nightjar.sources import feeds, raw


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as compressed JSON lines, some of them broken; every line comes back as a record or in quarantine."""
    folder = _folder(spark, "raw")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.when(F.col("event_id") % 50 == 7, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type", "user_id")))
    events.select(line.alias("value")).write.option("compression", "gzip").text(folder)
    good, bad = raw.read_raw_jsonl(spark, folder)
    get = lambda name, kind: F.try_variant_get("raw", f"$.{name}", kind).alias(name)
    return good.select(F.lit("record").alias("kind"), get("event_id", "bigint"), get("event_type", "string"), get("user_id", "bigint")).unionByName(
        bad.select(F.lit("quarantine").alias("kind"), F.substring_index("raw_json", " ", -1).cast("bigint").alias("event_id"), F.lit("").alias("event_type"), F.lit(-1).cast("bigint").alias("user_id")))


register("read_raw_jsonl", raw_lines, """
SELECT CASE WHEN event_id % 50 = 7 THEN 'quarantine' ELSE 'record' END AS kind, event_id, CASE WHEN event_id % 50 <> 7 THEN event_type ELSE '' END AS event_type, CASE WHEN event_id % 50 <> 7 THEN user_id ELSE -1 END AS user_id FROM events""")


def c2_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "c2")
    seen = telemetry(spark, sf_dir).where(F.col("dst_ip") != "").select("dst_ip").distinct()
    seen.select(F.lit("2024-01-01 00:00:00"), "dst_ip", F.lit("443"), F.lit("online"), F.lit("2024-02-01"), F.concat(F.lit("family"), (F.length("dst_ip") % 5).cast("string"))).write.option("quoteAll", True).csv(folder)
    return feeds.read_feodo(spark, folder).select("value", "type", "threat", "confidence", "severity", "first_seen")


register("read_feodo", c2_list, """
SELECT DISTINCT dst_ip AS value, 'ip' AS type, 'family' || CAST(length(dst_ip) % 5 AS VARCHAR) || ' C2' AS threat, 0.9 AS confidence, 'critical' AS severity, '2024-01-01 00:00:00' AS first_seen FROM ev WHERE dst_ip <> ''""", "ev")


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "urls")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.select("page_id", F.lit("2024-01-01"), "url", F.lit("online"), F.lit(""), F.lit("malware_download"), F.lit("exe,zip"), F.lit("link"), F.lit("rep")).write.option("quoteAll", True).csv(folder)
    return feeds.read_urlhaus(spark, folder).select("type", "value", "confidence", F.array_join("tags", ",").alias("tags"))


register("read_urlhaus", url_list, """
SELECT 'url' AS type, url AS value, 0.85 AS confidence, 'exe,zip' AS tags FROM pages
UNION ALL SELECT 'domain', split_part(split_part(url, '//', 2), '/', 1), 0.7, '' FROM pages WHERE split_part(split_part(url, '//', 2), '/', 1) <> ''""")


def mixed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON list per file, as many files as keep a list small."""
    folder = _folder(spark, "mixed")
    seen = telemetry(spark, sf_dir).where(F.col("dst_ip") != "").groupBy("dst_ip").agg(F.min("dst_port").alias("port"))
    entry = F.struct(F.lit("ip:port").alias("ioc_type"), F.concat_ws(":", "dst_ip", F.coalesce("port", F.lit(0)).cast("string")).alias("ioc_value"), F.lit("M").alias("malware_printable"), F.lit(50.0).alias("confidence_level"))
    files = seen.groupBy(F.pmod(F.xxhash64("dst_ip"), F.lit(64)).alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    files.write.partitionBy("part").text(folder)
    return feeds.read_threatfox(spark, folder).select("value", "type", "threat", "confidence")


register("read_threatfox", mixed_export, "SELECT DISTINCT dst_ip AS value, 'ip' AS type, 'M' AS threat, 0.5 AS confidence FROM ev WHERE dst_ip <> ''", "ev")


def drop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "drop")
    blocks = telemetry(spark, sf_dir).where(F.contains("dst_ip", F.lit("."))).select(F.concat(F.substring_index("dst_ip", ".", 3), F.lit(".0/24")).alias("block")).distinct()
    lines = blocks.select(F.explode(F.array(F.concat(F.lit("; about "), "block"), F.concat("block", F.lit(" ; REF"), F.length("block").cast("string")))).alias("value"))
    lines.write.text(folder)
    return feeds.read_cidr_droplist(spark, folder).select("value", "type", "reference")


register("read_cidr_droplist", drop_list, """
SELECT DISTINCT b AS value, 'cidr' AS type, 'REF' || CAST(length(b) AS VARCHAR) AS reference FROM (SELECT regexp_extract(dst_ip, '^(.*)\\.[^.]*$', 1) || '.0/24' AS b FROM ev WHERE contains(dst_ip, '.'))""", "ev")


def own_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our own export, read back by the reader of local feeds."""
    folder = _folder(spark, "own")
    feeds.write_iocs(sample_iocs(spark, sf_dir), folder)
    lines = spark.read.text(f"{folder}/json")
    lists = lines.groupBy(F.pmod(F.xxhash64("value"), F.lit(64)).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    lists.write.partitionBy("part").text(f"{folder}/lists")
    return feeds.read_local_iocs(spark, f"{folder}/lists").select("value", "type", "threat", "source", "confidence", "country")


register("read_local_iocs", own_feed, """
SELECT value, type, threat, source, confidence, country FROM ioc QUALIFY row_number() OVER (PARTITION BY type, CASE WHEN type = 'cidr' THEN value || CAST(load_seq AS VARCHAR) WHEN type = 'domain' THEN rtrim(lower(trim(value)), '.') ELSE lower(trim(value)) END ORDER BY load_seq DESC) = 1""", "ioc")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "report")
    raw.write_report(spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")), folder)
    return spark.read.schema("event_type string, n long, last long").json(folder)


register("write_report", report, "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
