"""Public threat-feed files -> indicator rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from nightjar.functions.text import url_host
from nightjar.operators.intel import current_iocs, with_load_order
from nightjar.schema import IOC_SCHEMA, filled

# --- fixed values: per-feed defaults ------------------------------------------------------------
C2_CONFIDENCE, C2_SEVERITY, C2_TAGS = 0.9, "critical", ["c2", "botnet"]
URL_CONFIDENCE, URL_HOST_CONFIDENCE, URL_SEVERITY, URL_THREAT = 0.85, 0.7, "high", "malware_download"
MIXED_LEVEL, MIXED_SEVERITY, MIXED_THREAT = 75, "high", "malware"
BLOCK_CONFIDENCE, BLOCK_SEVERITY, BLOCK_TAGS = 0.8, "high", ["drop"]
LOCAL_CONFIDENCE, LOCAL_SEVERITY, LOCAL_THREAT = 0.8, "high", "malicious"
C2_COLUMNS = ["first_seen_utc", "dst_ip", "dst_port", "c2_status", "last_online", "malware"]
URL_COLUMNS = ["id", "dateadded", "url", "url_status", "last_online", "threat", "tags", "urlhaus_link", "reporter"]
# ------------------------------------------------------------------------------------------------


def _null() -> Column:
    return F.lit(None).cast("string")


def _tags(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _ioc(value: Column, kind: Column | str, threat: Column | str, source: Column | str, confidence: Column | float, severity: Column | str,
         first_seen: Column | None = None, tags: Column | None = None, reference: Column | None = None, country: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        value.alias("value"), lit(kind).alias("type"), lit(threat).alias("threat"), lit(source).alias("source"), lit(confidence).cast("double").alias("confidence"),
        lit(severity).alias("severity"), (first_seen if first_seen is not None else _null()).alias("first_seen"), (tags if tags is not None else _tags([])).alias("tags"),
        (reference if reference is not None else _null()).alias("reference"), (country if country is not None else _null()).alias("country"))


def _csv(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(paths, schema=schema, comment="#", mode="PERMISSIVE", multiLine=False, escape='"', nullValue="\u0001", emptyValue="")
    return rows.where(F.col(columns[0]).isNotNull() & (F.col(columns[0]) != columns[0]))


def read_feodo(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Control-server address list (CSV with comment lines); the malware name comes from its own column."""
    rows = _csv(spark, paths, C2_COLUMNS).where(F.col("dst_port").isNotNull())
    malware = F.coalesce(F.nullif(F.col("malware"), F.lit("")), F.lit("botnet C2"))
    return rows.select(_ioc(F.col("dst_ip"), "ip", F.concat(malware, F.lit(" C2")), "C2 address list", C2_CONFIDENCE, C2_SEVERITY, F.col("first_seen_utc"), _tags(C2_TAGS)).alias("i")).select("i.*")


def read_urlhaus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Malware-URL list: one URL indicator and, for named hosts, one domain indicator per row."""
    rows = _csv(spark, paths, URL_COLUMNS).where(F.col("tags").isNotNull())
    threat = F.coalesce(F.nullif(F.col("threat"), F.lit("")), F.lit(URL_THREAT))
    host = F.split(url_host(F.col("url")), ":")[0]
    tags = F.filter(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: t != "")
    items = F.array_compact(F.array(
        _ioc(F.col("url"), "url", threat, "Malware URL list", URL_CONFIDENCE, URL_SEVERITY, F.col("dateadded"), tags),
        F.when(filled(host) & ~F.coalesce(host.rlike(r"^[0-9.]+$"), F.lit(False)), _ioc(host, "domain", threat, "Malware URL list", URL_HOST_CONFIDENCE, URL_SEVERITY, F.col("dateadded")))))
    return rows.select(F.inline(items))


_MIXED_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("ioc_type", "ioc_value", "ioc", "malware_printable", "threat_type", "first_seen_utc", "reference")]
                            + [T.StructField("confidence_level", T.DoubleType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def read_threatfox(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Mixed JSON export: a map of lists, a map of entries, or a list."""
    whole = spark.read.text(paths, wholetext=True).select("value")
    lists = F.coalesce(
        F.flatten(F.map_values(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(_MIXED_ENTRY))))),
        F.from_json("value", T.ArrayType(_MIXED_ENTRY)), F.map_values(F.from_json("value", T.MapType(T.StringType(), _MIXED_ENTRY))))
    rows = whole.select(F.explode(lists).alias("e")).select("e.*")
    kind = F.coalesce("ioc_type", F.lit(""))
    mapped = F.when(kind.startswith("ip"), "ip").when(kind == "domain", "domain").when(kind == "url", "url").when(kind.contains("hash"), "hash")
    raw_value = F.coalesce(F.nullif(F.col("ioc_value"), F.lit("")), F.col("ioc"))
    value = F.when(kind.startswith("ip"), F.split(raw_value, ":")[0]).otherwise(raw_value)
    threat = F.coalesce(F.nullif(F.col("malware_printable"), F.lit("")), F.col("threat_type"), F.lit(MIXED_THREAT))
    level = F.coalesce("confidence_level", F.lit(float(MIXED_LEVEL))) / 100.0
    entry = _ioc(value, mapped, threat, "Mixed indicator export", level, MIXED_SEVERITY, F.col("first_seen_utc"), F.coalesce("tags", _tags([])), F.col("reference"))
    return rows.select(entry.alias("i")).select("i.*").where(F.col("type").isNotNull() & filled(F.col("value")))


def read_cidr_droplist(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Netblock list with ``;`` comments."""
    line = F.trim("value")
    rows = spark.read.text(paths).where((line != "") & ~line.startswith(";"))
    parts = F.split(line, ";")
    reference = F.nullif(F.trim(F.try_element_at(parts, F.lit(2))), F.lit(""))
    return rows.select(_ioc(F.trim(parts[0]), "cidr", "Hijacked netblock", "Netblock drop list", BLOCK_CONFIDENCE, BLOCK_SEVERITY, None, _tags(BLOCK_TAGS), reference).alias("i")).select("i.*")


def read_local_iocs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Indicators in our own JSON shape; unknown types are left out."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1)
    rows = spark.read.schema(IOC_SCHEMA).json(paths, multiLine=True).withColumn("stem", stem)
    c = F.col
    return rows.where(c("value").isNotNull() & c("type").isin("ip", "domain", "url", "hash", "cidr")).select(_ioc(
        c("value"), c("type"), F.coalesce("threat", F.lit(LOCAL_THREAT)), F.coalesce("source", "stem"), F.coalesce("confidence", F.lit(LOCAL_CONFIDENCE)),
        F.coalesce("severity", F.lit(LOCAL_SEVERITY)), c("first_seen"), F.coalesce("tags", _tags([])), c("reference"), c("country")).alias("i")).select("i.*")


# File-name prefix -> reader.
READERS = [("feodo", read_feodo), ("urlhaus", read_urlhaus), ("threatfox", read_threatfox), ("spamhaus", read_cidr_droplist)]
FEED_ENDINGS = (".csv", ".json", ".txt")


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Feed files of a folder in name order (names only; listed by Spark's own file index)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    return sorted(r["path"] for r in listed.collect() if r["path"].lower().endswith(FEED_ENDINGS))


def load_iocs(spark: SparkSession, folder: str) -> DataFrame:
    """All feeds of a folder in name order, with ``load_seq``. A file that does not parse yields nothing."""
    parts = []
    for i, path in enumerate(_files(spark, folder)):
        name = path.rsplit("/", 1)[-1].lower()
        reader = next((r for prefix, r in READERS if name.startswith(prefix)), read_local_iocs if name.endswith(".json") else None)
        if reader is not None:
            parts.append(reader(spark, path).withColumn("file_order", F.lit(i)).withColumn("line_order", F.monotonically_increasing_id()))
    if not parts:
        return spark.createDataFrame([], IOC_SCHEMA).withColumn("load_seq", F.lit(0).cast("long"))
    return with_load_order(reduce(DataFrame.unionByName, parts), ["file_order", "line_order"]).drop("file_order", "line_order")


def write_iocs(iocs: DataFrame, folder: str) -> None:
    """Export the current indicators, netblocks included, as JSON and CSV."""
    current = current_iocs(iocs).drop("ioc_key", "load_seq")
    current.write.mode("overwrite").json(f"{folder}/json")
    current.select("value", "type", "threat", "source", "confidence", "severity").write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
