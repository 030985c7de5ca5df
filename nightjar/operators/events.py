"""Identity, order and rendering of canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nightjar.schema import filled, micros

# Fixed value: the fields that identify a record, in digest order.
FINGERPRINT_FIELDS = [
    "tenant_id", "timestamp", "source", "event_type", "action", "host", "user", "process_name", "command_line",
    "dst_ip", "domain", "file_path",
]


def iso_time(column: Column) -> Column:
    """ISO-8601 text in UTC; fractional seconds only when there are some."""
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.pmod(micros(column), F.lit(1_000_000))
    return F.concat(whole, F.when(fraction != 0, F.format_string(".%06d", fraction)).otherwise(""), F.lit("+00:00"))


def fingerprint(extra: list[str] | None = None) -> Column:
    """24 hex digits of SHA-256 over the identifying fields; ``extra`` fields make the key wider."""
    parts = [iso_time(F.col(f)) if f == "timestamp" else F.coalesce(F.col(f).cast("string"), F.lit("None"))
             for f in FINGERPRINT_FIELDS + (extra or [])]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def with_fingerprint(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(extra))


def deduplicate(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """First arrival per fingerprint. Partial aggregation keeps a mass of copies off any single task."""
    tagged = with_fingerprint(df, extra)
    names = df.columns
    return (
        tagged.groupBy("fingerprint")
        .agg(F.min_by(F.struct(*names), F.struct("timestamp", "seq")).alias("row"))
        .select("row.*")
    )


def count_duplicates(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    per_key = with_fingerprint(df, extra).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"))


def event_entity_keys() -> Column:
    """Entities an event touches: user, host, session and any address outside three private prefixes."""
    ip = F.col("dst_ip")
    outside = filled(ip) & ~(ip.startswith("10.") | ip.startswith("192.168.") | ip.startswith("172.16."))
    return F.array_compact(F.array(
        F.when(filled(F.col("user")), F.concat(F.lit("user:"), F.lower("user"))),
        F.when(filled(F.col("host")), F.concat(F.lit("host:"), F.upper("host"))),
        F.when(filled(F.col("session_id")), F.concat(F.lit("session:"), F.col("session_id"))),
        F.when(outside, F.concat(F.lit("ip:"), ip)),
    ))


def event_summary() -> Column:
    """One-line rendering; missing parts are left out."""
    def part(name: str, label: str) -> Column:
        return F.when(filled(F.col(name)), F.concat(F.lit(label + "="), F.col(name)))

    port = F.when(F.coalesce(F.col("dst_port"), F.lit(0)) != 0, F.col("dst_port").cast("string")).otherwise("")
    return F.concat_ws(
        " ", F.date_format("timestamp", "HH:mm:ss"), F.col("event_type"), F.col("action"), part("user", "user"),
        part("host", "host"), part("process_name", "proc"),
        F.when(filled(F.col("dst_ip")), F.concat(F.lit("dst="), F.col("dst_ip"), F.lit(":"), port)),
        part("domain", "domain"), part("file_path", "file"),
        F.when(F.coalesce(F.col("bytes_out"), F.lit(0)) != 0, F.concat(F.lit("out="), F.col("bytes_out").cast("string"), F.lit("B"))),
    )


def order_events(df: DataFrame) -> DataFrame:
    """Total time order; arrival (``seq``) breaks ties."""
    return df.orderBy("timestamp", "seq")


