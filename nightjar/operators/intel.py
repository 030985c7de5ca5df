"""Threat-intelligence look-ups as equi-joins on derived keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nightjar.functions.net import ipv4_to_long, ipv6_to_hex, is_ipv4
from nightjar.functions.text import url_host
from nightjar.operators.ordered import cooldown, with_row_index
from nightjar.schema import digest_id, filled, micros, seconds
from nightjar.session import materialize

# --- fixed values -------------------------------------------------------------------------------
BASE_SCORE = {"low": 20.0, "medium": 35.0, "high": 55.0, "critical": 75.0}
TYPE_PHASE = {"ip": "command_and_control", "cidr": "command_and_control", "domain": "command_and_control",
              "url": "initial_access", "hash": "execution"}
TYPE_TECHNIQUES = {"ip": ["T1071.001"], "cidr": ["T1071.001"], "domain": ["T1071.001", "T1568"],
                   "url": ["T1105", "T1566.002"], "hash": ["T1204.002"]}
REPEAT_SECONDS = 900
BROADCAST_ROWS = 50_000  # up to so many indicators (a few hundred bytes each) are shipped to every executor
# ------------------------------------------------------------------------------------------------

IOC_COLUMNS = ["value", "type", "threat", "source", "confidence", "severity", "first_seen", "tags", "reference", "country", "load_seq"]


def indicator_key() -> Column:
    """Normalised value of an indicator by type."""
    text = F.lower(F.trim("value"))
    return F.when(F.col("type") == "domain", F.rtrim(text, F.lit("."))).otherwise(text)


def current_iocs(iocs: DataFrame) -> DataFrame:
    """Later loads replace earlier ones with the same (type, key); netblocks are all kept."""
    keyed = iocs.withColumn("ioc_key", indicator_key())
    last = (
        keyed.where(F.col("type") != "cidr").groupBy("type", "ioc_key")
        .agg(F.max_by(F.struct(*IOC_COLUMNS), F.col("load_seq")).alias("row")).select("row.*", "ioc_key")
    )
    return last.unionByName(keyed.where(F.col("type") == "cidr").select(*IOC_COLUMNS, "ioc_key"))


def _mask(value: Column, length: Column) -> Column:
    """Network part of an address, by arithmetic on the unsigned value."""
    size = F.pow(F.lit(2.0), 32 - length).cast("bigint")
    return value - F.pmod(value, size)


def _v6_key(digits: Column, length: Column) -> Column:
    """The first ``length`` bits of 32 hexadecimal digits, as whole digits and the rest of one."""
    whole = F.floor(length / 4).cast("int")
    digit = F.conv(F.substr(F.concat(digits, F.lit("0")), whole + 1, F.lit(1)), 16, 10).cast("int")
    rest = F.floor(digit / F.pow(F.lit(2.0), 4 - length % 4)).cast("string")
    return F.concat(F.lit("v6:"), F.substr(digits, F.lit(1), whole), F.lit("+"), F.when(length % 4 == 0, "").otherwise(rest), F.lit("/"), length.cast("string"))


def _netblocks(iocs: DataFrame) -> DataFrame:
    """Netblocks of both address families; ``bits`` is 32 or 128. Entries that are no netblock are left out."""
    parts = F.split("ioc_key", "/")
    address, digits = parts[0], ipv6_to_hex(parts[0])
    bits = F.when(is_ipv4(address), 32).when(digits.isNotNull(), 128)
    length = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), bits)
    v4 = F.concat_ws("/", _mask(ipv4_to_long(address), F.col("prefix")).cast("string"), F.col("prefix").cast("string"))
    return (
        iocs.where(F.col("type") == "cidr").withColumn("bits", bits).withColumn("prefix", length)
        .where(F.col("bits").isNotNull() & F.col("prefix").between(0, F.col("bits")))
        .withColumn("look_key", F.when(F.col("bits") == 32, v4).otherwise(_v6_key(digits, F.col("prefix"))))
    )


def build_index(iocs: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Look-up rows ``(look_kind, look_key) -> indicator`` and the (address bits, prefix length) in use (162 at most).

    An index of at most ``BROADCAST_ROWS`` rows, by count, is shipped to every executor, so that the candidates of all events
    are neither shuffled nor dealt to one reducer per hot value; a larger one is left to Spark, with skew splitting.
    """
    current = materialize(current_iocs(iocs))
    blocks = _netblocks(current)
    lengths = sorted((r["bits"], r["prefix"]) for r in blocks.select("bits", "prefix").distinct().collect())
    first_block = (
        blocks.groupBy("look_key").agg(F.min_by(F.struct(*IOC_COLUMNS), F.col("load_seq")).alias("ioc"))
        .select(F.lit("cidr").alias("look_kind"), "look_key", "ioc")
    )
    exact = current.where(F.col("type") != "cidr").select(F.col("type").alias("look_kind"), F.col("ioc_key").alias("look_key"), F.struct(*IOC_COLUMNS).alias("ioc"))
    index = exact.unionByName(first_block)
    return (F.broadcast(index) if current.count() <= BROADCAST_ROWS else index), lengths


def look_keys(kind: Column, value: Column, lengths: list[tuple[int, int]]) -> Column:
    """Candidate ``(look_kind, look_key, rank)`` of an observable, best rank first."""
    def entry(k: str, key: Column, rank: Column | int) -> Column:
        return F.struct(F.lit(k).alias("look_kind"), key.alias("look_key"), (F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("rank"))

    number, digits = ipv4_to_long(value), ipv6_to_hex(value)
    masked = lambda bits, n: F.when(number.isNotNull(), F.concat(_mask(number, F.lit(n)).cast("string"), F.lit(f"/{n}"))) if bits == 32 else _v6_key(digits, F.lit(n))
    ip = [entry("ip", value, 0)] + [entry("cidr", masked(bits, n), 1) for bits, n in lengths]
    labels = F.split(F.rtrim(F.lower(value), F.lit(".")), r"\.")
    # a bare top-level name is never tried
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: entry("domain", F.array_join(F.slice(labels, i, F.size(labels)), "."), i))
    domain = F.when(F.size(labels) > 1, suffixes).otherwise(F.array().cast("array<struct<look_kind:string,look_key:string,rank:int>>"))
    return (
        F.when(kind == "ip", F.array(*ip)).when(kind == "domain", domain)
        .when(kind == "url", F.array(entry("url", F.lower(value), 0)))
        .when(kind == "hash", F.array(entry("hash", F.lower(value), 0)))
    )


def match_observables(observables: DataFrame, iocs: DataFrame, id_columns: list[str]) -> DataFrame:
    """Best indicator per observable row (``kind``, ``observed``); rows without a hit are dropped."""
    index, lengths = build_index(iocs)
    candidates = observables.select("*", F.inline(look_keys(F.col("kind"), F.col("observed"), lengths))).where(F.col("look_key").isNotNull())
    hits = candidates.join(index, ["look_kind", "look_key"])
    best = F.struct(F.col("rank"), F.col("ioc.load_seq"))
    rest = [c for c in observables.columns if c not in id_columns]
    return (
        hits.groupBy(*id_columns)
        .agg(F.min_by(F.struct(*rest, "ioc"), best).alias("row"))
        .select(*id_columns, "row.*")
    )


def extract_observables(events: DataFrame) -> DataFrame:
    """One row per observable of an event, in a fixed order (``pos``)."""
    def entry(kind: str, column: Column) -> Column:
        return F.when(filled(column), F.struct(F.lit(kind).alias("kind"), column.alias("observed")))

    items = F.array_compact(F.array(
        entry("ip", F.col("dst_ip")), entry("ip", F.col("src_ip")), entry("domain", F.col("domain")), entry("url", F.col("url")),
        entry("domain", url_host(F.col("url"))), entry("hash", F.col("file_hash"))))
    return events.select("event_id", "tenant_id", "timestamp", "seq", "user", "host", "dst_ip", "domain", F.posexplode(items).alias("pos", "item")) \
        .select("*", "item.kind", "item.observed").drop("item").withColumn("pos", F.col("pos").cast("bigint"))


def _by_type(mapping: dict, column: Column) -> Column:
    out = None
    for key, value in mapping.items():
        v = F.array(*[F.lit(t) for t in value]) if isinstance(value, list) else F.lit(value)
        out = F.when(column == key, v) if out is None else out.when(column == key, v)
    return out


def ti_hits(events: DataFrame, iocs: DataFrame) -> DataFrame:
    """Observables with their indicator, before repeat suppression."""
    return match_observables(extract_observables(events), iocs, ["event_id", "pos"])


def ti_cooldown(hits: DataFrame, repeat_seconds: float = REPEAT_SECONDS) -> DataFrame:
    """One hit per (host, indicator) and repeat interval; of one event, the first observable stands."""
    rows = hits.withColumn("ioc_value", F.col("ioc.value")).withColumn("ts_us", micros(F.col("timestamp"))) \
        .withColumn("seq", F.col("seq") * 8 + F.col("pos"))
    return cooldown(rows, ["tenant_id", "host", "ioc_value"], seconds(repeat_seconds), [c for c in rows.columns if c not in ("ts_us", "ioc_value")])


def ti_match(events: DataFrame, iocs: DataFrame, repeat_seconds: float = REPEAT_SECONDS) -> DataFrame:
    """Detections for indicator hits. An address hit reports the destination of the event."""
    rows = ti_cooldown(ti_hits(events, iocs), repeat_seconds)
    ioc = F.col("ioc")
    severity = F.when(ioc["severity"].isin(list(BASE_SCORE)), ioc["severity"]).otherwise("high")
    ents = {"user": F.col("user"), "host": F.col("host"), "dst_ip": F.when(F.col("kind") == "ip", F.col("dst_ip")), "domain": F.col("domain")}
    pairs = [p for k, v in ents.items() for p in (F.lit(k), F.when(filled(v), v))]
    details = F.map_filter(F.create_map(
        F.lit("ioc_value"), ioc["value"], F.lit("ioc_type"), ioc["type"], F.lit("source"), ioc["source"], F.lit("threat"), ioc["threat"],
        F.lit("tags"), F.array_join(ioc["tags"], ","), F.lit("reference"), ioc["reference"]), lambda _, v: v.isNotNull())
    return rows.select(
        digest_id("det_", F.lit("TI"), F.col("event_id"), F.col("pos"), ioc["value"]).alias("detection_id"), "tenant_id",
        F.lit("threat_intel").alias("kind"), F.concat(F.lit("TI-"), F.upper(ioc["type"])).alias("rule_id"),
        F.concat(F.lit("Listed "), ioc["type"], F.lit(": "), ioc["threat"]).alias("title"),
        F.format_string("%s matches %s of %s, confidence %.0f%%", F.col("observed"), ioc["value"], ioc["source"], ioc["confidence"] * 100).alias("description"),
        severity.alias("severity"), (_by_type(BASE_SCORE, severity) * (0.7 + 0.3 * ioc["confidence"])).alias("score"),
        ioc["confidence"].alias("confidence"), _by_type(TYPE_TECHNIQUES, ioc["type"]).alias("techniques"),
        _by_type(TYPE_PHASE, ioc["type"]).alias("phase"), "timestamp",
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("entities"),
        F.array("event_id").alias("evidence_event_ids"), details.alias("details"),
    )


def ioc_stats(iocs: DataFrame) -> DataFrame:
    """Current indicators by type and loaded entries by feed."""
    by_type = current_iocs(iocs).groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("facet"), "name", "n")
    by_feed = iocs.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("feed").alias("facet"), "name", "n")
    return by_type.unionByName(by_feed)


def ioc_lookup(values: DataFrame, iocs: DataFrame, column: str = "value") -> DataFrame:
    """Search each value as address, domain, hash and URL; the first kind with a hit wins."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("kind_rank")) for i, k in enumerate(("ip", "domain", "hash", "url"))])
    distinct = values.select(F.col(column).alias("searched")).where(filled(F.col("searched"))).distinct()
    tries = distinct.select("searched", F.inline(kinds)).withColumn("observed", F.col("searched"))
    hits = match_observables(tries, iocs, ["searched", "kind"])
    return (
        hits.groupBy("searched").agg(F.min_by(F.struct("kind", "ioc"), F.col("kind_rank")).alias("hit"))
        .select("searched", F.col("hit.kind").alias("found_as"), F.col("hit.ioc.value").alias("ioc_value"), F.col("hit.ioc.type").alias("ioc_type"),
                F.col("hit.ioc.threat").alias("threat"), F.col("hit.ioc.source").alias("source"), F.col("hit.ioc.country").alias("country"))
    )


def with_load_order(iocs: DataFrame, order: list[str]) -> DataFrame:
    """Number indicators in load order."""

    return with_row_index(iocs, [], order).withColumnRenamed("row_index", "load_seq")
