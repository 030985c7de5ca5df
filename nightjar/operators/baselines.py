"""Statistical baselines per user and host, learned from the rows before each event."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from nightjar.functions.net import is_private_ip
from nightjar.functions.text import shannon_entropy
from nightjar.operators.ordered import block_window, cooldown, order_blocks, with_carry, with_history_chunks, with_row_index
from nightjar.operators.sliding import SlidingMedian
from nightjar.schema import digest_id, filled, micros, seconds

# --- fixed values -------------------------------------------------------------------------------
SANCTIONED_UPLOAD_DOMAINS = [
    "onedrive.live.com", "sharepoint.com", "office365.com", "microsoftonline.com", "googleapis.com",
    "drive.google.com", "docs.google.com", "dropbox.com", "box.com", "amazonaws.com", "blob.core.windows.net",
    "icloud.com",
]
OFFICE_PARENTS = ["winword.exe", "excel.exe", "outlook.exe", "powerpnt.exe", "acrord32.exe"]
LOGIN_HISTORY, LOGIN_SHARE = 12, 0.03
LOCATION_HISTORY = 5
VOLUME_HISTORY, VOLUME_KEEP, VOLUME_Z, MAD_FLOOR, Z_SCALE = 20, 2000, 3.5, 0.35, 0.6745
PROCESS_HISTORY, PROCESS_HOSTS = 40, 2
DNS_ENTROPY, DNS_ENTROPY_LENGTH, DNS_LONG_LABEL = 3.9, 12, 40
BURST_SECONDS, BURST_COUNT, BURST_QUIET = 60, 40, 600
# ------------------------------------------------------------------------------------------------

ORDER = ["ts_us", "seq"]
CARRIED = ["event_id", "tenant_id", "timestamp", "user", "host", "dst_ip"]


def anomaly_columns(rule_id: str, title: str, reason: Column, score: Column, severity: Column, techniques: list[str], phase: str,
                    confidence: float, details: dict[str, Column]) -> Column:
    """Common shape of a baseline detection, as one struct over a row that holds ``CARRIED``."""
    pairs = [p for name, value in details.items() for p in (F.lit(name), value.cast("string"))]
    names = {"user": "user", "host": "host", "dst_ip": "dst_ip"}
    ents = [p for out, col in names.items() for p in (F.lit(out), F.when(filled(F.col(col)), F.col(col)))]
    return F.struct(
        digest_id("det_", F.lit(rule_id), F.col("event_id")).alias("detection_id"), F.col("tenant_id"),
        F.lit("anomaly").alias("kind"), F.lit(rule_id).alias("rule_id"), F.lit(title).alias("title"), reason.alias("description"),
        severity.alias("severity"), F.round(F.least(F.lit(100.0), score), 1).alias("score"), F.lit(confidence).alias("confidence"),
        F.array(*[F.lit(t) for t in techniques]).alias("techniques"), F.lit(phase).alias("phase"), F.col("timestamp"),
        F.map_filter(F.create_map(*ents), lambda _, v: v.isNotNull()).alias("entities"),
        F.array("event_id").alias("evidence_event_ids"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("details"),
    )


def anomaly_detection(rows: DataFrame, found: Column) -> DataFrame:
    return rows.select(found.alias("found")).select("found.*")


# What each baseline reports, over its measured rows; batch and stream share these.
def login_hour_found(rare_share: float = LOGIN_SHARE) -> Column:
    return anomaly_columns(
        "ANOM-LOGIN-HOUR", "Login at an unusual hour for the user",
        F.format_string("%s: %.1f%% of %d earlier logins fall near hour %02d, most near %02d", "user", F.col("share") * 100, "history", "hour", "peak_hour"),
        25 + 20 * (1 - F.col("share") / rare_share), F.lit("medium"), ["T1078"], "initial_access", 0.7,
        {"hour": F.col("hour"), "history": F.col("history"), "share_pct": F.round(F.col("share") * 100, 2), "peak_hour": F.col("peak_hour")},
    )


def location_found() -> Column:
    return anomaly_columns(
        "ANOM-LOGIN-LOCATION", "Login from a new location",
        F.format_string("%s has no earlier login from %s", F.col("user"), F.coalesce(F.when(F.col("geo_country") != "", F.col("geo_country")), F.col("src_ip"))),
        F.when(F.col("by_country") == 1, 45.0).otherwise(30.0), F.lit("medium"), ["T1078", "T1133"], "initial_access", 0.75,
        {"new_country": F.when(F.col("by_country") == 1, F.col("geo_country")), "new_ip": F.when(F.col("by_ip") == 1, F.col("src_ip"))},
    )


def egress_found(z_threshold: float = VOLUME_Z) -> Column:
    return anomaly_columns(
        "ANOM-EGRESS-VOLUME", "Outbound transfer far above the host's norm",
        F.format_string("%s sent %d bytes to %s, robust z %.1f against a median of %.0f bytes", "host", "bytes_out", "dst_ip", "z", F.expm1("median_x")),
        F.least(F.lit(70.0), 35 + 6.0 * (F.col("z") - z_threshold)), F.lit("high"), ["T1048", "T1041"], "exfiltration", 0.8,
        {"z_score": F.round("z", 2), "baseline_median_bytes": F.floor(F.expm1("median_x"))},
    )


def rare_process_found() -> Column:
    office = F.lower(F.coalesce("parent_process_name", F.lit(""))).isin(OFFICE_PARENTS)
    return anomaly_columns(
        "ANOM-RARE-PROCESS", "Rare process is new on the host",
        F.format_string("%s is new on %s and known on %d other hosts", "process_name", "host", "org_hosts"),
        F.when(office, 35.0).otherwise(20.0), F.when(office, "medium").otherwise("low"), ["T1204"], "execution", 0.6,
        {"org_hosts": F.col("org_hosts"), "parent": F.col("parent_process_name")},
    )


def odd_label_found() -> Column:
    return anomaly_columns(
        "ANOM-DNS-ENTROPY", "Random-looking DNS label",
        F.format_string("label %s has entropy %.2f and length %d", "label", "label_entropy", "label_length"),
        F.lit(35.0), F.lit("medium"), ["T1071.004", "T1568.002"], "command_and_control", 0.7,
        {"entropy": F.round("label_entropy", 2), "label_len": F.col("label_length")},
    )


def burst_found(window_seconds: float = BURST_SECONDS, count: int = BURST_COUNT) -> Column:
    return anomaly_columns(
        "ANOM-DNS-BURST", "Burst of DNS queries from one host",
        F.format_string(f"at least {count} DNS queries in {window_seconds:g} s from %s", "host"),
        F.lit(30.0), F.lit("medium"), ["T1071.004"], "command_and_control", 0.65, {"queries": F.lit(count)},
    )


def is_login() -> Column:
    return (F.col("event_type") == "authentication") & (F.col("action") == "login_success") & filled(F.col("user"))


def is_start() -> Column:
    return (F.col("event_type") == "process_start") & filled(F.col("host")) & filled(F.col("process_name"))


def _logins(events: DataFrame) -> DataFrame:
    return (
        events.where(is_login())
        .select(*CARRIED, "src_ip", "geo_country", "seq", F.lower("user").alias("user_key"), micros(F.col("timestamp")).alias("ts_us"))
    )


# ------------------------------------------------------------------------------------------ logins
def login_hour_profile(events: DataFrame) -> DataFrame:
    """Every login with its user's earlier hour histogram (24 running counts)."""
    keys = ["tenant_id", "user_key"]
    laid = order_blocks(_logins(events).withColumn("hour", F.hour("timestamp")), keys, ORDER)
    flags = {h: F.when(F.col("hour") == h, 1).otherwise(0) for h in range(24)}
    carried = with_carry(laid, keys, {f"before_{h}": (F.sum(flag), F.sum) for h, flag in flags.items()})
    earlier = block_window(keys, ORDER).rowsBetween(Window.unboundedPreceding, -1)
    counts = [F.coalesce(F.sum(flags[h]).over(earlier), F.lit(0)) + F.coalesce(F.col(f"before_{h}"), F.lit(0)) for h in range(24)]
    return carried.select(*CARRIED, "seq", "ts_us", "hour", F.array(*counts).alias("histogram"))


def anomaly_login_hour(events: DataFrame, min_history: int = LOGIN_HISTORY, rare_share: float = LOGIN_SHARE) -> DataFrame:
    """Logins in hours a user almost never uses; neighbouring hours count half, midnight wraps."""
    def measure(h: Column) -> Column:
        def at(shift: int) -> Column:
            return F.element_at(h, ((F.col("hour") + shift) % 24 + 1).cast("int")).cast("double")

        total = F.aggregate(h, F.lit(0).cast("long"), lambda a, v: a + v)
        share = F.try_divide(at(23) * 0.5 + at(0) + at(1) * 0.5, total * 2.0)
        return F.struct(total.alias("history"), share.alias("share"), (F.array_position(h, F.array_max(h)) - 1).alias("peak_hour"))

    # a one-element transform binds the histogram once
    measured = login_hour_profile(events).withColumn("m", F.transform(F.array("histogram"), measure)[0])
    rows = measured.where((F.col("m.history") >= min_history) & (F.col("m.share") < rare_share)) \
        .select(*CARRIED, "hour", "m.history", "m.share", "m.peak_hour")
    return anomaly_detection(rows, login_hour_found(rare_share))


def _nth_row(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Position of the n-th row of each key; the rank limit runs before the shuffle, so hot keys stay cheap."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    return (
        rows.select(*keys, *ORDER).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
        .where(F.col("nth") == n).select(*keys, F.struct(*ORDER).alias("nth_at"))
    )


def _first_rows(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Earliest row of each key by partial aggregation."""
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*[c for c in columns if c not in keys]), F.struct(*ORDER)).alias("row"))
        .select(*keys, "row.*")
    )


def anomaly_first_seen_location(events: DataFrame, min_history: int = LOCATION_HISTORY) -> DataFrame:
    """First login of a user from a country, or from a public address, after enough history.

    Only first rows per (user, country) and (user, address) can fire, so no join returns to the full login set.
    """
    logins = _logins(events)
    columns = [*CARRIED, *ORDER, "user_key", "src_ip", "geo_country"]
    countries = _first_rows(logins.where(filled(F.col("geo_country"))), ["tenant_id", "user_key", "geo_country"], columns)
    addresses = _first_rows(logins.where(filled(F.col("src_ip"))), ["tenant_id", "user_key", "src_ip"], columns).where(~is_private_ip(F.col("src_ip")))
    both = (
        countries.select(*columns, F.lit(1).alias("by_country"), F.lit(0).alias("by_ip"))
        .unionByName(addresses.select(*columns, F.lit(0).alias("by_country"), F.lit(1).alias("by_ip")))
        .groupBy(*columns).agg(F.max("by_country").alias("by_country"), F.max("by_ip").alias("by_ip"))
    )
    settled = _nth_row(logins, ["tenant_id", "user_key"], min_history)
    rows = both.join(settled, ["tenant_id", "user_key"]).where(F.struct(*ORDER) > F.col("nth_at"))
    return anomaly_detection(rows, location_found())


# ------------------------------------------------------------------------------------------ volume
def _robust_z(batch: pd.DataFrame, keep: int, need: int, floor: float) -> pd.DataFrame:
    """Median/MAD z-score of each wanted row against the rows before it in the chunk."""
    batch = batch.sort_values("row_index", kind="stable")
    wanted = batch["wanted"].to_numpy() & ~batch["is_history"].to_numpy() & (batch["row_index"].to_numpy() >= need)
    med, z, past = np.full(len(batch), np.nan), np.full(len(batch), np.nan), SlidingMedian(keep)
    for i, (x, asked) in enumerate(zip(batch["x"].tolist(), wanted.tolist(), strict=True)):
        if asked and x > (m := past.median()):
            med[i], z[i] = m, Z_SCALE * (x - m) / (past.deviation(m) or MAD_FLOOR)
        past.push(x)
    batch["median_x"], batch["z"] = med, z
    return batch[batch["z"] >= floor]


def has_volume() -> Column:
    return (F.col("event_type") == "network_connection") & (F.coalesce(F.col("bytes_out"), F.lit(0)) != 0) & filled(F.col("host"))


def sanctioned_upload() -> Column:
    lowered, out = F.lower(F.coalesce("domain", F.lit(""))), F.lit(False)
    for d in SANCTIONED_UPLOAD_DOMAINS:
        out = out | lowered.endswith(d)
    return out


def anomaly_egress_volume(events: DataFrame, min_history: int = VOLUME_HISTORY, z_threshold: float = VOLUME_Z,
                          keep: int = VOLUME_KEEP, chunk: int = 20_000) -> DataFrame:
    """Public transfers far above the host's last ``keep`` transfers (log bytes, median and MAD).

    Sanctioned cloud domains feed the history but never fire. The exact moving MAD has no built-in window, so
    bounded chunks (each with its history) go to a grouped map over a sorted window.
    """
    rows = events.where(has_volume()).select(
        *CARRIED, "seq", micros(F.col("timestamp")).alias("ts_us"), "bytes_out", F.upper("host").alias("host_key"),
        F.log1p("bytes_out").alias("x"), (~sanctioned_upload() & ~is_private_ip(F.col("dst_ip"))).alias("wanted"))
    keys = ["tenant_id", "host_key"]
    chunks = with_history_chunks(with_row_index(rows, keys, ORDER), keep, max(chunk, keep))
    names = [*CARRIED, "bytes_out", "row_index", "x", "wanted", "is_history"]
    schema = chunks.select(*names).schema.add("median_x", "double").add("z", "double")
    flagged = chunks.select(*names, "host_key", "chunk").groupBy(*keys, "chunk").applyInPandas(
        lambda pdf: _robust_z(pdf[names].copy(), keep, min_history, z_threshold)[[*names, "median_x", "z"]], schema)
    return anomaly_detection(flagged, egress_found(z_threshold))


# --------------------------------------------------------------------------------------- processes
def anomaly_rare_process(events: DataFrame, min_history: int = PROCESS_HISTORY, max_hosts: int = PROCESS_HOSTS) -> DataFrame:
    """A process new to a settled host and so far seen on at most ``max_hosts`` hosts."""
    starts = (
        events.where(is_start())
        .select(*CARRIED, "seq", "process_name", "parent_process_name", micros(F.col("timestamp")).alias("ts_us"),
                F.upper("host").alias("host_key"), F.lower("process_name").alias("process_key"))
    )
    columns = [*CARRIED, *ORDER, "host_key", "process_key", "process_name", "parent_process_name"]
    firsts = _first_rows(starts, ["tenant_id", "host_key", "process_key"], columns)
    spread = Window.partitionBy("tenant_id", "process_key").orderBy(*ORDER)
    rare = firsts.withColumn("nth_host", F.row_number().over(spread)).where(F.col("nth_host") <= max_hosts + 1)
    settled = _nth_row(starts, ["tenant_id", "host_key"], min_history)
    rows = rare.join(settled, ["tenant_id", "host_key"]).where(F.struct(*ORDER) > F.col("nth_at")).withColumn("org_hosts", F.col("nth_host") - 1)
    return anomaly_detection(rows, rare_process_found())


# --------------------------------------------------------------------------------------------- DNS
def _queries(events: DataFrame) -> DataFrame:
    labels = F.split(F.lower("domain"), r"\.")
    label = F.when(F.size(labels) > 2, labels[0]).otherwise(F.lit(""))
    return (
        events.where((F.col("event_type") == "dns_query") & filled(F.col("domain")))
        .select(*CARRIED, "seq", micros(F.col("timestamp")).alias("ts_us"), label.alias("label"))
        .withColumn("label_entropy", shannon_entropy(F.col("label"))).withColumn("label_length", F.length("label"))
        .withColumn("odd_label", ((F.col("label_entropy") >= DNS_ENTROPY) & (F.col("label_length") >= DNS_ENTROPY_LENGTH))
                    | (F.col("label_length") >= DNS_LONG_LABEL))
    )


def anomaly_dns_entropy(events: DataFrame) -> DataFrame:
    """Random-looking or very long first label of a name with three or more labels."""
    return anomaly_detection(_queries(events).where("odd_label"), odd_label_found())


def anomaly_dns_burst(events: DataFrame, window_seconds: float = BURST_SECONDS, count: int = BURST_COUNT,
                      quiet_seconds: float = BURST_QUIET, chunk: int = 100_000) -> DataFrame:
    """``count`` queries of a host inside the window, not counting odd labels; silent for a while after firing.

    The window holds ``count`` rows exactly when the row ``count - 1`` places earlier is young enough.
    """
    keys = ["tenant_id", "host_key"]
    rows = _queries(events).where(~F.col("odd_label") & filled(F.col("host"))).withColumn("host_key", F.upper("host"))
    back = count - 1
    chunks = with_history_chunks(with_row_index(rows, keys, ORDER), back, max(chunk, back))
    w = Window.partitionBy(*keys, "chunk").orderBy("row_index")
    dense = (
        chunks.withColumn("earliest", F.lag("ts_us", back).over(w) if back else F.col("ts_us"))
        .where(~F.col("is_history") & (F.col("earliest") >= F.col("ts_us") - seconds(window_seconds)))
    )
    fired = cooldown(dense, keys, seconds(quiet_seconds) + 1, [*CARRIED])
    return anomaly_detection(fired, burst_found(window_seconds, count))


def run_baselines(events: DataFrame) -> list[DataFrame]:
    return [anomaly_login_hour(events), anomaly_first_seen_location(events), anomaly_egress_volume(events),
            anomaly_rare_process(events), anomaly_dns_entropy(events), anomaly_dns_burst(events)]


def baseline_snapshot(events: DataFrame) -> DataFrame:
    """How many users, hosts and processes have a baseline (keys first, so the distinct counts shuffle little)."""
    tagged = events.select(F.inline(F.array_compact(F.array(
        F.when(is_login(),
               F.struct(F.lit("users_with_login_baseline").alias("baseline"), F.concat_ws("|", "tenant_id", F.lower("user")).alias("key"))),
        F.when(has_volume(),
               F.struct(F.lit("hosts_with_volume_baseline").alias("baseline"), F.concat_ws("|", "tenant_id", F.upper("host")).alias("key"))),
        F.when(is_start(),
               F.struct(F.lit("processes_known").alias("baseline"), F.concat_ws("|", "tenant_id", F.lower("process_name")).alias("key"))),
    ))))
    return tagged.groupBy("baseline", "key").agg(F.count(F.lit(1)).alias("rows")).groupBy("baseline").agg(F.count(F.lit(1)).alias("n"))


