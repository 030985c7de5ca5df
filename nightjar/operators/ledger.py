"""Risk ledger: weak signals that accumulate on users and hosts and decay over days."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from nightjar.operators.correlate import detection_entity_keys
from nightjar.operators.ordered import block_window, order_blocks, with_carry
from nightjar.schema import micros

# --- fixed values -------------------------------------------------------------------------------
KIND_WEIGHT = {"rule": 1.0, "threshold": 1.0, "sequence": 1.1, "threat_intel": 1.0, "anomaly": 0.6}
HALF_LIFE_HOURS, THRESHOLD, LOOKBACK_DAYS, MIN_DEPOSITS, MIN_SPAN_SECONDS = 96.0, 80.0, 30.0, 2, 3600.0
SNAPSHOT_FLOOR, SNAPSHOT_TOP = 0.5, 20
# ------------------------------------------------------------------------------------------------


def kind_weight(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in KIND_WEIGHT.items():
        if weight != 1.0:
            out = F.when(kind == name, weight).otherwise(out)
    return out


def deposit_amount() -> Column:
    return F.col("score") * kind_weight(F.col("kind")) * (0.6 + 0.4 * F.col("confidence"))


def ledger_deposits(detections: DataFrame) -> DataFrame:
    """One deposit per detection and touched user or host; repeated detection ids count once."""
    once = detections.dropDuplicates(["detection_id"])
    keys = detection_entity_keys(once).where(F.col("entity").startswith("user:") | F.col("entity").startswith("host:"))
    values = once.select("detection_id", "rule_id", deposit_amount().alias("amount"))
    return keys.join(values, "detection_id").select("tenant_id", "entity", "detection_id", "rule_id", "timestamp", micros(F.col("timestamp")).alias("ts_us"), "amount")


def _now_us(now: datetime | Column | int | None, deposits: DataFrame) -> int:
    """Evaluation time in microseconds; by default the newest deposit."""
    if isinstance(now, int):
        return now
    if isinstance(now, datetime):
        return int(now.timestamp() * 1_000_000)
    return deposits.agg(F.max("ts_us")).first()[0] or 0


def decay(age_us: Column, half_life_hours: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_us, F.lit(0)) / (half_life_hours * 3_600_000_000.0))


def ledger_balance(deposits: DataFrame, now: datetime | int | None = None, half_life_hours: float = HALF_LIFE_HOURS) -> DataFrame:
    """Decayed balance per entity: in time order the running balance equals a plain sum of decayed amounts."""
    at = _now_us(now, deposits)
    return deposits.groupBy("tenant_id", "entity").agg(
        F.sum(F.col("amount") * decay(F.lit(at) - F.col("ts_us"), half_life_hours)).alias("balance"),
        F.count(F.lit(1)).alias("deposits"), F.max("timestamp").alias("updated"))


def ledger_peak(deposits: DataFrame, half_life_hours: float = HALF_LIFE_HOURS) -> DataFrame:
    """Highest balance an entity ever reached, right after a deposit.

    The running balance is one cumulative sum of amounts scaled to a common time, which holds for histories
    up to about 1000 half-lives. Hot entities are summed block by block.
    """
    keys, order = ["tenant_id", "entity"], ["ts_us", "detection_id"]
    at = _now_us(None, deposits)
    unit = half_life_hours * 3_600_000_000.0
    scaled = deposits.select(*keys, *order, (F.col("amount") * F.pow(F.lit(2.0), (F.col("ts_us") - at) / unit)).alias("scaled"))
    laid = with_carry(order_blocks(scaled, keys, order), keys, {"before": (F.sum("scaled"), F.sum)})
    running = F.sum("scaled").over(block_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("before", F.lit(0.0))
    return laid.withColumn("running", running * F.pow(F.lit(2.0), (F.lit(at) - F.col("ts_us")) / unit)) \
        .groupBy(*keys).agg(F.max("running").alias("peak"))


def hot_entities(deposits: DataFrame, now: datetime | int | None = None, threshold: float = THRESHOLD, half_life_hours: float = HALF_LIFE_HOURS) -> DataFrame:
    return ledger_balance(deposits, now, half_life_hours).where(F.col("balance") >= threshold).orderBy(F.desc("balance"), "entity")


def contributing_deposits(deposits: DataFrame, now: int, lookback_days: float = LOOKBACK_DAYS, keep: int | None = None) -> DataFrame:
    """Deposits inside the look-back; of each entity the newest ``keep``, if given (a rank limit, applied before the shuffle)."""
    if keep is None:
        return deposits.where(F.col("ts_us") >= now - int(lookback_days * 86_400_000_000))
    newest = Window.partitionBy("tenant_id", "entity").orderBy(F.desc("ts_us"), F.desc("detection_id"))
    return (
        deposits.where(F.col("ts_us") >= now - int(lookback_days * 86_400_000_000))
        .withColumn("newest", F.row_number().over(newest)).where(F.col("newest") <= keep).drop("newest")
    )


def slow_burn_candidates(deposits: DataFrame, now: datetime | int | None = None, threshold: float = THRESHOLD,
                         half_life_hours: float = HALF_LIFE_HOURS, lookback_days: float = LOOKBACK_DAYS,
                         min_deposits: int = MIN_DEPOSITS, min_span_seconds: float = MIN_SPAN_SECONDS) -> DataFrame:
    """Hot entities whose deposits are spread out in time."""
    at = _now_us(now, deposits)
    hot = ledger_balance(deposits, at, half_life_hours).where(F.col("balance") >= threshold).select("tenant_id", "entity", "balance")
    recent = contributing_deposits(deposits.join(hot.select("tenant_id", "entity"), ["tenant_id", "entity"], "left_semi"), at, lookback_days)
    summary = recent.groupBy("tenant_id", "entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        (F.max("ts_us") - F.min("ts_us")).alias("span_us"),
        F.array_sort(F.collect_list(F.struct("ts_us", "detection_id"))).getField("detection_id").alias("detection_ids"),
        F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return (
        summary.where((F.col("n") >= min_deposits) & (F.col("span_us") >= int(min_span_seconds * 1e6))).join(hot, ["tenant_id", "entity"])
        .select("tenant_id", "entity", F.round("balance", 1).alias("balance"), F.round(F.col("span_us") / 3.6e9, 1).alias("span_hours"),
                "detection_ids", "rules", "first_seen", "last_seen")
    )


def sticky_groups(candidates: DataFrame, emitted: DataFrame) -> DataFrame:
    """Emitted entities stay candidates: ids and rules merge, the balance keeps its maximum."""
    c, e = candidates.alias("c"), emitted.alias("e")
    joined = c.join(e, ["tenant_id", "entity"], "full_outer")

    def merged(name: str) -> Column:
        return F.array_distinct(F.concat(F.coalesce(F.col(f"e.{name}"), F.array().cast("array<string>")), F.coalesce(F.col(f"c.{name}"), F.array().cast("array<string>"))))

    def newer(name: str) -> Column:
        return F.coalesce(F.col(f"c.{name}"), F.col(f"e.{name}")).alias(name)

    return joined.select(
        "tenant_id", "entity", F.greatest("c.balance", "e.balance").alias("balance"), newer("span_hours"),
        merged("detection_ids").alias("detection_ids"), F.array_sort(merged("rules")).alias("rules"), newer("first_seen"), newer("last_seen"),
        F.col("e.entity").isNotNull().alias("sticky"))


def ledger_snapshot(deposits: DataFrame, now: datetime | int | None = None, threshold: float = THRESHOLD,
                    half_life_hours: float = HALF_LIFE_HOURS, top: int = SNAPSHOT_TOP) -> DataFrame:
    """Top entities by balance with peak and hot flag."""
    rows = ledger_balance(deposits, now, half_life_hours).where(F.col("balance") > SNAPSHOT_FLOOR)
    best = rows.orderBy(F.desc("balance"), "entity").limit(top)
    return best.join(ledger_peak(deposits, half_life_hours), ["tenant_id", "entity"]).select(
        "tenant_id", "entity", F.round("balance", 1).alias("balance"), F.round("peak", 1).alias("peak"), "deposits",
        (F.col("balance") >= threshold).alias("hot"), "updated")
