"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds, per blob, which rule versions
have seen it and what they found; a run scans each blob once, for the rule versions that it has not met, appends one
row per scanned blob, and joins the findings back to all paths. Texts move only for blobs with something to scan; all
other shuffles hold digests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from nightjar.llm.common import without


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``needles``: a text without any of these strings can't match. ``least``: shortest group or match."""

    kind: str
    pattern: str
    version: int = 1
    needles: tuple[str, ...] = ()
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The contract's three kinds, in its order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", needles=(":", "="), group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", needles=("AKIA",), least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
)
# Public formats of well-known credentials.
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", needles=("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needles=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", needles=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needles=("eyJ",)),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", needles=("AIza",)),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", needles=("://",)),
)
RULES = BASE_RULES + EXTRA_RULES

LEDGER_SCHEMA = T.StructType([
    T.StructField("blob", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType())),
    T.StructField("findings", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("nth", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))),
])


def scan_text(text: str, rules: list[tuple[int, Rule, re.Pattern]]) -> list[tuple[int, int, int, str]]:
    """Spans (start, rule's place, end, kind) of all rules in one text, sorted.

    Matches are leftmost and non-overlapping per rule; matches that are too short are dropped after matching, so they
    still consume their text.
    """
    found = []
    for nth, rule, pattern in rules:
        if rule.needles and not any(n in text for n in rule.needles):
            continue
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), nth, m.end(), rule.kind))
    return sorted(found)


def compiled(rule: Rule) -> re.Pattern:
    """Letters match in either ASCII case only where the pattern says so. A run of one class may be asked for at its least length."""
    pattern = rule.pattern
    if rule.group == 0 and rule.least > 1 and re.fullmatch(r"\[[^\]]+\]\+", pattern):
        pattern = f"{pattern[:-1]}{{{rule.least},}}"  # maximal runs: the short ones fail anyway
    return re.compile(pattern, re.ASCII)


def scan_versions(versions: DataFrame, ledger: str, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` without the text, with ``blob`` and ``findings`` (start, nth, end, kind; sorted; empty if none).

    ``ledger`` is a folder of Parquet files in a shared store; it is created if absent and gets one row per blob that
    this run scanned. Equal rows, equal texts of several paths and several versions of a path are scanned once. Null and
    empty texts are the empty blob. Null paths are values like any other. Input columns named like a result column are
    replaced. An empty table scans nothing.
    """
    spark = versions.sparkSession
    addressed = without(versions.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__path", F.col(path)), "blob", "findings", text)
    addressed = addressed.withColumn("blob", F.sha2("__text", 256))
    keys = [r.key for r in rules]
    try:
        past = spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    except Exception as error:  # the first run has no ledger
        if "PATH_NOT_FOUND" not in str(error):
            raise
        past = spark.createDataFrame([], LEDGER_SCHEMA)
    seen = past.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("__seen"))
    unseen = addressed.groupBy("blob").agg(F.min("__path").alias("__path")).join(seen, "blob", "left")
    todo = F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce("__seen", F.array().cast("array<string>")))
    unseen = unseen.select("blob", "__path", todo.alias("rules")).where(F.size("rules") > 0)
    one = unseen.withColumnsRenamed({"blob": "b", "__path": "p"})
    jobs = addressed.select("blob", "__path", "__text").join(one, F.col("blob").eqNullSafe(F.col("b")) & F.col("__path").eqNullSafe(F.col("p")))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {r.key: (nth, r, compiled(r)) for nth, r in enumerate(rules)}
        for frame in frames:
            found = [scan_text(t, [ready[k] for k in todo]) for t, todo in zip(frame["__text"], frame["rules"], strict=True)]
            yield pd.DataFrame({"blob": frame["blob"], "rules": frame["rules"], "findings": found})

    scanned = jobs.select("blob", "__text", "rules").mapInPandas(scan, LEDGER_SCHEMA)
    scanned.write.mode("append").parquet(ledger)
    held = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where(F.size("findings") > 0)
    wanted = F.filter("findings", lambda f: F.concat(f["kind"], F.lit("@")).isin(*[f"{r.kind}@" for r in rules]))
    held = held.where(F.exists("rules", lambda r: r.isin(*keys))).select("blob", wanted.alias("findings"))
    # repeated rows may scan a blob twice, later rule versions add findings: one sorted, distinct list per blob
    held = held.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    joined = addressed.drop("__text", "__path").join(held, "blob", "left")
    none = F.array().cast(LEDGER_SCHEMA["findings"].dataType)
    return joined.withColumn("findings", F.coalesce("findings", none))
