"""Mix sources to target weights by subset-sum budget fitting.

The documents of a source are counted by exact length. Whole passes over the source are taken first; the rest of its
budget gets the same share of every length, and what is then left is filled by bounded-knapsack dynamic programming
over the remaining documents per length. Finally the planned number of documents of each length is picked by a seeded
order. A task plans one source from its table of lengths, which is bounded by the longest document, not by the number
of documents; picking works in hash buckets, so that a length with a third of all documents fills many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from nightjar.llm.common import without, written
from nightjar.operators.ordered import with_row_index

WEIGHTS = (3, 1, 2)  # of the sources in code-point order, repeating
BUCKET_ROWS = 256


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_room: int = 65_536) -> np.ndarray:
    """How many documents of each length to take so that the lengths sum up to ``budget``, or as near as can be found.

    Every length first gives its share, rounded down. Lengths with the largest remainders give one more document until
    at most ``dp_room`` words are open. Those are filled by a knapsack over (length, documents left), exactly if any
    combination fits, else with the nearest sum. Zero lengths are never taken.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    share = [int(n) * budget for n in counts]
    take = np.array([s // total if l else 0 for s, l in zip(share, lengths.tolist(), strict=True)], dtype=np.int64)
    rest = budget - int((lengths * take).sum())
    order = sorted(range(len(lengths)), key=lambda i: (-(share[i] % total), int(lengths[i])))
    for i in order:
        if rest <= dp_room:
            break
        if 0 < lengths[i] <= rest and take[i] < counts[i]:
            take[i] += 1
            rest -= int(lengths[i])
    left = counts - take
    usable = [i for i in order if lengths[i] > 0 and left[i] > 0]
    if rest == 0 or not usable:
        return take
    limit = rest + min(rest, max(int(lengths[i]) for i in usable))
    reached = np.zeros(limit + 1, dtype=bool)
    reached[0] = True
    by = np.full(limit + 1, -1, dtype=np.int32)
    items: list[tuple[int, int, int]] = []
    for i in usable:
        length, some = int(lengths[i]), 1
        more = min(int(left[i]), limit // length)
        while more > 0 and not reached[rest]:
            part = min(some, more)
            weight = part * length
            new = np.flatnonzero(reached[: limit + 1 - weight] & ~reached[weight:]) + weight
            by[new] = len(items)
            reached[new] = True
            items.append((i, part, weight))
            more -= part
            some *= 2
        if reached[rest]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, part, weight = items[by[at]]
        take[i] += part
        at -= weight
    return take


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(__source, source_size, target)`` from ``(__source, source_size)``.

    Sources are weighted in code-point order, null last. A level is found with ``target = min(cap * size, level * weight)``
    and all targets together ``share`` of all words: each round takes the sources over their cap at the present level out
    and shares what is left among the others. The level only rises, so the rounds end; each is one aggregate.
    """
    indexed = with_row_index(sizes.withColumn("__null", F.col("__source").isNull()), [], ["__null", "__source"])
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighted = written(indexed.select("__source", "source_size", F.get(table, (F.col("row_index") % len(weights)).cast("int")).alias("__weight")), "sources")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("__weight") > cap * F.col("source_size")
        got = weighted.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("words"),
            F.sum(F.when(~full, F.col("__weight"))).alias("weight")).first()
        if got["n"] == capped or not got["weight"]:
            break
        capped, level = got["n"], (share * total - cap * (got["words"] or 0)) / got["weight"]
    target = F.least(cap * F.col("source_size"), F.lit(level) * F.col("__weight"))
    return weighted.select("__source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, size: Column | str, source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
        share: float = 1.5, cap: float = 2.0, seed: int = 10) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the document, 0 to ``cap``).

    ``size`` is an expression for the words of a document. A null source is a source of its own, after all others. Documents
    without words are never taken. Rows that agree in ``key``, source and size are interchangeable. The result depends on the
    rows and the seed alone, so reruns agree. Input columns named like a result column are replaced; an empty table
    gives an empty result.
    """
    sized = docs.withColumn("__size", size if isinstance(size, Column) else F.col(size)).withColumn("__source", F.col(source))
    sized = without(sized, "size", "source_size", "target", "copies")
    sized = sized.withColumn("__group", F.when(F.col("__source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("__source"))))
    lengths = written(sized.groupBy("__source", "__group", "__size").agg(F.count(F.lit(1)).alias("__docs")), "lengths")
    sizes = lengths.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__docs")).alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    named = targets.withColumn("__group", F.when(F.col("__source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("__source")))).drop("__source")

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__size", ignore_index=True)
        total, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        budget = round(target)
        passes = budget // total if total else 0
        take = fit_lengths(frame["__size"].to_numpy(), frame["__docs"].to_numpy(), budget - passes * total)
        whole = np.where(frame["__size"] > 0, passes, 0)
        return frame.assign(__whole=whole, __take=take)[["__group", "__size", "__docs", "source_size", "target", "__whole", "__take"]]

    planned = lengths.drop("__source").join(named, "__group").groupBy("__group").applyInPandas(
        plan, "__group string, __size bigint, __docs bigint, source_size bigint, target double, __whole bigint, __take bigint")
    planned = written(planned, "plan")
    shuffled = F.xxhash64(F.lit(seed), F.col(key))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("__docs") / BUCKET_ROWS))
    dealt = sized.drop("__source").join(planned, ["__group", "__size"]).withColumn("__order", shuffled)
    dealt = dealt.withColumn("__bucket", F.pmod(F.col("__order"), buckets))
    held = dealt.groupBy("__group", "__size", "__bucket").agg(F.count(F.lit(1)).alias("__held"))
    earlier = Window.partitionBy("__group", "__size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("__group", "__size", "__bucket", F.coalesce(F.sum("__held").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__group", "__size", "__bucket").orderBy("__order", key)
    ranked = dealt.withColumn("__rank", F.row_number().over(inside)).join(held, ["__group", "__size", "__bucket"])
    copies = F.col("__whole") + F.when(F.col("__rank") + F.col("__before") <= F.col("__take"), 1).otherwise(0)
    out = ranked.withColumn("copies", copies.cast("long")).withColumnRenamed("__size", "size")
    return out.drop("__group", "__docs", "__whole", "__take", "__order", "__bucket", "__before", "__rank")
