"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows are dealt into blocks by a hash of their key. How many rows each block sends to each shard is drawn first, from
the exact law of a uniform shuffle: the rows of a matrix with fixed row sums (block counts) and column sums (shard
sizes) are multivariate hypergeometric draws. Each block then permutes its rows and cuts them at the drawn counts, the
rows are exchanged, and each receiver permutes again. A receiver is a page of a shard, not a whole shard: the matrix
has a second level that deals the rows of a shard to its pages, so no task ever sorts a shard.

Only counts reach the driver: at most ``FINEST`` numbers per run.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from nightjar.llm.common import without

FINEST = 8192  # most blocks, and so most numbers that reach the driver
PLAIN_LIMIT = 10**9  # above it the library's sampler refuses


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement; any population size.

    Beyond the library's limit: inversion of the cumulative law in a window of fourteen standard deviations around
    the mode, with the ratios of neighbouring probabilities.
    """
    if good + bad < PLAIN_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(draws, good)
    total = good + bad
    mode = int((draws + 1) * (good + 1) // (total + 2))
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(0.0, (total - draws) / (total - 1))) + 1
    reach = int(14 * spread) + 10
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    law = np.exp(weight - weight.max()).cumsum()
    return first + int(np.searchsorted(law, rng.random() * law[-1], side="right"))


def draw_row(rng: np.random.Generator, room: np.ndarray, draws: int) -> np.ndarray:
    """One row of the matrix: ``draws`` rows spread over columns with ``room`` left, and the room reduced in place."""
    out = np.zeros(len(room), dtype=np.int64)
    behind = int(room.sum())
    for j, here in enumerate(room.tolist()):
        if not draws:
            break
        behind -= here
        out[j] = hypergeometric(rng, here, behind, draws) if behind else draws
        draws -= int(out[j])
    room -= out
    return out


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Counts at most one apart; the first shards take the rest."""
    return np.array([rows // shards + (j < rows % shards) for j in range(shards)], dtype=np.int64)


def shuffle_to_shards(docs: DataFrame, keys: list[str], shards: int = 40, seed: int = 20, rows_per_block: int = 2_048) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in each shard), uniformly shuffled.

    ``keys`` identify a row; rows that agree in all of them (repeated rows) are interchangeable and may take each
    other's places. Null keys are values like any other. An empty table gives an empty result. Shard sizes differ by
    one at most. Input columns named like a result column are replaced. Equal input gives equal output, whatever the
    partitioning; rows with unequal keys are permuted independently of their order in the input.
    """
    spark = docs.sparkSession
    docs = without(docs, "shard", "slot")
    mixed = lambda n: F.xxhash64(F.lit(seed), F.lit(n), *[F.col(k) for k in keys])
    fine = docs.groupBy(F.pmod(mixed(1), F.lit(FINEST)).alias("__fine")).count().collect()
    rows = sum(r["count"] for r in fine)
    blocks = 1
    while blocks < FINEST and blocks * rows_per_block < rows:
        blocks *= 2
    counts = np.zeros(blocks, dtype=np.int64)
    for r in fine:
        counts[r["__fine"] % blocks] += r["count"]
    rng = np.random.default_rng([seed, 0])
    room = shard_sizes(rows, shards)
    sizes = room.copy()
    matrix = np.array([draw_row(rng, room, int(n)) for n in counts])
    ends = matrix.cumsum(axis=1)
    sent = spark.createDataFrame([(b, ends[b].tolist()) for b in range(blocks)], "__block int, __ends array<bigint>")
    per_page = max(rows_per_block, -(-rows // FINEST))
    pages = np.maximum(1, -(-sizes // per_page))

    def deal_pages(frames):
        """Second level, one shard at a time: rows of each block to the pages of the shard."""
        for frame in frames:
            for shard, column in zip(frame["__shard"], frame["__column"], strict=True):
                own = np.random.default_rng([seed, 1, int(shard)])
                left = shard_sizes(int(sum(column)), int(pages[shard]))
                cuts = [draw_row(own, left, int(n)).cumsum().tolist() for n in column]
                yield pd.DataFrame({"__block": np.arange(len(column), dtype=np.int32), "shard": np.int32(shard), "__cuts": cuts})

    columns = spark.createDataFrame([(j, matrix[:, j].tolist()) for j in range(shards)], "__shard int, __column array<bigint>")
    paged = columns.repartition(min(shards, 64), "__shard").mapInPandas(deal_pages, "__block int, shard int, __cuts array<bigint>")
    shape = spark.createDataFrame([(j, int(sizes[j]), int(pages[j])) for j in range(shards)], "shard int, __size bigint, __pages bigint")
    paged = paged.join(shape, "shard")

    permuted = Window.partitionBy("__block").orderBy(mixed(2), *keys)
    sender = docs.withColumn("__block", F.pmod(mixed(1), F.lit(blocks)).cast("int")).withColumn("__rank", F.row_number().over(permuted) - 1)
    sender = sender.join(sent, "__block")
    place = lambda ends, rank: F.size(F.filter(ends, lambda x: x <= rank)).cast("int")
    sender = sender.withColumn("shard", place(F.col("__ends"), F.col("__rank")))
    before = F.when(F.col("shard") > 0, F.element_at("__ends", F.greatest(F.col("shard"), F.lit(1)))).otherwise(F.lit(0))
    sender = sender.withColumn("__rank", F.col("__rank") - before).drop("__ends").join(paged, ["__block", "shard"])
    sender = sender.withColumn("__page", place(F.col("__cuts"), F.col("__rank"))).drop("__cuts", "__rank", "__block")
    again = Window.partitionBy("shard", "__page").orderBy(mixed(3), *keys)
    page_size, extra = F.floor(F.col("__size") / F.col("__pages")), F.col("__size") % F.col("__pages")
    start = F.col("__page") * page_size + F.least(F.col("__page").cast("long"), extra)
    slot = (start + F.row_number().over(again) - 1).cast("long")
    return sender.withColumn("slot", slot).drop("__page", "__size", "__pages")
