import collections

import numpy as np
from edge import SCHEMA, table
from nightjar.llm import mixing, sharding
from nightjar.llm.common import word_count
from pyspark.sql import functions as F


def test_shards_are_exact_gapless_and_repeatable(spark):
    rows = spark.range(5_003).select(F.col("id").alias("doc_id"))
    one = sharding.shuffle_to_shards(rows, ["doc_id"], 7, rows_per_block=300).collect()
    two = sharding.shuffle_to_shards(rows.repartition(9), ["doc_id"], 7, rows_per_block=300).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 5_003
    slots = collections.defaultdict(list)
    for r in one:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == [714, 714, 715, 715, 715, 715, 715]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shuffle_is_uniform(spark):
    """Neither the shard nor the place in it depends on the order of the keys, and runs of keys are torn apart."""
    n, shards = 20_000, 5
    rows = spark.range(n).select(F.col("id").alias("doc_id"))
    place = sharding.shuffle_to_shards(rows, ["doc_id"], shards, rows_per_block=1_000).toPandas().sort_values("doc_id")
    table = np.zeros((20, 20))
    np.add.at(table, (place["doc_id"] // (n // 20), (place["shard"] * 4 + place["slot"] // (n // shards // 4)).clip(upper=19)), 1)
    expected = n / 400
    assert ((table - expected) ** 2 / expected).sum() < 530  # chi-square, 361 degrees of freedom: about 1 in 10^8
    together = (place["shard"].to_numpy()[1:] == place["shard"].to_numpy()[:-1]).mean()
    assert abs(together - 1 / shards) < 0.015


def test_large_population_law():
    rng = np.random.default_rng(1)
    good, bad, draws = 3 * 10**9, 7 * 10**9, 10**6
    got = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(300)])
    assert abs(got.mean() - 3 * 10**5) < 150 and 350 < got.std() < 570


def test_shards_take_edge_rows(spark):
    out = sharding.shuffle_to_shards(table(spark), ["doc_id", "text"], 5).collect()
    assert len(out) == 16 and max(collections.Counter(r["shard"] for r in out).values()) == 4
    assert sharding.shuffle_to_shards(spark.createDataFrame([], SCHEMA), ["doc_id"], 5).count() == 0


def reachable(lengths, counts):
    sums = {0}
    for length, n in zip(lengths, counts, strict=True):
        sums = {s + k * length for s in sums for k in range(n + 1)}
    return sums


def test_budget_is_met_as_nearly_as_any_subset_can():
    rng = np.random.default_rng(4)
    for _ in range(300):
        lengths = np.unique(rng.integers(0, 30, size=rng.integers(1, 6)))
        counts = rng.integers(1, 4, size=len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        take = mixing.fit_lengths(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * lengths).sum())
        if len(lengths) and budget < (lengths * counts).sum():
            # the proportional start is kept, so what is open is met as nearly as the rest allows
            base = np.array([int(n) * budget // int((lengths * counts).sum()) if s else 0 for s, n in zip(lengths, counts, strict=True)])
            rest = budget - int((base * lengths).sum())
            best = min(abs(rest - s) for s in reachable(lengths.tolist(), (counts - base).tolist()))
            assert abs(budget - got) == best


def water(sizes, weights, share=1.5, cap=2.0):
    """Shares one excess at a time, as the contract words it."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def test_mix_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), s, int(n)) for i, (s, n) in enumerate(zip(rng.choice(["b", "a", "ü", None, "hot"], 6_000, p=[0.2, 0.1, 0.05, 0.05, 0.6]), rng.choice([0, 3, 50, 51, 700], 6_000), strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(docs, "n").collect()
    again = mixing.mix(docs.repartition(7), "n").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    names = ["a", "b", "hot", "ü", None]
    sizes = [sum(n for _, s, n in rows if s == name) for name in names]
    for name, size, target in zip(names, sizes, water(sizes, [3, 1, 2, 3, 1]), strict=True):
        own = [r for r in got if r["source"] == name]
        assert all(r["source_size"] == size and abs(r["target"] - target) < 1e-6 * max(1, target) for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= 3
        assert all(0 <= r["copies"] <= 2 for r in own)


def test_mix_takes_edge_rows(spark):
    out = mixing.mix(table(spark), word_count(F.col("text"))).collect()
    assert len(out) == 16 and all(r["copies"] == 0 for r in out if not r["size"])
    assert mixing.mix(spark.createDataFrame([], SCHEMA), word_count(F.col("text"))).count() == 0
