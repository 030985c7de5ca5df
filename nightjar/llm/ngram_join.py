"""Near-duplicate join on word n-grams: MinHash with Bayesian candidate pruning, verified exactly.

1. Every text is sketched where it is read: MinHash values of its set of five-word shingles. Equal texts become one node.
2. Nodes that share a band of MinHash values meet in a bucket. A bucket gives one edge per member, to its smallest node,
   never all pairs. Edges whose posterior probability of a similarity of ``LOOSE`` is negligible are dropped; the connected
   groups of the rest hold all nodes that can be linked, as a linked pair shares many buckets.
3. Each group is dealt into pairs of tiles, so a group of any size is work for many tasks of bounded size. Inside a task,
   pairs are compared by MinHash values a round at a time; a pair is dropped as soon as the posterior probability of
   reaching the threshold falls below ``TOLERANCE``. What is left is verified on the shingle sets themselves.
4. A task gives out one row per node (its number of links there, and one node of its local class), so links inside a
   class are counted but never listed. The classes follow from connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from nightjar.llm.common import tile_pairs, written
from nightjar.llm.words import slices, word_codes
from nightjar.operators.correlate import connected_components

WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 24, 4  # a pair at the threshold shares no band with probability (1 - 0.8^4)^24 = 3e-6
HASHES = BANDS * BAND_ROWS
ROUND = 16  # MinHash values compared at a time
TOLERANCE = 1e-6
LOOSE = 0.55  # similarity that keeps two nodes in one group; groups only gather what is verified later
TILE = 192  # nodes; a task holds two tiles
RANGE_SHINGLES = 500_000  # shingles of a task's tiles that are compared at a time, which bounds its memory beside the sets


def least_matches(threshold: float, tolerance: float = TOLERANCE, hashes: int = HASHES) -> np.ndarray:
    """``out[n]``: fewest of n agreeing values with which a pair stays.

    With a uniform prior, the posterior after m of n agreements is Beta(m + 1, n - m + 1), and P(similarity >= t) is
    the probability of at most m successes in n + 1 draws of probability t.
    """
    out = np.zeros(hashes + 1, dtype=np.int64)
    for n in range(hashes + 1):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


def prune(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which row pairs of two arrays of MinHash values survive all rounds."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for start in range(0, left.shape[1], ROUND):
        end = min(start + ROUND, left.shape[1])
        matches[alive] += (left[alive, start:end] == right[alive, start:end]).sum(axis=1)
        alive = alive[matches[alive] >= least[end]]
    out = np.zeros(len(left), dtype=bool)
    out[alive] = True
    return out


_rng = np.random.default_rng(5)
PLACES = [int(x) | 1 for x in _rng.integers(0, 2**63, size=WORDS)]
SLOPES = [int(x) | 1 for x in _rng.integers(0, 2**63, size=HASHES)]
SHIFTS = [int(x) for x in _rng.integers(0, 2**63, size=HASHES)]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text. A text with fewer words than a shingle is one shingle; none without words."""
    codes, offsets, dictionary = word_codes(texts)
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in dictionary.to_pylist()), np.uint64, len(dictionary))
    hashes = names[codes] if len(codes) else np.zeros(0, np.uint64)
    places = np.array(PLACES, dtype=np.uint64)
    for i in range(len(offsets) - 1):
        own = hashes[offsets[i]:offsets[i + 1]]
        if not len(own):
            yield own
            continue
        n = max(1, len(own) - WORDS + 1)
        mixed = np.zeros(n, dtype=np.uint64)
        for j in range(min(WORDS, len(own))):
            mixed += own[j:j + n] * places[j]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        yield np.unique(mixed)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """``HASHES`` values of a set, 32 bits each."""
    slopes, shifts = np.array(SLOPES, dtype=np.uint64)[:, None], np.array(SHIFTS, dtype=np.uint64)[:, None]
    best = np.full(HASHES, 2**32 - 1, dtype=np.uint64)
    for start in range(0, len(shingles), 2048):
        part = shingles[None, start:start + 2048] * slopes
        part += shifts
        part >>= np.uint64(32)
        np.minimum(best, part.min(axis=1), out=best)
    return best.astype(np.uint32)


def sketches(docs: DataFrame) -> DataFrame:
    """``(id, node, shingles, sketch)`` from ``(id, node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("node"), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([minhash(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["id", "node", "shingles", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, node binary, shingles int, sketch binary")


def add_overlaps(total: np.ndarray, sets: list[np.ndarray]) -> None:
    """Adds the sizes of the intersections of all sets to ``total``."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, columns, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[columns] > 1  # a shingle of one set only adds to no intersection
    rows, columns = rows[shared], columns[shared]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    _, columns = np.unique(columns, return_inverse=True)
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, 4096):
        a, b = np.searchsorted(columns, [start, start + 4096])
        dense = np.zeros((len(sets), 4096), dtype=np.float32)
        dense[rows[a:b], columns[a:b] - start] = 1
        total += dense @ dense.T


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair (left, right) of sets."""
    if len(left) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist(), strict=True)], dtype=np.int64)
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    # shingles are hashes: equal ranges of values hold about equal numbers of them
    parts = -(-sum(map(len, sets)) // RANGE_SHINGLES) or 1
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    cuts = [[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in sets]
    for k in range(parts):
        add_overlaps(total, [s[c[k]:c[k + 1]] for s, c in zip(sets, cuts, strict=True)])
    return total[left, right].astype(np.int64)


def links_in_tiles(tile: np.ndarray, values: np.ndarray, sets: list[np.ndarray], across: bool, threshold: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) of rows with a Jaccard similarity of at least ``threshold``: inside one tile, or across two."""
    if across:
        a, b = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
        left, right = np.repeat(a, len(b)), np.tile(b, len(a))
    else:
        left, right = np.triu_indices(len(tile), 1)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    near = np.minimum(sizes[left], sizes[right]) >= threshold * np.maximum(sizes[left], sizes[right])
    left, right = left[near], right[near]
    keep = prune(values[left], values[right], least) if len(left) else np.zeros(0, dtype=bool)
    left, right = left[keep], right[keep]
    if not len(left):
        return left, right
    same = overlaps(sets, left, right)
    linked = same >= threshold * (sizes[left] + sizes[right] - same)
    return left[linked], right[linked]


def local_classes(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row it is connected to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges that connect the same nodes: each node to its smallest hub, and its other hubs to that one.

    The members of a large group name the same few hubs, so most edges become equal.
    """
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    hubs = edges.join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src != dst")
    return least.withColumnRenamed("least", "dst").unionByName(hubs.distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, text_id, class_id, n_links)`` with one row per row of ``docs``.

    ``text_id`` is the smallest key among rows of equal text, ``class_id`` the smallest key among all rows that are
    connected by equal texts and links, ``n_links`` the number of other texts whose five-word shingles have a Jaccard
    similarity of at least ``threshold``. Words are split at ASCII white space and compared as they are; a text of one to
    four words is a single shingle. Texts without words have no links, equal ones share a class; a row with a null text is
    a class of its own. Repeated rows are copies. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("id"), F.unhex(F.md5(text)).alias("node"), F.col(text).alias("text"))
    told = sketches(rows.where("text IS NOT NULL"))
    nodes = written(told.groupBy("node").agg(F.min("id").alias("first"), F.max("shingles").alias("shingles"), F.max("sketch").alias("sketch")), "sketches")
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", 1 + 4 * BAND_ROWS * b, 4 * BAND_ROWS)) for b in range(BANDS)])
    buckets = nodes.where("shingles > 0").select("node", F.explode(bands).alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "hub")
    edges = buckets.join(hubs, "bucket").where(F.col("node") != F.col("hub")).select("node", "hub").distinct()
    sketch = nodes.select("node", "sketch")
    compared = edges.join(sketch, "node").join(sketch.withColumnsRenamed({"node": "hub", "sketch": "hub_sketch"}), "hub")
    loose, strict = least_matches(LOOSE), least_matches(threshold)

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sketch", "hub_sketch")]
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub")], names=["src", "dst"]).filter(pa.array(prune(*values, loose)))

    groups = connected_components(contracted(written(compared.mapInArrow(plausible, "src binary, dst binary"), "edges")))
    members = groups.join(nodes, "node").select(F.col("node").alias("member"), "component", "first", "sketch")
    held = rows.join(members, (F.col("node") == F.col("member")) & (F.col("id") == F.col("first"))).select("node", "component", "sketch", "text")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("component"), part.column("sketch"), sets], names=["node", "component", "sketch", "shingles"])

    sets = held.mapInArrow(with_sets, "node binary, component binary, sketch binary, shingles binary").dropDuplicates(["node"])

    def verify(table: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, HASHES)
        own = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]  # no copies
        across = table.column("tile_a")[0] != table.column("tile_b")[0]
        left, right = links_in_tiles(table.column("tile").to_numpy(), values, own, across, threshold, strict)
        links = np.bincount(left, minlength=len(own)) + np.bincount(right, minlength=len(own))
        node = table.column("node")
        peers = node.take(pa.array(local_classes(len(own), left, right)))
        return pa.table({"node": node, "peer": peers, "links": links}).filter(pa.array(links > 0))

    tiles = tile_pairs(written(sets, "sets"), "component", "node", TILE)
    found = written(tiles.groupBy("component", "tile_a", "tile_b").applyInArrow(verify, "node binary, peer binary, links long"), "links")
    counted = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = connected_components(found.where(F.col("node") != F.col("peer")).select(F.col("node").alias("src"), F.col("peer").alias("dst")).distinct())
    named = nodes.select("node", "first").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("first").alias("class_id"))
    table = named.join(lowest, "component").join(counted, "node", "left").select("node", F.col("first").alias("text_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.select("id", "node").join(table, "node", "left")
    return out.select(
        F.col("id").alias(key), F.coalesce("text_id", "id").alias("text_id"), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class of near duplicates, the one with the smallest key; repeated rows of that key once.

    Rows with a null key or text are classes of their own and stay.
    """
    classes = near_duplicates(docs, key, text, threshold)
    keep = classes.where(F.col(key) == F.col("class_id")).select(F.col(key).alias("__keep")).distinct()
    alone = docs.where(F.col(key).isNull() | F.col(text).isNull())
    others = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).join(keep, F.col(key) == F.col("__keep")).drop("__keep")
    return others.dropDuplicates([key]).unionByName(alone)
