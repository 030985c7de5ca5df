"""Merkle manifest of a dataset by nested-struct rollup.

Rows become leaf digests, ranked inside their source. The rank is written in base 16: all digits but the last two name a
block of at most 256 leaves, and the two digits are grouped away one after the other, each time nesting the children
with their digests in the parent's struct. The block digests are the leaves of the next round, until every source has
one digest, its subroot; the subroots are rolled up in the same way to the root. No task ever holds more than one block.

On the way back a block meets the path of its own digest by one union and grouping on the block's key, and a transform
and explode of the nested structs gives every child its siblings and its path: no leaf is joined with anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from nightjar.llm.common import written
from nightjar.operators.ordered import BLOCK, order_blocks

FAN_OUT = 16  # fixed value of the contract
DIGITS = 2  # digits grouped away per round: a block has FAN_OUT ** DIGITS leaves
PATH_TYPE = "array<struct<left:string,right:string>>"
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sealed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return sealed(*[framed(text if name == "text" else F.col(name)) for name in LEAF_FIELDS])


def source_key(source: Column) -> Column:
    """A key that is never null and sorts null first, then bytewise."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), source))


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0, inside ``key``) and ``n`` (rows of the key), without one task per key.

    Rows are range-partitioned on (key, order). Only keys that cross a border between two partitions need to know about
    other partitions; there are fewer such (partition, key) pairs than twice the partitions, whatever the data.
    """
    laid = order_blocks(rows.withColumn("__tie", F.rand(12)), [key], [*order, "__tie"])
    parts = laid.groupBy(BLOCK, key).agg(F.count(F.lit(1)).alias("__rows"))
    own = Window.partitionBy(key)
    crossing = parts.select(
        BLOCK, key, F.count(F.lit(1)).over(own).alias("__parts"), F.sum("__rows").over(own).alias("__all"),
        F.coalesce(F.sum("__rows").over(own.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    ).where("__parts > 1").drop("__parts")
    local = Window.partitionBy(BLOCK, key)
    counted = laid.join(F.broadcast(crossing), [BLOCK, key], "left")
    place = F.row_number().over(local.orderBy(*order, "__tie")) - 1 + F.coalesce("__before", F.lit(0))
    rows_of_key = F.coalesce("__all", F.count(F.lit(1)).over(local))
    return counted.withColumns({"rank": place.cast("long"), "n": rows_of_key.cast("long")}).drop(BLOCK, "__all", "__before", "__tie")


def nodes_left(n: Column, level: int) -> Column:
    """Nodes of a tree with ``n`` leaves after ``level`` groupings."""
    return F.ceil(n / (FAN_OUT ** level))


def roll_up(nodes: DataFrame) -> DataFrame:
    """``(tree, rank, n, digest, item)`` to one row per block: ``(tree, rank, n, digest, children)``, children nested.

    A level of one node is not grouped again: it is its tree's end and passes through as it is.
    """
    digit = lambda i: F.pmod(F.floor(F.col("rank") / (FAN_OUT ** i)), F.lit(FAN_OUT)).cast("int")
    rows = nodes.select("tree", "n", F.floor(F.col("rank") / (FAN_OUT ** DIGITS)).alias("block"), *[digit(i).alias(f"d{i}") for i in range(DIGITS)],
                        "digest", "item").repartition("tree", "block")
    kept = F.struct("digest", "item")
    for i in range(DIGITS):
        child = F.struct(F.col(f"d{i}").alias("place"), F.col("digest"), F.col("kept"))
        rows = rows.select("*", kept.alias("kept")).groupBy("tree", "block", "n", *[f"d{j}" for j in range(i + 1, DIGITS)]).agg(
            F.array_sort(F.collect_list(child), lambda a, b: a["place"] - b["place"]).alias("children"))
        only = F.col("children")[0]["digest"]
        rows = rows.withColumn("digest", F.when(nodes_left(F.col("n"), i) > 1, F.sha2(F.array_join("children.digest", ""), 256)).otherwise(only))
        kept = F.col("children")
    return rows.select("tree", F.col("block").alias("rank"), nodes_left(F.col("n"), DIGITS).cast("long").alias("n"), F.col("n").alias("below"), "digest", "children")


def hand_down(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """``(tree, item, rank, digest, path, ends)`` of every child, from blocks and the ``(tree, rank, path, ends)`` of their digests.

    ``path`` holds the siblings left and right of a node per level, upward; a level that passed through adds none.
    """
    none = blocks.schema["children"].dataType
    met = blocks.select("tree", "rank", "below", "children", F.lit(None).cast(PATH_TYPE).alias("path"), F.lit(None).cast("array<string>").alias("ends")).unionByName(
        paths.select("tree", "rank", F.lit(None).cast("long").alias("below"), F.lit(None).cast(none).alias("children"), "path", "ends"))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    rows = met.groupBy("tree", "rank").agg(*[first(c) for c in ("below", "children", "path", "ends")]).where("children IS NOT NULL")
    rows = rows.withColumn("place", F.col("rank"))
    for i in reversed(range(DIGITS)):
        digests = F.col("children.digest")
        side = lambda at, size, d=digests: F.array_join(F.slice(d, at, size), "")
        step = F.when(nodes_left(F.col("below"), i) > 1, F.array(F.struct(
            F.when(F.col("i") > 0, side(F.lit(1), F.col("i"))).otherwise("").alias("left"), side(F.col("i") + 2, F.lit(FAN_OUT)).alias("right"))))
        rows = rows.select("*", F.posexplode("children").alias("i", "child"))
        rows = rows.select("tree", "below", "ends", (F.col("place") * FAN_OUT + F.col("child.place")).alias("place"), F.col("child.digest").alias("digest"),
                           F.concat(F.coalesce(step, F.array().cast(PATH_TYPE)), F.col("path")).alias("path"), F.col("child.kept").alias("children"))
    return rows.select("tree", F.col("place").alias("rank"), F.col("children.item").alias("item"), "digest", "path", "ends")


def grow(nodes: DataFrame, purpose: str) -> list[DataFrame]:
    """Written tables of all rounds, until every tree is one row."""
    rounds = []
    while True:
        nested = written(roll_up(nodes), purpose)
        rounds.append(nested)
        if (nested.agg(F.max("n").alias("n")).first()["n"] or 0) <= 1:
            return rounds
        nodes = nested.select("tree", "rank", "n", "digest", F.lit(None).cast("string").alias("item"))


def descend(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    for nested in reversed(rounds):
        paths = hand_down(nested, paths)
    return paths


@dataclass
class Manifest:
    """``leaves`` (id, tampered leaf, leaf, subroot, root, path), ``subroots`` (source key, digest) and ``root`` (one row, or none)."""

    leaves: DataFrame
    subroots: DataFrame
    root: DataFrame


def manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """Merkle tree over all rows of ``docs`` (columns doc_id, source, lang, n_chars, text).

    Every row is a leaf, repeated rows and null ids too (null ids come first in their source; rows of equal id are
    ordered by digest, so equal rows are interchangeable). A null source is a source of its own and comes first. Nulls
    and empty texts have unlike digests. ``tampered`` names the rows whose text gets its A-Z lower-cased in
    ``tampered_leaf``, which is null elsewhere. An empty table has no leaves, subroots or root. Other columns are ignored.
    """
    forged = F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(F.translate("text", UPPER, LOWER))) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col("doc_id"), source_key(F.col("source")).alias("tree"), leaf_digest(F.col("text")).alias("digest"), forged.alias("tampered_leaf"))
    placed = ranked(leaves, "tree", ["doc_id", "digest"])
    trees = grow(placed.select("tree", "rank", "n", "digest", F.struct("doc_id", "tampered_leaf").alias("item")), "merkle")
    subroots = trees[-1].select("tree", "digest")
    top = ranked(subroots.select(F.lit("").alias("whole"), "tree", "digest"), "whole", ["tree"])
    crown = grow(top.select(F.col("whole").alias("tree"), "rank", "n", "digest", F.col("tree").alias("item")), "merkle-top")
    root = crown[-1].select(F.col("digest").alias("root"))
    empty = F.array().cast(PATH_TYPE)
    ends = descend(crown, crown[-1].select("tree", "rank", empty.alias("path"), F.array("digest").alias("ends")))
    starts = ends.select(F.col("item").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", F.concat(F.array("digest"), F.col("ends")).alias("ends"))
    below = descend(trees, written(starts, "merkle-paths"))
    out = below.select("item.doc_id", "item.tampered_leaf", F.col("digest").alias("leaf"), F.col("ends")[0].alias("subroot"), F.col("ends")[1].alias("root"), "path")
    return Manifest(out, subroots, root)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda node, step: sealed(step["left"], node, step["right"]))


def proof_digest(path: Column) -> Column:
    """One digest over all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
