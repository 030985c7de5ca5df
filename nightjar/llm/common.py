"""Reading tables, cutting lineage in the shared folder, and tiles for groups that may be hot."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightjar.session import ensure_checkpoint_dir, prepare

# Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark alone, so that the path may lie in any store."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one intermediate table below ``spark.checkpoint.dir``, one parent per application."""
    return f"{ensure_checkpoint_dir(spark)}/nightjar-{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; lost executors don't lose it. ``options`` go to the writer."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes the shuffle files of each query when it has ended, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``written`` made and nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(folder))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Let the driver collect garbage, on which Spark removes the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names the operator is about to give out itself (in any letter case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def word_count(text: Column) -> Column:
    """Number of words of the whole text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def tile_pairs(members: DataFrame, key: str, member: str, tile_rows: int, least: str | None = None) -> DataFrame:
    """Deal every group of two or more members into pairs of tiles, so that any two members meet in a bounded task.

    A group of n members is hashed into ``ceil(n / tile_rows)`` tiles. Each member is copied to the pairs that its
    tile forms with every tile of the group; two members of different tiles meet in exactly one pair, two members of
    one tile meet in the pair of the tile with itself and in no other comparison, as the caller skips pairs from
    equal tiles elsewhere. Adds ``tile``, ``tile_a`` and ``tile_b``; groups of one member are left out. ``least`` names a
    column with the smallest member of a group that is not split, null in others.
    """
    smallest = [F.when(F.count(F.lit(1)) <= tile_rows, F.min(member)).alias(least)] if least else []
    counts = members.groupBy(key).agg(F.count(F.lit(1)).alias("__members"), *smallest).where("__members > 1")
    tiles = F.ceil(F.col("__members") / tile_rows).cast("int")
    dealt = members.join(counts, key).withColumn("__tiles", tiles)
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(F.lit(11), F.col(member)), F.col("__tiles")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    return (
        dealt.withColumn("tile_a", F.least("tile", "__other")).withColumn("tile_b", F.greatest("tile", "__other"))
        .drop("__members", "__tiles", "__other")
    )


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Runs of rows with equal keys, as lists per column, from rows that arrive sorted by the keys.

    For many small groups of bounded size this costs far less than a data frame per group.
    """
    held: dict[str, list] = {}
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        marks = list(zip(*[columns[k] for k in keys], strict=True))
        start = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[start]:
                part = {name: values[start:i] for name, values in columns.items()}
                if held and tuple(held[k][0] for k in keys) == marks[start]:
                    for name, values in part.items():
                        held[name].extend(values)
                else:
                    if held:
                        yield held
                    held = part
                start = i
    if held:
        yield held
