"""Raw collector records and report output."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RAW_LINE_SCHEMA = "path string, raw_json string"


def _parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with a parsed ``raw`` variant, quarantined lines). Blank lines are dropped."""
    rows = lines.where(F.trim("raw_json") != "").withColumn("raw", F.try_parse_json("raw_json"))
    is_object = F.col("raw").isNotNull() & F.ltrim("raw_json").startswith("{")
    good = rows.where(is_object).select("path", "raw_json", "raw")
    bad = rows.where(~is_object).select("path", "raw_json", F.array(F.lit("not a JSON object")).alias("violations"))
    return good, bad


def json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines of plain or gzip files with their file name."""
    return spark.read.text(paths).select(F.input_file_name().alias("path"), F.col("value").alias("raw_json"))


def read_raw_jsonl(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON-lines logs, plain or gzip: (records, quarantine)."""
    return _parsed(json_lines(spark, paths))


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for name in archive.namelist():
                    if not name.lower().endswith((".json", ".jsonl")):
                        continue
                    with archive.open(name) as member:
                        lines: list[str] = []
                        for line in io.TextIOWrapper(member, encoding="utf-8", errors="replace"):
                            lines.append(line.rstrip("\r\n"))
                            if len(lines) == 10_000:
                                yield pa.RecordBatch.from_pydict({"path": [f"{path}!{name}"] * len(lines), "raw_json": lines})
                                lines = []
                        if lines:
                            yield pa.RecordBatch.from_pydict({"path": [f"{path}!{name}"] * len(lines), "raw_json": lines})


def read_zipped_jsonl(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The same for ``.zip`` archives, one archive per task, streamed in batches of lines."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return _parsed(files.mapInArrow(_unzip, RAW_LINE_SCHEMA))


def with_arrival(df: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """Arrival number ``seq``: position in reading order (file by file, line by line)."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Persist an evaluation or audit result."""
    df.write.mode("overwrite").format(fmt).save(path)
