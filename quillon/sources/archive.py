"""Compressed JSON-lines archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import utf8_without_errors
from ..schemas import RAW


def found(spark: SparkSession, path: str, pattern: str = "*.jsonl.gz") -> DataFrame:
    """(path, length, changed) of the files that match; their contents are not read. A folder without any gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("changed"))


def lines(spark: SparkSession, path: str | list[str], pattern: str | None = "*.jsonl.gz", partitions: int | None = None) -> DataFrame:
    """(file, line, value): the lines of all files that match, blank ones left out; bytes that aren't UTF-8 vanish. line grows within a file.

    A gzip file is read by one task, so where there are fewer files than cores, or `partitions` is given, lines are dealt out again before they are parsed.
    """
    reader = spark.read if pattern is None else spark.read.option("pathGlobFilter", pattern)
    files = reader.text(path)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), utf8_without_errors(F.col("value")).alias("value")).where(F.trim("value") != "")
    cores = max(spark.sparkContext.defaultParallelism, 1)
    if partitions is None and len(files.inputFiles()) >= cores:
        return rows
    return rows.repartition(partitions or cores)


def parsed(rows: DataFrame, column: str = "value") -> DataFrame:
    """The column record (RAW) beside the rows' own; a field of the wrong type becomes NULL, and the line stays in record._corrupt."""
    return rows.withColumn("record", F.from_json(column, RAW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def rejects(records: DataFrame) -> DataFrame:
    """Lines that are no object with an id."""
    return records.where(is_reject())


def is_reject() -> Column:
    return F.col("record._corrupt").isNotNull() & F.col("record.id").isNull()


def accepted(records: DataFrame) -> DataFrame:
    """Lines whose id is an integer."""
    return records.where(is_accepted())


def is_accepted() -> Column:
    return F.trim(F.col("record.id")).try_cast("bigint").isNotNull()
