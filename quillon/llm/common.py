"""What the operators of this subpackage share: shipping code, shared folders, sizes."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Bytes of rows that a Python worker gets at a time: long texts come in smaller batches, not in larger ones.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor, once per application, and bounds the bytes of the session's Arrow batches, unless they are bounded closer."""
    held = re.match(r"\d+", spark.conf.get(_BATCH, None) or "")
    if not held or int(held[0]) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    spark.sparkContext.addPyFile(archive)


def _base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one that the context was given.

    Only on one machine (a local master, as in tests) a temporary folder takes its place where neither is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{_base(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Lets DataFrame.checkpoint() write to the shared folder."""
    _base(spark)


def stored(df: DataFrame, label: str, told: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives the loss of executors.

    The table goes when the application ends, or when discard() is given its path, which is added to told.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    if told is not None:
        told.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """df as a table in the shared folder, bucketed and sorted by a key, read again: joins, windows and aggregates by the key need no shuffle of it. The catalogue keeps no trace of it."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path, name = shared_folder(spark, label), f"{label}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    until_exit(spark, path)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, as they are not the catalogue's
    return table


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    fs, p = _place(spark, path)
    fs.deleteOnExit(p)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        fs, p = _place(spark, path)
        fs.delete(p, True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(total: int, each: int, least: int = 12) -> int:
    """How many parts of about `each` units hold `total`: grows in proportion, so that a part's size does not."""
    return max(least, -(-int(total) // each))


def trim() -> None:
    """Gives freed memory of this process back: Spark's Python workers live on, and share an executor's memory with its other tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a worker keeps between tasks: one thing at a time, so that an operator does not carry the caches of those before it."""
    slot = vars(sys).setdefault("_quillon_kept", {})
    if key not in slot:
        forget()
        slot[key] = make()
    return slot[key]


def forget() -> None:
    """Drops what the worker keeps; operators that keep nothing begin with this."""
    slot = vars(sys).setdefault("_quillon_kept", {})
    if slot:
        slot.clear()
        trim()
