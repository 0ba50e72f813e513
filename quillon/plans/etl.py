"""Archive to tables: read, parse, flatten, merge, report."""

from __future__ import annotations

import platform
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flatten import flatten, lead_bounds, losses
from ..operators.relational import counts, dangling
from ..schemas import REFERENCES, TABLES
from ..sources.archive import found, is_accepted, is_reject, lines, parsed
from .store import Store, kept


def ingest(spark: SparkSession, path: str, store: Store, batch: str | None = None, pattern: str = "*.jsonl.gz") -> dict:
    """Loads the files of a folder that the store has not seen as one batch: files, lines, rejected lines, values lost in coercion, rows added to each table, seconds and lines a second.

    A file is known by path, length and time of change, so that a folder may grow, and a file that was written anew is read again; what it repeats adds nothing.
    A batch that has a name is loaded once under it, with all files that match. Records are parsed once and kept, below the store, while the eight tables are merged. Malformed lines are counted, not fatal.
    """
    began, n, bad, lost, added = time.time(), 0, 0, {}, dict.fromkeys(TABLES, 0)
    known = batch is not None and any(b["id"] == batch for b in store.batches())
    files = found(spark, path, pattern)
    if batch is None:
        files = store.unseen(files)
    listed = [] if known else files.collect()  # a file that comes from now on is for the next load
    if listed:
        files = spark.createDataFrame(listed, files.schema)
        rows = parsed(lines(spark, [r.path for r in listed], None)).drop("value")
        with kept(rows, f"{store.root}/_kept") as records:
            # whatever is to be known of the records before the merge comes from one pass
            ends = {name: [c.alias(f"{end} {name}") for end, c in zip(("low", "high"), b, strict=True)] for name, b in lead_bounds().items()}
            told = records.agg(F.count("*").alias("lines"), F.count_if(is_reject()).alias("rejected"), *(c for b in ends.values() for c in b), *losses(is_accepted())).first().asDict()
            n, bad = told.pop("lines"), told.pop("rejected")
            bounds = {name: (told.pop(f"low {name}"), told.pop(f"high {name}")) for name in ends}
            lost = told
            added = store.load(batch or f"{path}#{uuid.uuid4().hex}", flatten(records, placed=True), files=files, bounds=bounds)
    seconds = time.time() - began
    return {"files": len(listed), "lines": n, "rejected": bad, "lost": lost, "added": added, "seconds": seconds, "lines_per_second": n / seconds}


def table_counts(store: Store) -> DataFrame:
    return counts({name: store.table(name) for name in TABLES})


def dangling_references(tweets: DataFrame) -> DataFrame:
    """One row: tweets whose reply, quote or retweet parent is not among them."""
    refs = {"replies_without_parent": "in_reply_to_status_id", "quotes_without_parent": "quoted_status_id", "retweets_without_parent": "retweeted_status_id"}
    return dangling(tweets, {name: (column, tweets, "id") for name, column in refs.items()})


def foreign_key_audit(store: Store) -> DataFrame:
    """(child, reference, dangling): rows of each declared reference without a parent."""
    out = None
    for child, column, parent, key, _ in REFERENCES:
        row = dangling(store.table(child), {"dangling": (column, store.table(parent), key)}).select(F.lit(child).alias("child"), F.lit(column).alias("reference"), "dangling")
        out = row if out is None else out.unionByName(row)
    return out


def system_info(spark: SparkSession) -> dict[str, str]:
    return {"os": f"{platform.system()} {platform.release()}", "machine": platform.machine(), "python": platform.python_version(), "spark": spark.version, "cores": str(spark.sparkContext.defaultParallelism)}
