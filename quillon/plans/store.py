"""The eight tables as Parquet snapshots: batches become visible by a manifest written last."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import new_rows
from ..operators.search import TrigramIndex
from ..operators.spatial import z_order
from ..schemas import KEYS, REQUIRED, TABLES, struct


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only with a local master, where it may be unset, a temporary one takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def kept(rows: DataFrame, folder: str, row_group: int = 32 << 20) -> Iterator[DataFrame]:
    """rows as Parquet below a shared folder, computed once and read as often as need be; the files go at the end of the block.

    For nested records this takes the place of persist(): Spark reads a block of its cache that lies on disk or on another executor as Java objects, of which up to 100 batches
    of 10,000 rows each stay in memory for each task, and each table's scan holds whole records. Files are read a few thousand rows at a time, and only the fields asked for.
    """
    spark, path = rows.sparkSession, f"{folder}/kept-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        rows.write.option("parquet.block.size", row_group).parquet(path)
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def within(ranges: dict[str, tuple]) -> Column:
    """The condition that columns lie in ranges (low, high), ends included and None for an open one."""
    out = F.lit(True)
    for c, (low, high) in ranges.items():
        out = out if low is None else out & (F.col(c) >= low)
        out = out if high is None else out & (F.col(c) <= high)
    return out


def clustered(rows: DataFrame, path: str, order: list[str], files: int, bloom: list[str] = (), curve: bool = False, row_group: int = 8 << 20) -> None:
    """Writes rows sorted by columns over files, with bloom filters for some. curve: numeric columns count alike, as bits in turn of their places among 64 quantiles (Z-order), so that
    ranges of any of them, and of several more so, leave most row groups out; in plain order only the first column's do. NULLs stand with the least."""
    if curve:
        cuts = rows.approxQuantile(order, [k / 64 for k in range(1, 64)], 0.002)
        under = lambda c, q: F.size(F.filter(F.lit(sorted(set(q))), lambda x: x <= F.col(c))) if q else F.lit(0)
        place = [F.when(F.col(c).isNull(), 0).otherwise(under(c, q)) for c, q in zip(order, cuts, strict=True)]
        rows = rows.withColumn("_z", z_order(place, 6))
    keys = ["_z", *order] if curve else order
    rows = rows.repartitionByRange(files, *[F.col(c) for c in keys]).sortWithinPartitions(*keys).drop("_z")
    rows.write.options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}).option("parquet.block.size", row_group).parquet(path)


class Store:
    """Tables below a folder of any Hadoop file system. Each batch writes the new rows of each table below batch=<id>; a line of the manifest names it when all are there.

    A batch that fails leaves files that no manifest names, so it leaves no rows. A batch id that the manifest has is not loaded again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[dict]:
        """The published batches in order: id, path and the rows added to each table."""
        fs, p = self._fs(f"{self.root}/_manifest")
        if not fs.exists(p):
            return []
        return [json.loads(self._text(fs, s.getPath())) for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().toString())]

    def _text(self, fs, path) -> str:
        """A small file, read by the driver."""
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _tell(self, path: str, what: dict) -> None:
        """Writes a small file; fails if it is there."""
        fs, p = self._fs(path)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()

    def table(self, name: str, batches: list[dict] | None = None) -> DataFrame:
        """All published rows of a table, or those of some batches."""
        paths = [f"{b['path']}/{name}" for b in (self.batches() if batches is None else batches)]
        if not paths:
            return self.spark.createDataFrame([], struct(name))
        return self.spark.read.schema(struct(name)).parquet(*paths)

    def unseen(self, files: DataFrame) -> DataFrame:
        """Those of some files (path, length, changed) that no published batch was loaded from."""
        paths = [f"{b['path']}/files" for b in self.batches() if b.get("files")]
        return files.join(self.spark.read.schema(files.schema).parquet(*paths), files.columns, "left_anti") if paths else files

    def load(self, batch: str, tables: dict[str, DataFrame], nulls_distinct: bool = False, files: DataFrame | None = None, bounds: dict[str, tuple] | None = None) -> dict[str, int]:
        """Adds the rows of a batch whose keys are new, and tells how many of each table; nothing if the batch was loaded before. The files that it comes from are written beside it, for unseen().

        bounds: for some tables the least and largest first key column that their rows can have, so that these are not read for it. Of several rows of a key the first by file and line is kept where the tables say where rows come from (_at), else the first by all columns.
        """
        done = self.batches()
        if any(b["id"] == batch for b in done):
            return dict.fromkeys(TABLES, 0)
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        added, held = {}, {}
        for name in TABLES:
            order = [F.col("_at")] if "_at" in tables[name].columns else None
            old = self.touched(name, done, tables[name], (bounds or {}).get(name))
            fresh = new_rows(self.table(name, old) if old else None, tables[name], KEYS[name], REQUIRED[name], order, nulls_distinct)
            options = {f"parquet.bloom.filter.enabled#{REQUIRED[name][0]}": "true"}
            fresh.select(*struct(name).fieldNames()).write.options(**options).parquet(f"{path}/{name}")
            lead = F.col(REQUIRED[name][0])
            added[name], *held[name] = self.spark.read.schema(struct(name)).parquet(f"{path}/{name}").agg(F.count("*"), F.min(lead), F.max(lead)).first()
        if files is not None:
            files.write.parquet(f"{path}/files")
        self._tell(f"{self.root}/_manifest/{len(done):08d}.json", {"id": batch, "path": path, "added": added, "bounds": held, "files": files is not None})  # fails if another writer was faster
        return added

    def touched(self, name: str, batches: list[dict], staged: DataFrame, bounds: tuple | None = None) -> list[dict]:
        """The batches that may hold a key of some staged rows: those whose bounds of the first key column, which the manifest has, meet the staged ones. The others are not read in a load.

        Ids grow with time, so a load meets the few batches of its own time, however many there are.
        """
        known = [b for b in batches if b["added"].get(name)]
        if not known:
            return []
        lead = F.col(REQUIRED[name][0])
        low, high = bounds or staged.agg(F.min(lead), F.max(lead)).first()
        if low is None:
            return []
        return [b for b in known if not b.get("bounds", {}).get(name) or (b["bounds"][name][0] <= high and low <= b["bounds"][name][1])]

    def text_index(self, name: str, column: str, key: str = "id") -> TrigramIndex:
        """The trigram postings of a text column, brought up to date: batches that have none get theirs, the others are not read."""
        index = TrigramIndex(self.spark, f"{self.root}/trigrams/{name}.{column}")
        for b in self.batches():
            index.add(b["path"].rpartition("/")[2], self.table(name, [b]), key, column)
        return index

    def find_text(self, name: str, column: str, text: str, kind: str = "contains", ignore_case: bool = True, key: str = "id") -> DataFrame:
        """Rows of a table whose text column holds a text, by the postings."""
        return self.text_index(name, column, key).search(self.table(name), key, column, text, kind, ignore_case)

    def compact(self, name: str, order: list[str], files: int, bloom: list[str] = (), curve: bool = False) -> str:
        """Rewrites a table clustered by columns, with Parquet bloom filters for look-ups, and gives its path: what an index is elsewhere. curve: by all columns alike, see clustered()."""
        path, done = f"{self.root}/clustered/{name}-{uuid.uuid4().hex}", self.batches()
        clustered(self.table(name, done), path, order, files, bloom, curve)
        self._tell(f"{self.root}/_layout/{uuid.uuid4().hex}.json", {"table": name, "order": order, "files": files, "bloom": list(bloom), "curve": curve, "path": path, "batches": len(done)})
        return path

    def find(self, name: str, ranges: dict[str, tuple]) -> DataFrame:
        """Rows of a table whose columns lie in ranges (low, high), ends included and None for an open one. They come from the clustered copy that serves most of the columns, and from the batches that were loaded after it."""
        done, best = self.batches(), (0, 0, None)
        for x in self.layouts():
            if x["table"] == name:
                serves = sum(c in ranges for c in x["order"]) if x.get("curve") else int(x["order"][0] in ranges)
                best = max(best, (serves, x["batches"], x["path"]), key=lambda b: b[:2])
        rows = self.table(name, done)
        if best[0]:
            rows = self.spark.read.schema(struct(name)).parquet(best[2])
            if done[best[1] :]:
                rows = rows.unionByName(self.table(name, done[best[1] :]))
        return rows.where(within(ranges))

    def layouts(self) -> list[dict]:
        """What compact() has written: table, order, files, bloom, path and the number of batches that it holds."""
        fs, p = self._fs(f"{self.root}/_layout")
        return [json.loads(self._text(fs, s.getPath())) for s in fs.listStatus(p)] if fs.exists(p) else []
