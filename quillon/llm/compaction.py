"""Compaction of small Parquet files: run-length packing into groups, then a merge that keeps the rows' order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, parts_for, shared_folder, ship, stored

#: Rows that a task of digests() goes through.
DIGEST_ROWS = 2 << 20


class Runs:
    """Groups in the order they were opened, neighbours of equal room as one run: first group, how many, room of each."""

    def __init__(self, capacity: int):
        self.capacity, self.groups = capacity, 0
        self.first, self.many, self.room = (np.zeros(0, np.int64) for _ in range(3))

    def place(self, size: int, count: int) -> list[tuple[int, int, int, int]]:
        """Places `count` files of a size, each in the earliest group with room, else in a new one. Sizes come in falling order.

        Gives ranges (start, stop, group, each) over the files' ordinals: `each` at a time go to `group` and those after it. A group takes floor(room / size) files at once, and so does each group of a run.
        """
        out, done = [], 0
        fits = np.flatnonzero(self.room >= size) if size else np.arange(min(len(self.room), 1))
        cuts: list[tuple[int, list[tuple[int, int, int]]]] = []
        for i in fits.tolist():
            if done == count:
                break
            group, many, room = int(self.first[i]), int(self.many[i]), int(self.room[i])
            each = room // size if size else count
            full = min(many, (count - done) // each)
            parts = []
            if full:
                out.append((done, done + full * each, group, each))
                done += full * each
                parts.append((group, full, room - each * size))
            if full < many and done < count:
                out.append((done, count, group + full, count - done))
                parts.append((group + full, 1, room - (count - done) * size))
                full, done = full + 1, count
            if full < many:
                parts.append((group + full, many - full, room))
            cuts.append((i, parts))
        if done < count:
            each = max(1, self.capacity // size) if size else count
            full, rest = divmod(count - done, each)
            parts = []
            if full:
                out.append((done, done + full * each, self.groups, each))
                parts.append((self.groups, full, self.capacity - each * size))
            if rest:
                out.append((count - rest, count, self.groups + full, rest))
                parts.append((self.groups + full, 1, self.capacity - rest * size))
            self.groups += full + (rest > 0)
            cuts.append((len(self.first), parts))
        self._cut(cuts, size)
        return out

    def _cut(self, cuts: list[tuple[int, list[tuple[int, int, int]]]], size: int) -> None:
        """Puts the parts in the places of the runs they come from."""
        table = np.stack([self.first, self.many, self.room])
        whole = [(i, p) for i, p in cuts if len(p) == 1 and i < table.shape[1]]
        if whole:
            table[:, [i for i, _ in whole]] = np.array([p[0] for _, p in whole], np.int64).T
        for i, parts in reversed([(i, p) for i, p in cuts if len(p) != 1 or i >= len(self.first)]):
            table = np.concatenate([table[:, :i], np.array(parts, np.int64).reshape(-1, 3).T, table[:, i + 1 :]], axis=1)
        self.first, self.many, self.room = table


def pack_runs(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, start, stop, group, each) for files given as sizes with how many there are of each: first fit by falling size. Files larger than the capacity have a group of their own."""
    runs, out = Runs(capacity), []
    for size, count in sorted(zip(sizes, counts, strict=True), reverse=True):
        out += [(size, *r) for r in runs.place(size, count)]
    return out


def ordinals(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with `ordinal`, their place from 0 among those with the same `by`, in the order of `order`: from a sort over ranges and the counts of each range, so that no key meets in one task."""
    at, part = "_at", "_part"
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    line = stored(rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn(at, F.monotonically_increasing_id()), "ordinals")
    line = line.withColumn(part, F.shiftright(at, 33))
    spans = line.groupBy(*by, part).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(part)) - F.col("_n")
    spans = spans.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col(part).alias("_of"), "_first", before.alias("_before"))
    same = F.col(part) == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return line.join(spans, same).select(*rows.columns, (F.col("_before") + F.col(at) - F.col("_first")).alias("ordinal"))


def packed(files: DataFrame, family: str, size: str, order: list[str], capacity: int) -> DataFrame:
    """files with `group` (long, from 0 in each family) and `position` (int, from 0 in each group): within a family files by falling size, then by `order`, each join the earliest group that holds at most `capacity` with them, else open one.

    A family reaches one task as its different sizes with how many files have each, never as files. Nulls are a family of their own; no files give no rows.
    """
    ship(files.sparkSession)
    kind, kind_name = files.schema[family].dataType, "family"

    def pack(table: pa.Table) -> pa.Table:
        forget()
        ranges = pack_runs(table.column("size").to_pylist(), table.column("n").to_pylist(), capacity)
        columns = [pa.array(c, pa.int64()) for c in zip(*ranges, strict=True)]
        return pa.table([pa.array([table.column(kind_name)[0].as_py()] * len(ranges), table.schema.field(kind_name).type), *columns], names=[kind_name, "size", "start", "stop", "group", "each"])

    counts = files.groupBy(F.col(family).alias(kind_name), F.col(size).cast("bigint").alias("size")).agg(F.count("*").alias("n"))
    ranges = counts.groupBy(kind_name).applyInArrow(pack, f"{kind_name} {kind.simpleString()}, size bigint, start bigint, stop bigint, group bigint, each bigint").alias("r")
    rows = ordinals(files, [family, size], order).alias("f")
    at, r = F.col("f.ordinal"), lambda c: F.col(f"r.{c}")
    here = F.col(f"f.{family}").eqNullSafe(r(kind_name)) & (F.col(f"f.{size}") == r("size")) & (at >= r("start")) & (at < r("stop"))
    out = rows.join(ranges, here).select(*[F.col(f"f.{c}") for c in files.columns], at.alias("ordinal"), (r("group") + F.floor((at - r("start")) / r("each"))).alias("group"))
    place = F.row_number().over(Window.partitionBy(family, "group").orderBy(F.desc(size), "ordinal")) - 1
    return out.withColumn("position", place).drop("ordinal")


def file_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of a folder's Parquet files: row (a struct of all columns, so that none clashes with the others here), _path, _row (its number in the file) and _bytes (the file's)."""
    rows = spark.read.schema(schema).parquet(folder)
    file = rows.metadataColumn("_metadata")
    return rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("row"), file["file_path"].alias("_path"), file["row_index"].alias("_row"), file["file_size"].alias("_bytes"))


def write_slots(rows: DataFrame, slot: str, slots: int, order: list[Column], folder: str) -> None:
    """Adds a file for each value of slot (0 <= slot < slots) to a folder: the columns of the struct `row`, in the order given. One task streams each file. No rows add no file."""
    some = rows.select(slot).first()
    if some is None:
        return
    # Spark's first task writes a file even without rows, so it gets a slot that has some
    line = rows.repartitionById(slots, F.pmod(F.col(slot) - some[0], F.lit(slots)).cast("int")).sortWithinPartitions(slot, *order).select("row.*")
    line.write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)


def merge(spark: SparkSession, folder: str, schema, plan: DataFrame) -> int:
    """Merges files of a folder by a plan (_path, bytes, slot: the number of the group, position), in place, and gives the number of files that were merged away.

    Rows of a group are written to one new file, by position and then as they stood; its sources are deleted by tasks when all new files are there. Files that the plan
    does not name are neither read (but those no larger than the largest named) nor touched. Until the end a reader would find the merged rows twice.
    """
    largest, slots = plan.agg(F.max("bytes"), F.max("slot")).first()
    if largest is None:
        return 0
    rows = file_rows(spark, folder, schema).where(F.col("_bytes") <= largest).join(plan.select("_path", "slot", "position"), "_path")
    write_slots(rows.select("row", "slot", "position", "_row"), "slot", slots + 1, [F.col("position"), F.col("_row")], folder)
    return deleted(plan.select("_path"))


def deleted(paths: DataFrame) -> int:
    """Deletes files (column _path) and tells how many there were. Tasks delete through Arrow's file systems; where Arrow does not know the store, the driver does, one path at a time.

    A file that is gone already, by a task that ran before, counts as deleted.
    """
    spark = paths.sparkSession
    ship(spark)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            left = []
            for path in b.column(0).to_pylist():
                try:
                    store, name = fs.FileSystem.from_uri(path)
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
                    left.append(path)
                    continue
                folder, _, last = name.rpartition("/")
                for each in (name, f"{folder}/.{last}.crc") if isinstance(store, fs.LocalFileSystem) else (name,):
                    if store.get_file_info(each).type == fs.FileType.File:
                        try:
                            store.delete_file(each)
                        except FileNotFoundError:
                            pass
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([left], pa.list_(pa.string()))], names=["n", "left"])

    done = stored(paths.repartition("_path").mapInArrow(remove, "n bigint, left array<string>"), "deleted")
    for row in done.select(F.explode("left").alias("path")).toLocalIterator():
        p = spark._jvm.org.apache.hadoop.fs.Path(row.path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
    return done.agg(F.sum("n")).first()[0] or 0


def digests(rows: DataFrame) -> DataFrame:
    """(file, n_rows, min_id, max_id, cents, ids_sha256) of files given as rows (file long, at, id long, cents long): ids in the order of `at`, joined by commas, a null id as nothing. Files stream through their tasks, sorted, in batches."""
    ship(rows.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        now, done = None, []

        def row(x):
            return (x[0], x[1], x[2], x[3], x[4], x[5].hexdigest())

        for b in batches:
            if not b.num_rows:
                continue
            files = b.column("file").to_numpy()
            edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if now is None or now[0] != int(files[s]):
                    done += [row(now)] if now else []
                    now = [int(files[s]), 0, None, None, 0, hashlib.sha256()]
                ids = b.column("id").slice(s, e - s)
                text = pc.binary_join(pa.ListArray.from_arrays([0, e - s], pc.fill_null(ids.cast(pa.string()), "")), ",")[0].as_py()
                now[5].update(("," * bool(now[1]) + text).encode())
                now[1] += e - s
                ends = pc.min_max(ids).as_py()
                now[2] = min((x for x in (now[2], ends["min"]) if x is not None), default=None)
                now[3] = max((x for x in (now[3], ends["max"]) if x is not None), default=None)
                cents = b.column("cents").slice(s, e - s).to_numpy()
                now[4] += int(cents.sum()) if float(np.abs(cents).max()) * len(cents) < 2.0**62 else sum(cents.tolist())
            if done:
                yield table(done)
                done = []
        if now:
            yield table([row(now)])

    def table(done: list[tuple]) -> pa.RecordBatch:
        fits = lambda x: x if x is None or -(1 << 63) <= x < 1 << 63 else None
        columns = [pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()), pa.array([r[2] for r in done], pa.int64()), pa.array([r[3] for r in done], pa.int64()), pa.array([fits(r[4]) for r in done], pa.int64()), pa.array([r[5] for r in done])]
        return pa.RecordBatch.from_arrays(columns, names=["file", "n_rows", "min_id", "max_id", "cents", "ids_sha256"])

    return rows.sortWithinPartitions("file", "at").mapInArrow(digest, "file bigint, n_rows bigint, min_id bigint, max_id bigint, cents bigint, ids_sha256 string")


class ClickFiles:
    """Where the files of a table of clicks start, by the day of arrival and a checksum of the id, and how large they may get, as shares of the table's rows.

    A null arrival is a day of its own (null), a null id is an empty text. The table's rows are counted once, by day.
    """

    def __init__(self, rows: DataFrame, lots: int = 150):
        days = rows.groupBy(self.day().alias("_day")).agg(F.count("*").alias("_rows"))
        self.days = stored(days, "days")
        self.rows = self.days.agg(F.sum("_rows")).first()[0] or 0
        many = 1 + F.floor(F.col("_rows") / self.share(lots))
        self.days = stored(self.days.select("_day", many.alias("_lots"), (4 * (F.sum(many).over(Window.orderBy("_day")) - many)).cast("int").alias("_base")), "days")  # a row for each day, however many rows
        self.slots = 4 * (self.days.agg(F.sum("_lots")).first()[0] or 0)

    def share(self, x: int) -> int:
        return 1 + self.rows // x

    @staticmethod
    def day() -> Column:
        return F.datediff(F.col("arrived_at").cast("date"), F.lit("1970-01-01").cast("date"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (with arrived_at and click_id) and their _day, _lot, _piece and _slot, a number for each such file."""
        h = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary"))
        rows = rows.withColumns({"_on": self.day(), "_h": h}).join(self.days, F.col("_on").eqNullSafe(F.col("_day")))
        lot, piece = F.floor(F.col("_h") / 16) % F.col("_lots"), F.least(F.col("_h") % 4, F.floor(F.col("_h") / 4) % 4)
        rows = rows.withColumns({"_lot": lot.cast("bigint"), "_piece": piece.cast("bigint")})
        return rows.withColumn("_slot", (F.col("_base") + 4 * F.col("_lot") + F.col("_piece")).cast("int")).drop("_on", "_lots", "_base", "_h")


def compact_clicks(rows: DataFrame, folder: str, lots: int = 150, small: int = 600, full: int = 400) -> DataFrame:
    """Writes a table of clicks as files by day, lot and piece into a new folder and merges its small files there; gives a row for each file that is left.

    A table without rows gives none and no folder. Rows that are equal in arrived_at and click_id stand in the order of their other columns; equal rows are all kept.
    Columns of any name stay as they are, in their order. Fewer than 1/small of the rows make a file small; a group holds at most 1/full of them.
    """
    spark = rows.sparkSession
    ship(spark)
    names, schema = rows.columns, rows.schema
    columns = {"day": "bigint", "lot": "bigint", "piece": "bigint", "n_rows": "bigint", "min_click_id": "bigint", "max_click_id": "bigint", "cents": "bigint", "sources": "string", "ids_sha256": "string", "columns": "string", "path": "string", "rewritten": "boolean"}
    place = ClickFiles(rows, lots)
    if not place.rows:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items()))
    both = [F.col("row.arrived_at").alias("arrived_at"), F.col("row.click_id").alias("click_id")]
    ties = [F.col(f"row.`{c}`") for c in names if schema[c].dataType.typeName() not in ("map", "variant")]
    write_slots(place.placed(rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).select("row", *both)), "_slot", place.slots, [F.col("arrived_at"), F.col("click_id"), *ties], folder)

    def listed() -> DataFrame:
        """The folder's files: path, bytes, row count, and the day, lot, piece and slot of their first rows."""
        each = place.placed(file_rows(spark, folder, schema).select("_path", "_row", "_bytes", *both)).groupBy("_path")
        return each.agg(F.max("_bytes").alias("bytes"), F.count("*").alias("n"), *[F.max(F.when(F.col("_row") == 0, F.col(f"_{c}"))).alias(c) for c in ("day", "lot", "piece", "slot")])

    files = stored(listed(), "files")
    share = place.share
    groups = packed(files.where(F.col("n") < share(small)), "day", "n", ["lot", "piece"], share(full))
    own = Window.partitionBy("day", "group")
    plan = stored(groups.withColumns({"many": F.count("*").over(own), "first": F.min(F.struct("position", "slot")).over(own)["slot"]}), "plan")
    several = plan.where("many > 1")
    numbers = ordinals(several.where("position = 0").select("first"), [], ["first"]).withColumnRenamed("ordinal", "slot")
    merge(spark, folder, schema, stored(several.join(numbers, "first").select("_path", "bytes", numbers["slot"], "position"), "merges"))

    name = F.concat_ws("-", "lot", "piece")
    sources = plan.groupBy(F.col("first").alias("slot")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", name.alias("name")))), lambda x: x["name"]).alias("names"))
    final = listed().join(sources, "slot", "left").select("_path", "day", "lot", "piece", F.col("slot").cast("bigint").alias("file"), F.coalesce(F.array_join("names", ","), name).alias("sources"), F.coalesce(F.size("names") > 1, F.lit(False)).alias("rewritten"))
    final = stored(final, "final")
    value = F.col("row.value").cast("double") if "value" in names else F.lit(None).cast("double")
    cents = F.coalesce(F.when(F.abs(value) < 9e16, F.floor(100 * value + 0.5).cast("bigint")), F.lit(0).cast("bigint"))
    lines = file_rows(spark, folder, schema).select("_path", "_row", F.col("row.click_id").cast("bigint").alias("id"), cents.alias("cents")).join(final.select("_path", "file"), "_path")
    lines = lines.select("file", F.col("_row").alias("at"), "id", "cents").repartition(parts_for(place.rows, DIGEST_ROWS), "file")
    out = digests(lines).join(final, "file").withColumns({"columns": F.lit(",".join(spark.read.parquet(folder).columns))})
    return out.select(F.col("day").cast("bigint").alias("day"), "lot", "piece", "n_rows", F.col("min_id").alias("min_click_id"), F.col("max_id").alias("max_click_id"), "cents", "sources", "ids_sha256", "columns", F.col("_path").alias("path"), "rewritten")


def op12_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_clicks(spark.read.parquet(f"{sf_dir}/clicks.parquet"), shared_folder(spark, "clicks"))
