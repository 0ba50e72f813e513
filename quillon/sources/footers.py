"""What Parquet files say of themselves: row groups and pages with their bounds, read by tasks from the ends of files."""

from __future__ import annotations

import datetime
import decimal
import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = "file STRING, row_group INT, row_count BIGINT, column STRING, bytes BIGINT, low STRING, high STRING"
PAGES = "file STRING, row_group INT, column STRING, page INT, first_row BIGINT, row_count BIGINT, bytes BIGINT, nulls BIGINT, low STRING, high STRING"
#: Fixed values of the format: numbers of the fields that lead to the pages (in a file's end, a row group and a column chunk).
ROW_GROUPS, COLUMNS, OFFSET_INDEX, COLUMN_INDEX = 4, 1, (4, 5), (6, 7)


class _Compact:
    """Reads structures in Thrift's compact form as {field number: value}."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def unsigned(self) -> int:
        value = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    def signed(self) -> int:
        v = self.unsigned()
        return (v >> 1) ^ -(v & 1)

    def value(self, kind: int):
        if kind in (4, 5, 6):
            return self.signed()
        if kind in (1, 2, 3, 7):
            n = 8 if kind == 7 else 1
        elif kind == 8:
            n = self.unsigned()
        elif kind in (9, 10):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 < 15 else self.unsigned()
            return [self.value(head & 15) for _ in range(n)]
        elif kind == 12:
            return self.structure()
        else:
            raise ValueError(f"no type {kind}")
        self.at += n
        told = self.data[self.at - n : self.at]
        return told == b"\x01" if kind < 3 else told

    def structure(self) -> dict:
        out, number = {}, 0
        while head := self.data[self.at]:
            self.at += 1
            number = number + (head >> 4) if head >> 4 else self.signed()
            kind = head & 15
            out[number] = kind == 1 if kind < 3 else self.value(kind)
        self.at += 1
        return out


def _told(column: pq.ColumnSchema) -> Callable[[bytes], str | None]:
    """How a column's bounds are put into text: as Spark casts such values, and bytes that are no text in hexadecimal."""
    kind, logical = column.physical_type, json.loads(column.logical_type.to_json())
    name = logical["Type"]
    number = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}.get(kind)
    if name == "Date":
        return lambda b: str(datetime.date(1970, 1, 1) + datetime.timedelta(days=struct.unpack("<i", b)[0]))
    if name == "Timestamp" and logical["timeUnit"] in ("milliseconds", "microseconds"):
        return lambda b: str(datetime.datetime(1970, 1, 1) + datetime.timedelta(**{logical["timeUnit"]: struct.unpack("<q", b)[0]}))
    if name == "Decimal":
        whole = (lambda b: struct.unpack(number, b)[0]) if number else (lambda b: int.from_bytes(b, "big", signed=True))
        return lambda b: str(decimal.Decimal(whole(b)).scaleb(-logical["scale"]))
    if name == "Int" and not logical["isSigned"]:
        return lambda b: str(int.from_bytes(b, "little"))
    if number:
        return lambda b: str(struct.unpack(number, b)[0])
    if kind == "BOOLEAN":
        return lambda b: "true" if b[0] else "false"
    return (lambda b: b.decode("utf-8", "replace")) if name in ("String", "Enum", "JSON") else (lambda b: b.hex())


def _groups(f: pa.NativeFile, file: str) -> Iterator[dict]:
    told = pq.ParquetFile(f).metadata
    for g in range(told.num_row_groups):
        group = told.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            s, text = chunk.statistics, _told(told.schema.column(c))
            low, high = (text(_raw(s.min_raw, told.schema.column(c))), text(_raw(s.max_raw, told.schema.column(c)))) if s is not None and s.has_min_max else (None, None)
            yield {"file": file, "row_group": g, "row_count": group.num_rows, "column": chunk.path_in_schema, "bytes": chunk.total_compressed_size, "low": low, "high": high}


def _raw(v, column: pq.ColumnSchema) -> bytes:
    """The bytes of a bound that Arrow gives as a value."""
    form = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d", "BOOLEAN": "<?"}.get(column.physical_type)
    return v.encode() if isinstance(v, str) else v if form is None else struct.pack(form, v) if not (form in ("<i", "<q") and v >= 1 << (8 * struct.calcsize(form) - 1)) else v.to_bytes(struct.calcsize(form), "little")


def _pages(f: pa.NativeFile, file: str) -> Iterator[dict]:
    size = f.size()
    n = struct.unpack("<I", f.read_at(4, size - 8))[0]
    groups = _Compact(f.read_at(n, size - 8 - n)).structure()[ROW_GROUPS]
    told = pq.ParquetFile(f).metadata
    for g, group in enumerate(groups):
        rows = told.row_group(g).num_rows
        for c, chunk in enumerate(group[COLUMNS]):
            where, bounds = ([chunk.get(k) for k in pair] for pair in (OFFSET_INDEX, COLUMN_INDEX))
            if None in where:
                continue
            places = _Compact(f.read_at(where[1], where[0])).structure()[1]
            index = _Compact(f.read_at(bounds[1], bounds[0])).structure() if None not in bounds else {}
            text, firsts = _told(told.schema.column(c)), [*(p[3] for p in places), rows]
            for k, p in enumerate(places):
                held = index and not index[1][k]
                yield {
                    "file": file, "row_group": g, "column": told.schema.column(c).path, "page": k, "first_row": p[3], "row_count": firsts[k + 1] - p[3], "bytes": p[2],
                    "nulls": index[5][k] if 5 in index else None, "low": text(index[2][k]) if held else None, "high": text(index[3][k]) if held else None,
                }


def _report(spark: SparkSession, path: str, files: int | None, schema: str, tell: Callable[[pa.NativeFile, str], Iterator[dict]]) -> DataFrame:
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    if files is not None:
        listed = listed.orderBy("path").limit(files)
    order = [c.split()[0] for c in schema.split(", ")]
    types = {"STRING": pa.string(), "INT": pa.int32(), "BIGINT": pa.int64()}
    arrow = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(p)
                with store.open_input_file(name) as f:
                    rows = list(tell(f, p.rpartition("/")[2]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return listed.repartition("path").mapInArrow(read, schema).select(*order)


def footers(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A row for each column chunk of the files of a folder, or of the first `files` of them by name: file, row_group, row_count, column, compressed bytes, and bounds as text.

    Spark lists the files without reading them; tasks open each through Arrow's file systems and read its end.
    """
    return _report(spark, path, files, GROUPS, _groups)


def pages(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A row for each data page: file, row_group, column, page (from 0), first_row in the row group, row_count, compressed bytes, nulls, and bounds as text (NULL for a page of NULLs alone).

    Read by tasks from the column and offset indexes of the files of a folder; no page is opened. Column chunks that were written without an offset index have no rows, those without bounds (such as times in 96 bits) have NULL ones. Bounds of long texts are cut as the writer cut them.
    """
    return _report(spark, path, files, PAGES, _pages)
