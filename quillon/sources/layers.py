"""Feature layers: shapefiles, WKT tables, GeoJSON and map extracts."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from ..operators.spatial import GEOMETRY, bounds, from_geojson, once, parsed_wkt, z_order
from ..operators.wkb import as_wkb, from_wkb
from .pbf import ELEMENTS, read_pbf


def shapes(data: bytes) -> Iterator[tuple[str, list]]:
    """(kind, parts) of each record of a .shp file: points, lines and polygons; a NULL shape is ("EMPTY", [])."""
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 1:
            yield "POINT", [[[struct.unpack("<2d", body[4:20])]]]
        elif kind in (3, 5):
            n_rings, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n_rings}i", body[44 : 44 + 4 * n_rings]), n]
            xy = struct.unpack(f"<{2 * n}d", body[44 + 4 * n_rings : 44 + 4 * n_rings + 16 * n])
            rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield ("MULTILINESTRING", [[r] for r in rings]) if kind == 3 else ("MULTIPOLYGON", _parts(rings))
        else:
            yield "EMPTY", []


def _parts(rings: list[list[tuple]]) -> list[list[list[tuple]]]:
    """Outer rings run clockwise and begin a part; the others are holes of the part before."""
    out: list[list] = []
    for r in rings:
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True))
        if twice <= 0 or not out:
            out.append([r])
        else:
            out[-1].append(r)
    return out


def attributes(data: bytes) -> list[dict]:
    """The rows of a .dbf file as text."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 13:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, p = {}, head + i * size + 1
        for name, width in fields:
            row[name] = data[p : p + width].decode("utf-8", "replace").strip() or None
            p += width
        out.append(row)
    return out


def read_shapefiles(spark: SparkSession, path: str, srid: int = 4326) -> DataFrame:
    """(layer, attributes, geometry) from zip archives of shapefiles: one task for each archive. Geometry is of the given system, 4326 unless told otherwise."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(x for x in z.namelist() if x.lower().endswith(".shp")):
                        stem = name[:-4]
                        dbf = next((x for x in z.namelist() if x.lower() == f"{stem.lower()}.dbf"), None)
                        rows = list(shapes(z.read(name)))
                        told = attributes(z.read(dbf)) if dbf else [{}] * len(rows)
                        yield pa.RecordBatch.from_pylist(
                            [{"layer": stem.rsplit("/", 1)[-1], "attributes": list(a.items()), "kind": k, "parts": [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]} for a, (k, parts) in zip(told, rows, strict=True)],
                            pa.schema([("layer", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))]),
                        )

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    out = rows.mapInArrow(read, "layer STRING, attributes MAP<STRING, STRING>, kind STRING, parts ARRAY<ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>")
    return out.select("layer", "attributes", F.struct("kind", F.lit(srid).alias("srid"), "parts").cast(GEOMETRY).alias("geometry"))


def read_wkt(rows: DataFrame, column: str, srid: int = 4326) -> DataFrame:
    """rows with geometry from a WKT column."""
    return parsed_wkt(rows, column, srid, "geometry")


def read_geojson(spark: SparkSession, path: str, srid: int = 4326, lines: bool = True) -> DataFrame:
    """(properties, geometry) of GeoJSON features, properties as a map of texts: one feature a line, or, without `lines`, collections (or single features), each file of which is read by one task."""
    if lines:
        features = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("f"))
    else:
        held = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", "features ARRAY<STRING>")["features"], F.array("value")).alias("all"))
        features = held.select(F.explode("all").alias("f"))
    told = once(features, "geometry", from_geojson(F.get_json_object("f", "$.geometry"), srid))
    return told.select(F.from_json(F.get_json_object("f", "$.properties"), "MAP<STRING, STRING>").alias("properties"), "geometry")


def write_layer(rows: DataFrame, path: str, geometry: str = "geometry", files: int = 8, bits: int = 16) -> None:
    """Stores rows with a geometry: its bytes instead of its points, its box as x0, y0, x1, y1, and rows sorted by the Z-order of the boxes' centres, so that a window reads the files and row groups near it.

    Geometries are taken as they are; rows without one come first. One shuffle, by ranges of the order.
    """
    boxed = once(rows, "_b", bounds(F.col(geometry)))
    x, y = (F.col("_b.x0") + F.col("_b.x1")) / 2, (F.col("_b.y0") + F.col("_b.y1")) / 2
    low_x, high_x, low_y, high_y = boxed.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    step = lambda c, low, high: F.floor((c - (low or 0.0)) / max((high or 0.0) - (low or 0.0), 1e-300) * ((1 << bits) - 1))
    ordered = once(boxed, "_z", z_order([step(x, low_x, high_x), step(y, low_y, high_y)], bits)).repartitionByRange(files, "_z").sortWithinPartitions("_z")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != geometry]
    ordered.select(*kept, *[F.col(f"_b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], as_wkb(F.col(geometry), True).alias(geometry)).write.option("parquet.block.size", 8 << 20).parquet(path)


def read_layer(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None, geometry: str = "geometry") -> DataFrame:
    """The rows of write_layer(), those alone whose boxes meet a window (x0, y0, x1, y1), if it is given; boxes are compared where the files are read, and only what is left is parsed."""
    rows = spark.read.parquet(path)
    if window:
        x0, y0, x1, y1 = window
        rows = rows.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
    return rows.withColumn(geometry, from_wkb(F.col(geometry)))


def import_map(spark: SparkSession, source: str, target: str, area_keys: tuple[str, ...] = features.AREA_KEYS, files: int = 8, split: int = 64 << 20) -> dict[str, int]:
    """Writes the layers of the .pbf files at a path as target/point, line, polygon and roads, to be read with read_layer(), and tells how many rows each has.

    Elements and the places of ways are written first, beside the layers (target/elements, target/ways), so that the files are parsed once and each layer reads the kind it needs.
    """
    read_pbf(spark, source, split).write.partitionBy("kind").parquet(f"{target}/elements")
    elements = spark.read.schema(ELEMENTS).parquet(f"{target}/elements")
    features.way_paths(elements).write.parquet(f"{target}/ways")
    ways = spark.read.parquet(f"{target}/ways")
    write_layer(features.points(elements), f"{target}/point", files=files)
    write_layer(features.lines(elements, ways, area_keys), f"{target}/line", files=files)
    write_layer(features.polygons(elements, ways, area_keys), f"{target}/polygon", files=files)
    write_layer(features.roads(read_layer(spark, f"{target}/line")).drop("x0", "y0", "x1", "y1"), f"{target}/roads", files=files)
    return {name: spark.read.parquet(f"{target}/{name}").count() for name in ("point", "line", "polygon", "roads")}
