"""Joins of points, lines and polygons as equi-joins of grid cells: cells double in size from level to level, and each thing stands on the level where it covers four cells at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import _all_edges, _let, _meet, bounds, contains, covered, inside_edges, once, outline, stretch

#: Points of a polygon from which on its edges are kept by slabs, and edges of a slab, if they are even.
PLAIN, SLAB = 64, 8
#: Geometries that one task takes at most, and up to which a table stays as it comes.
SPREAD, FEW = 65_536, 1024
_EDGES = "array<struct<a: struct<x: double, y: double>, b: struct<x: double, y: double>>>"


def _size(cell: float, level: Column) -> Column:
    return F.lit(cell) * F.pow(F.lit(2.0), level)


def _level(most: Column, cell: float) -> Column:
    """The level on which something of this extent covers two cells at most in each direction."""
    return F.when(most > cell, F.ceil(F.log2(most / cell))).otherwise(0).cast("int")


def _cells(low: Column, high: Column, size: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def _levels(rows: DataFrame, *columns: str) -> list[tuple[int, ...]]:
    """What there is of levels: as many as doublings between the smallest and the largest thing."""
    return sorted(tuple(r) for r in rows.select(*columns).distinct().collect())


def _dealt(polygons: DataFrame, polygon: str, cell: float) -> tuple[DataFrame, list[tuple[int, int]]]:
    """polygons with _b (bounds), _l (level), _k (doublings of slabs in a cell) and the (level, doublings) that there are."""
    rows = once(polygons, "_b", bounds(F.col(polygon))).where("_b IS NOT NULL")
    points = F.aggregate(F.flatten(F.col(f"{polygon}.parts")), F.lit(0), lambda n, r: n + F.size(r))
    rows = rows.withColumn("_l", _level(F.greatest(F.col("_b.x1") - F.col("_b.x0"), F.col("_b.y1") - F.col("_b.y0")), cell))
    rows = rows.withColumn("_k", F.when(points > PLAIN, F.ceil(F.log2(points / SLAB))).otherwise(0).cast("int"))
    return rows, _levels(rows, "_l", "_k")


def slabs(rows: DataFrame, polygon: str, cell: float) -> DataFrame:
    """The edge index of dealt polygons: for each slab of a polygon, a level strip of its height, _row (the strip's number among those of its height) and _edges, those that reach into it; the polygon itself goes.

    A point is tested against the edges of its own slab alone, about SLAB of them, however many the border has.
    """
    keep = [c for c in rows.columns if c != polygon]
    at, cols = rows.columns.index(polygon), [rows.columns.index(c) for c in keep]
    box, level, fine = keep.index("_b"), keep.index("_l"), keep.index("_k")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                rest = [one.column(c) for c in cols]
                yield from _slabs(one.column(at), rest, keep, cell * 2.0 ** (rest[level][0].as_py() - rest[fine][0].as_py()))

    assert keep[box] == "_b"
    return rows.mapInArrow(index, f"{kinds}, _row bigint, _edges {_EDGES}")


def _slabs(geometry: pa.Array, rest: list[pa.Array], names: list[str], height: float) -> Iterator[pa.RecordBatch]:
    """The slabs of one polygon, as rows of its other columns."""
    parts = geometry.field("parts")
    rings = parts.flatten().flatten()
    points = rings.flatten()
    x, y = (points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    ends = np.cumsum(np.diff(rings.offsets.to_numpy()))
    after = np.arange(1, len(x) + 1)
    after[ends[np.diff(ends, prepend=0) > 0] - 1] = (ends - np.diff(ends, prepend=0))[np.diff(ends, prepend=0) > 0]
    low, high = (np.floor(f(y, y[after]) / height).astype(np.int64) for f in (np.minimum, np.maximum))
    n = high - low + 1
    edge = np.repeat(np.arange(len(x)), n)
    row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    order = np.argsort(row, kind="stable")
    edge, row = edge[order], row[order]
    first = np.flatnonzero(np.diff(row, prepend=row[:1] - 1))
    for k in range(0, len(first), 1024):  # batches of slabs: a long border is many rows, not one large batch
        mine = first[k : k + 1024]
        stop = first[k + 1024] if k + 1024 < len(first) else len(edge)
        e = edge[mine[0] : stop]
        point = lambda i: pa.StructArray.from_arrays([pa.array(x[i]), pa.array(y[i])], names=["x", "y"])
        pairs = pa.StructArray.from_arrays([point(e), point(after[e])], names=["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(mine - mine[0], stop - mine[0]), pa.int32()), pairs)
        same = pa.array(np.zeros(len(mine), np.int64))
        yield pa.RecordBatch.from_arrays([*(c.take(same) for c in rest), pa.array(row[mine]), lists], names=[*names, "_row", "_edges"])


def contains_join(polygons: DataFrame, points: DataFrame, cell: float, polygon: str = "way", px: str = "px", py: str = "py") -> DataFrame:
    """Pairs of a polygon (its other columns) and a point inside it. Polygons are dealt into grid cells by their bounding boxes and meet the points of the cell in an equi-join; `cell` is the side of the smallest cells.

    A large polygon takes larger cells, so that none has more than four, and a point has one for each size of cells that is there. Polygons of many points are kept by slabs, see slabs().
    """
    rows, levels = _dealt(polygons, polygon, cell)
    box, size = F.col("_b"), _size(cell, F.col("_l"))
    fine = size / F.pow(F.lit(2.0), F.col("_k"))
    if any(k for _, k in levels):
        rows = slabs(rows, polygon, cell)
    else:
        rows = once(rows, "_edges", _all_edges(F.col(polygon))).drop(polygon).withColumn("_row", _cells(box["y0"], box["y1"], fine))
    rows = rows.withColumn("_cx", _cells(box["x0"], box["x1"], size))
    sizes = F.array(*[F.struct(F.lit(v).alias("l"), F.lit(k).alias("k")) for v, k in levels]) if levels else F.array().cast("array<struct<l: int, k: int>>")
    placed = points.withColumn("_of", F.explode(sizes)).withColumns({"_l": F.col("_of.l"), "_k": F.col("_of.k")}).drop("_of")
    placed = placed.withColumns({"_cx": F.floor(F.col(px) / size), "_row": F.floor(F.col(py) / fine)}).alias("p")
    inside = F.col(px).between(box["x0"], box["x1"]) & F.col(py).between(box["y0"], box["y1"])
    same = [F.col(f"g.{c}") == F.col(f"p.{c}") for c in ("_l", "_k", "_cx", "_row")]
    held = rows.alias("g").join(placed, same[0] & same[1] & same[2] & same[3] & inside & inside_edges(F.col("_edges"), F.col(px), F.col(py)))
    return held.select(*[F.col(f"g.`{c}`") for c in polygons.columns if c != polygon], *[F.col(f"p.`{c}`") for c in points.columns])


def contains_polygons(outer: DataFrame, inner: DataFrame, cell: float, a: str = "way", b: str = "inner") -> DataFrame:
    """Pairs of an outer polygon and a geometry that it contains, by the same grid: what is inside has the lower left corner of its bounding box there, so it stands in one cell of each size."""
    rows, _ = _dealt(outer, a, cell)
    levels = [v for (v,) in _levels(rows, "_l")]
    box, size = F.col("_b"), _size(cell, F.col("_l"))
    dealt = rows.withColumn("_cx", _cells(box["x0"], box["x1"], size)).withColumn("_cy", _cells(box["y0"], box["y1"], size))
    boxes = once(inner, "_i", bounds(F.col(b))).where("_i IS NOT NULL").withColumn("_l", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    placed = boxes.withColumns({"_cx": F.floor(F.col("_i.x0") / size), "_cy": F.floor(F.col("_i.y0") / size)})
    fits = (F.col("_b.x0") <= F.col("_i.x0")) & (F.col("_b.y0") <= F.col("_i.y0")) & (F.col("_b.x1") >= F.col("_i.x1")) & (F.col("_b.y1") >= F.col("_i.y1"))
    holds = _let(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), lambda v: contains(v["a"], v["b"]))
    return dealt.join(placed, ["_l", "_cx", "_cy"]).where(fits & holds).drop("_b", "_k", "_i", "_l", "_cx", "_cy")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, and over more tasks where one would get more than SPREAD of them: a file of short rows is one task, however much work a row is."""
    n = rows.count()
    return rows if n <= FEW else rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // SPREAD)))


def segments(df: DataFrame, key: str, geometry: str) -> DataFrame:
    """(key, n, of, e): the edges of each geometry, closed for polygons and open for lines, numbered from 0, with their count."""
    return once(spread(df.select(key, geometry)), "_outline", outline(F.col(geometry))).select(F.col(key).alias("key"), F.size("_outline").alias("of"), F.posexplode("_outline").alias("n", "e"))


def box_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(l, r): pairs of rows (l, lb) and (r, rb) whose boxes lb and rb overlap or touch, each pair once.

    Each thing stands in the cells of its own level and of the larger ones that there are; a pair meets on the larger of its two levels, and only in the cell that
    holds the lower left corner of what its boxes share, so that no pair has to be told apart from itself afterwards.
    """

    def level(rows: DataFrame, name: str) -> DataFrame:
        box = F.col(f"{name}b")
        return rows.withColumn(f"{name}v", _level(F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"]), cell))

    l, r = level(left, "l"), level(right, "r")
    there = F.array(*[F.lit(v) for v in sorted({v for (v,) in _levels(l, "lv") + _levels(r, "rv")})]).cast("array<int>")

    def celled(rows: DataFrame, name: str) -> DataFrame:
        box = F.col(f"{name}b")
        rows = rows.withColumn(f"{name}_l", F.explode(F.filter(there, lambda v: v >= F.col(f"{name}v"))))
        size = _size(cell, F.col(f"{name}_l"))
        return rows.withColumn(f"{name}_x", _cells(box["x0"], box["x1"], size)).withColumn(f"{name}_y", _cells(box["y0"], box["y1"], size))

    a, b, size = F.col("lb"), F.col("rb"), _size(cell, F.col("l_l"))
    same = (F.col("l_l") == F.col("r_l")) & (F.col("l_x") == F.col("r_x")) & (F.col("l_y") == F.col("r_y"))
    overlap = (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])
    told = (F.col("l_l") == F.greatest("lv", "rv")) & (F.col("l_x") == F.floor(F.greatest(a["x0"], b["x0"]) / size)) & (F.col("l_y") == F.floor(F.greatest(a["y0"], b["y0"]) / size))
    return celled(l, "l").join(celled(r, "r"), same & overlap & told).select("l", "r")


def overlapping(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, cell: float) -> DataFrame:
    """(l, r): pairs of rows, as structs, whose geometries' bounding boxes overlap or touch, each pair once."""
    whole = lambda df, name, g: once(df, "_box", bounds(F.col(g))).where("_box IS NOT NULL").select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), F.col("_box").alias(f"{name}b"))
    return box_pairs(whole(left, "l", left_geometry), whole(right, "r", right_geometry), cell)


def segment_pairs(left: DataFrame, right: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """(l, r): pairs of segments, as structs of the rows of segments(), whose bounding boxes are within `margin` of each other, each pair once."""

    def boxed(rows: DataFrame, name: str, wide: float) -> DataFrame:
        e = F.col("e")
        low = lambda c: F.least(e["a"][c], e["b"][c]) - wide
        high = lambda c: F.greatest(e["a"][c], e["b"][c]) + wide
        box = F.struct(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))
        return once(rows.select(F.struct(*rows.columns).alias(name), "e"), f"{name}b", box).drop("e")

    return box_pairs(boxed(left, "l", margin), boxed(right, "r", 0.0), cell)


def meeting(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_geometry: str, right_geometry: str, cell: float) -> DataFrame:
    """(left key, right key) of geometries whose borders, or lines, cross or touch, each pair once."""
    pairs = segment_pairs(segments(left, left_key, left_geometry), segments(right, right_key, right_geometry), cell)
    return pairs.where(_meet(F.col("l.e"), F.col("r.e"))).select(F.col("l.key").alias(left_key), F.col("r.key").alias(right_key)).distinct()


def lying_near(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_geometry: str, right_geometry: str, d: float, cell: float) -> DataFrame:
    """(left key, right key) where all of the left geometry's edges lie within d of the right one's border, exactly, each pair once: what near_border() decides for a pair, for all pairs that can be."""
    pairs = segment_pairs(segments(left, left_key, left_geometry), segments(right, right_key, right_geometry), cell, d)
    parts = once(pairs, "s", stretch(F.col("l.e"), F.col("r.e"), d)).where("s IS NOT NULL").select(F.col("l.key").alias("lk"), F.col("r.key").alias("rk"), F.col("l.n").alias("n"), F.col("l.of").alias("of"), "s")
    edges = parts.groupBy("lk", "rk", "n", "of").agg(F.collect_list("s").alias("parts")).where(covered(F.col("parts")))
    return edges.groupBy("lk", "rk", "of").agg(F.count("*").alias("many")).where("many = of").select(F.col("lk").alias(left_key), F.col("rk").alias(right_key))
