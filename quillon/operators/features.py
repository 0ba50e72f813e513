"""Map elements to feature layers: points, lines, polygons and roads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import GEOMETRY

#: A closed way with one of these tags is an area, and so is one with area=yes; with area=no none is.
AREA_KEYS = ("aeroway", "amenity", "boundary", "building", "historic", "landuse", "leisure", "military", "natural", "office", "place", "shop", "tourism", "water", "wetland")
#: Values of `highway` that belong to the layer of roads, beside railways and borders.
ROADS = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link")


def latest(elements: DataFrame, kind: str, *columns: str) -> DataFrame:
    """(id, columns) of the elements of a kind, each once, in its highest version: extracts that overlap repeat elements."""
    rows = elements.where(F.col("kind") == kind)
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.coalesce("version", F.lit(0))).alias("_e")).select("id", "_e.*")


def way_paths(elements: DataFrame) -> DataFrame:
    """(id, tags, nodes, path): the places of each way's nodes in their order. Nodes that an extract lacks are left out, and so are ways with fewer than two that it has.

    Node ids meet in one equi-join; tags join afterwards, by the way, rather than travel with each node. A way is a row (the format bounds it to some thousand nodes).
    """
    ways = latest(elements, "way", "tags", "refs")
    places = latest(elements, "node", "x", "y").select(F.col("id").alias("node"), "x", "y")
    steps = ways.select("id", F.posexplode("refs").alias("pos", "node"))
    met = steps.join(places, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "x", "y"))).alias("_p")).where(F.size("_p") > 1)
    told = met.select("id", F.col("_p.node").alias("nodes"), F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"))
    return told.join(ways.select("id", "tags"), "id").select("id", "tags", "nodes", "path")


def _geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(4326).alias("srid"), parts.alias("parts")).cast(GEOMETRY)


def _is_area(area_keys: tuple[str, ...]) -> Column:
    area = F.coalesce(F.col("tags")["area"], F.lit(""))
    closed = (F.size("nodes") > 3) & (F.get("nodes", F.lit(0)) == F.element_at("nodes", -1))
    return closed & (area != "no") & ((area == "yes") | F.arrays_overlap(F.map_keys("tags"), F.lit(list(area_keys))))


def points(elements: DataFrame) -> DataFrame:
    """(osm_id, tags, geometry) of nodes with tags."""
    nodes = latest(elements, "node", "tags", "x", "y").where(F.size("tags") > 0)
    return nodes.select(F.col("id").alias("osm_id"), "tags", _geometry("POINT", F.array(F.array(F.array(F.struct("x", "y"))))).alias("geometry"))


def _members(elements: DataFrame, ways: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(id, tags, ways) of relations of some types with the member ways that are there, each once, in the relation's order."""
    relations = latest(elements, "relation", "tags", "members").where(F.col("tags")["type"].isin(*types))
    steps = relations.select("id", F.posexplode("members").alias("pos", "m")).where(F.col("m.kind") == "way").groupBy("id", F.col("m.ref").alias("way")).agg(F.min("pos").alias("pos"))
    met = steps.join(ways.select(F.col("id").alias("way"), "nodes", "path"), "way").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "nodes", "path"))).alias("ways"))
    return met.join(relations.select("id", "tags"), "id")


def lines(elements: DataFrame, ways: DataFrame, area_keys: tuple[str, ...] = AREA_KEYS) -> DataFrame:
    """(osm_id, tags, geometry) of ways with tags that are no areas, and, with negative ids, the ways of routes and borders as lines of several parts."""
    own = ways.where((F.size("tags") > 0) & ~_is_area(area_keys)).select(F.col("id").alias("osm_id"), "tags", _geometry("LINESTRING", F.array(F.array("path"))).alias("geometry"))
    sets = _members(elements, ways, ("route", "boundary")).select((-F.col("id")).alias("osm_id"), "tags", _geometry("MULTILINESTRING", F.transform("ways", lambda w: F.array(w["path"]))).alias("geometry"))
    return own.unionByName(sets)


def roads(lines: DataFrame) -> DataFrame:
    """The lines that a small map shows: large roads, railways and administrative borders."""
    tags = F.col("tags")
    return lines.where(tags["highway"].isin(*ROADS) | tags["railway"].isNotNull() | (tags["boundary"] == "administrative"))


def polygons(elements: DataFrame, ways: DataFrame, area_keys: tuple[str, ...] = AREA_KEYS) -> DataFrame:
    """(osm_id, tags, geometry) of closed ways that are areas, and, with negative ids, of relations that are multipolygons or borders.

    The member ways of a relation are joined at their ends to rings; ways that close no ring are left out, and a relation without a ring has no row. Rings at even depth are outer ones, whatever their roles say. A relation, being a row, is stitched by one task.
    """
    own = ways.where(_is_area(area_keys)).select(F.col("id").alias("osm_id"), "tags", _geometry("POLYGON", F.array(F.array("path"))).alias("geometry"))

    @F.arrow_udf(GEOMETRY)
    def stitched(values: pa.Array) -> pa.Array:
        out = []
        for members in values.to_pylist():
            parts = nested(rings([(w["nodes"], [(p["x"], p["y"]) for p in w["path"]]) for w in members]))
            told = [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]
            out.append({"kind": "POLYGON" if len(parts) == 1 else "MULTIPOLYGON", "srid": 4326, "parts": told} if parts else None)
        ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.array(out, pa.struct([("kind", pa.string()), ("srid", pa.int32()), ("parts", pa.list_(pa.list_(ring)))]))

    sets = _members(elements, ways, ("multipolygon", "boundary")).select((-F.col("id")).alias("osm_id"), "tags", stitched("ways").alias("geometry"))
    return own.unionByName(sets.where("geometry IS NOT NULL"))


def rings(ways: list[tuple[list[int], list[tuple]]]) -> list[list[tuple]]:
    """Closed rings from ways (node ids, places) that share end nodes: a walk from way to way gives off a ring whenever it comes back to a node, and steps back from dead ends."""
    at_node: dict[int, list[int]] = {}
    for i, (nodes, _) in enumerate(ways):
        for end in {nodes[0], nodes[-1]}:
            at_node.setdefault(end, []).append(i)
    used, out = [False] * len(ways), []
    for first, (nodes, _) in enumerate(ways):
        if used[first]:
            continue
        stops, walked = [nodes[0]], []
        place = {nodes[0]: 0}
        while stops:
            here = stops[-1]
            waiting = at_node[here]
            while waiting and used[waiting[-1]]:
                waiting.pop()
            if not waiting:
                del place[stops.pop()]
                if walked:
                    walked.pop()
                continue
            way = waiting.pop()
            used[way] = True
            line = ways[way][1]
            ends = ways[way][0][0], ways[way][0][-1]
            there, line = (ends[1], line) if ends[0] == here else (ends[0], line[::-1])
            walked.append(line)
            if there in place:
                k = place[there]
                ring = [p for line in walked[k:] for p in line[:-1]]
                ring.append(ring[0])
                if len(ring) > 3:
                    out.append(ring)
                for stop in stops[k + 1 :]:
                    del place[stop]
                del stops[k + 1 :], walked[k:]
            else:
                place[there] = len(stops)
                stops.append(there)
    return out


def _area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def _crossings(ring: np.ndarray, y: float) -> np.ndarray:
    """Where a ring crosses a level, from left to right."""
    a, b = ring[:-1], ring[1:]
    over = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[over], b[over]
    return np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))


def nested(found: list[list[tuple]]) -> list[list[list[tuple]]]:
    """Polygons from rings that do not cross: each ring at even depth, counterclockwise, begins one, and those that lie directly in it are its holes, clockwise. Rings without an area are left out."""
    held = sorted((r for r in (np.array(f) for f in found) if _area(r)), key=lambda r: -abs(_area(r)))
    boxes = np.array([[*r.min(0), *r.max(0)] for r in held]).reshape(-1, 4)
    depth, parts, owner = [], [], []
    for i, r in enumerate(held):
        heights = np.unique(r[:, 1])
        level = (heights[0] + heights[1]) / 2
        left, right = _crossings(r, level)[:2]
        x = (left + right) / 2
        near = np.flatnonzero((boxes[:i, 0] <= x) & (x <= boxes[:i, 2]) & (boxes[:i, 1] <= level) & (level <= boxes[:i, 3]))
        around = [j for j in near if np.count_nonzero(_crossings(held[j], level) < x) % 2]
        depth.append(len(around))
        outer = depth[i] % 2 == 0
        ring = [tuple(p) for p in (r if (_area(r) > 0) == outer else r[::-1]).tolist()]
        if outer:
            owner.append(len(parts))
            parts.append([ring])
        else:
            owner.append(owner[max(around, key=lambda j: depth[j])])
            parts[owner[i]].append(ring)
    return parts
