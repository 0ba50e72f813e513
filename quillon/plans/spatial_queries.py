"""Spatial queries: projected areas, look-ups by name, districts, roads, cadastral units, zones and map exports, beside plain arithmetic in SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import features
from ..operators import overlay as O
from ..operators import relational as R
from ..operators import spatial as G
from ..operators import spatial_joins as J
from ..operators.merge import append_rows
from ..sources.footers import pages
from ..sources.layers import read_geojson, read_layer, write_layer
from ..sources.pbf import ELEMENTS
from .catalogue import _BOX, _boxes, _t, query
from .store import shared

# regions in degrees: a rectangle for each nation, some hundred metres to some kilometres wide


def _degrees(spark, sf_dir):
    """A rectangle of 4326 for each nation, from (17 + n / 10, 48 + r / 5) to the north-east."""
    n = _t(spark, sf_dir, "nation")
    x0, y0 = 17 + F.col("n_nationkey") / 10, 48 + F.col("n_regionkey") / 5
    x1, y1 = x0 + (1 + F.col("n_nationkey") % 4) / 50, y0 + (1 + F.col("n_nationkey") % 3) / 100
    ring = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    way = F.struct(F.lit("POLYGON").alias("kind"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts")).cast(G.GEOMETRY)
    return n.select("n_nationkey", "n_name", way.alias("way"))


_DEGREES = """
SELECT n_nationkey, n_name, 17 + n_nationkey / 10.0::DOUBLE AS x0, 48 + n_regionkey / 5.0::DOUBLE AS y0,
       17 + n_nationkey / 10.0::DOUBLE + (1 + n_nationkey % 4) / 50.0::DOUBLE AS x1, 48 + n_regionkey / 5.0::DOUBLE + (1 + n_nationkey % 3) / 100.0::DOUBLE AS y1 FROM nation"""


def projected_sql(rows: str) -> str:
    """SQL of (key, lon, lat, ...) rows with the easting e and northing n: ellipsoid to geocentric, shift, back, then the projection."""
    (a, f), (ab, fb) = G.WGS84, G.BESSEL
    e2, eb2 = f * (2 - f), fb * (2 - fb)
    m, t, b = G.shift_matrix(), G._SHIFT, ab * (1 - fb)
    e = math.sqrt(eb2)
    phi_c, lon_0, alpha, phi_p, k_p = *map(math.radians, (49.5, 24 + 50 / 60, 30 + 17 / 60 + 17.30311 / 3600, 78.5)), 0.9999
    big_a = ab * math.sqrt(1 - eb2) / (1 - (e * math.sin(phi_c)) ** 2)
    bb = math.sqrt(1 + eb2 * math.cos(phi_c) ** 4 / (1 - eb2))
    gamma = math.asin(math.sin(phi_c) / bb)
    t0 = math.tan(math.pi / 4 + gamma / 2) * ((1 + e * math.sin(phi_c)) / (1 - e * math.sin(phi_c))) ** (e * bb / 2) / math.tan(math.pi / 4 + phi_c / 2) ** bb
    n, r0 = math.sin(phi_p), k_p * big_a / math.tan(phi_p)
    d = lambda x: f"{x!r}::DOUBLE"
    turned = lambda i: " + ".join(f"{d(m[i][j])} * ({c} - {d(t[j])})" for j, c in enumerate(("gx", "gy", "gz")))
    return f"""
    SELECT *, -(r * sin(theta)) AS e, -(r * cos(theta)) AS n FROM (
    SELECT *, {d(n)} * asin(cos(u) * sin(v) / cos(tt)) AS theta, {d(r0 * math.tan(math.pi / 4 + phi_p / 2) ** n)} / pow(tan(tt / 2 + pi() / 4), {d(n)}) AS r FROM (
    SELECT *, asin({d(math.cos(alpha))} * sin(u) + {d(math.sin(alpha))} * cos(u) * cos(v)) AS tt FROM (
    SELECT *, 2 * (atan({d(t0)} * pow(tan(up / 2 + pi() / 4), {d(bb)}) / pow((1 + {d(e)} * sin(up)) / (1 - {d(e)} * sin(up)), {d(e * bb / 2)})) - pi() / 4) AS u, {d(bb)} * ({d(lon_0)} - along) AS v FROM (
    SELECT *, atan2(qy, qx) AS along, atan2(qz + {d(eb2 / (1 - eb2) * b)} * pow(sin(w), 3), sqrt(qx * qx + qy * qy) - {d(eb2 * ab)} * pow(cos(w), 3)) AS up FROM (
    SELECT *, atan2(qz * {d(ab)}, sqrt(qx * qx + qy * qy) * {d(b)}) AS w FROM (
    SELECT *, {turned(0)} AS qx, {turned(1)} AS qy, {turned(2)} AS qz FROM (
    SELECT *, nn * cos(radians(lat)) * cos(radians(lon)) AS gx, nn * cos(radians(lat)) * sin(radians(lon)) AS gy, nn * {d(1 - e2)} * sin(radians(lat)) AS gz FROM (
    SELECT *, {d(a)} / sqrt(1 - {d(e2)} * sin(radians(lat)) * sin(radians(lat))) AS nn FROM ({rows})))))))))"""


_CORNERS = f"SELECT n_nationkey, n_name, k, CASE WHEN k IN (0, 3) THEN x0 ELSE x1 END AS lon, CASE WHEN k < 2 THEN y0 ELSE y1 END AS lat FROM ({_DEGREES}), (SELECT unnest([0, 1, 2, 3]) AS k)"
_AREAS = f"""
SELECT a.n_nationkey, a.n_name, abs(sum(a.e * b.n - b.e * a.n)) / 2 AS area FROM ({projected_sql(_CORNERS)}) a JOIN ({projected_sql(_CORNERS)}) b ON a.n_nationkey = b.n_nationkey AND b.k = (a.k + 1) % 4
GROUP BY a.n_nationkey, a.n_name"""


@query(f"SELECT n_name, round(area / 1000000, 4) AS area_km2 FROM ({_AREAS}) ORDER BY area DESC")
def region_areas(spark, sf_dir):
    """Regions by their projected area."""
    area = G.area(G.transform(F.col("way"), 5514))
    return _degrees(spark, sf_dir).select("n_name", area.alias("area")).orderBy(F.desc("area")).select("n_name", F.round(F.col("area") / 1e6, 4).alias("area_km2"))


@query(f"""
SELECT n_name, round(area / 1000000, 2) AS area_km2, round((x0 + x1) / 2, 8) AS lon, round((y0 + y1) / 2, 8) AS lat, 4326 AS srid
FROM ({_AREAS}) JOIN ({_DEGREES}) USING (n_nationkey, n_name) ORDER BY area, n_name LIMIT 1""")
def smallest_district(spark, sf_dir):
    """The smallest region, its centre and the system that the centre is in."""
    rows = _degrees(spark, sf_dir)
    center = G.centroid(F.col("way"))
    least = R.top_k(rows.select("n_name", G.area(G.transform(F.col("way"), 5514)).alias("area"), center.alias("c")), [R.asc("area"), R.asc("n_name")])
    told = least.select("n_name", F.round(F.col("area") / 1e6, 2).alias("area_km2"), F.round(G.x(F.col("c")), 8).alias("lon"), F.round(G.y(F.col("c")), 8).alias("lat"))
    return told.crossJoin(G.srid_of(rows, "way"))  # one row each


_PLACES = "SELECT s_suppkey, s_name, 17 + s_suppkey % 50 / 100.0::DOUBLE AS lon, 48 + s_suppkey % 37 / 100.0::DOUBLE AS lat FROM supplier"


@query(f"""
WITH p AS ({projected_sql(_PLACES)}), here AS ({projected_sql("SELECT 17.1211::DOUBLE AS lon, 48.1601::DOUBLE AS lat")})
SELECT s_name, round(sqrt((p.e - here.e) * (p.e - here.e) + (p.n - here.n) * (p.n - here.n)), 2) AS distance_m FROM p, here WHERE s_name ILIKE '%00007%'""")
def distance_by_name(spark, sf_dir):
    """Places looked up by a part of their name, and how far they are from one point, in metres of the projection."""
    places = _t(spark, sf_dir, "supplier").where(F.col("s_name").ilike("%00007%"))
    way = G.point(17 + F.col("s_suppkey") % 50 / 100, 48 + F.col("s_suppkey") % 37 / 100, 4326)
    here = spark.range(1).select(G.transform(G.point(F.lit(17.1211), F.lit(48.1601), 4326), 5514).alias("here"))
    both = places.select("s_name", G.transform(way, 5514).alias("way")).crossJoin(here)  # one row on the right
    return both.select("s_name", F.round(G.distance(F.col("way"), F.col("here")), 2).alias("distance_m"))


@query(f"""
SELECT n_name AS name, 'POLYGON((' || x0 || ' ' || y0 || ',' || x1 || ' ' || y0 || ',' || x1 || ' ' || y1 || ',' || x0 || ' ' || y1 || ',' || x0 || ' ' || y0 || '))' AS wkt FROM ({_BOX})
UNION ALL SELECT 'Garden', 'POLYGON((301 2,302 2,302.5 3,301 2))'""")
def insert_polygon(spark, sf_dir):
    """A polygon added to the regions by its text, and all of them read back."""
    rows = _boxes(spark, sf_dir).select(F.col("n_name").alias("name"), "wkt")
    both = append_rows(rows, [{"name": "Garden", "wkt": "POLYGON((301 2,302 2,302.5 3,301 2))"}])
    return G.parsed_wkt(both, "wkt", 5514).select("name", G.as_wkt(F.col("way")).alias("wkt"))


@query("SELECT s_name AS name, 'POINT(' || s_suppkey || ' ' || s_nationkey || ')' AS wkt, 4326 AS srid FROM supplier UNION ALL SELECT 'Bench', 'POINT(-3.5 7)', 4326")
def insert_point(spark, sf_dir):
    """A point made of two numbers, given a system and added to the others, and all of them read back."""
    places = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), G.point(F.col("s_suppkey"), F.col("s_nationkey"), 4326).alias("way"))
    mine = spark.range(1).select(F.lit("Bench").alias("name"), G.set_srid(G.point(F.lit(-3.5), F.lit(7), 0), 4326).alias("way"))
    return places.unionByName(mine).select("name", G.as_wkt(F.col("way")).alias("wkt"), F.col("way.srid").alias("srid"))


@query(f"""
SELECT n_nationkey, round(-n, 1) AS southing, round(-e, 1) AS westing FROM ({projected_sql(_CORNERS + " WHERE k = 0")})
UNION ALL SELECT -1, 1050538.6::DOUBLE, 568991.0::DOUBLE""")
def krovak_point(spark, sf_dir):
    """A corner of each region in metres of the projection, and, under -1, the worked example of its public specification, on the ellipsoid, to a decimetre."""
    way = _degrees(spark, sf_dir).select("n_nationkey", G.transform(G.point(G.x(F.col("way")), G.y(F.col("way")), 4326), 5514).alias("p"))
    corner = way.select("n_nationkey", F.round(-G.y(F.col("p")), 1).alias("southing"), F.round(-G.x(F.col("p")), 1).alias("westing"))
    e, n = G.krovak(F.lit(16 + 50 / 60 + 59.179 / 3600), F.lit(50 + 12 / 60 + 32.442 / 3600))
    return corner.unionByName(spark.range(1).select(F.lit(-1).alias("n_nationkey"), F.round(-n, 1).alias("southing"), F.round(-e, 1).alias("westing")))


@query(f"SELECT n_nationkey, round(lon, 7) AS lon, round(lat, 7) AS lat, true AS same FROM ({_CORNERS})")
def there_and_back(spark, sf_dir):
    """Corners of regions in metres of the projection, and back in degrees: the same to a millimetre."""
    way = _degrees(spark, sf_dir)
    corner = F.explode(F.slice(F.get(F.get("way.parts", F.lit(0)), F.lit(0)), 1, 4))
    points = way.select("n_nationkey", corner.alias("c")).select("n_nationkey", "c", G.point(F.col("c.x"), F.col("c.y"), 4326).alias("p"))
    back = G.once(G.once(points, "m", G.transform(F.col("p"), 5514)), "b", G.transform(F.col("m"), 4326))
    x, y = G.x(F.col("b")), G.y(F.col("b"))
    return back.select("n_nationkey", F.round(x, 7).alias("lon"), F.round(y, 7).alias("lat"), ((F.abs(x - F.col("c.x")) < 1e-8) & (F.abs(y - F.col("c.y")) < 1e-8)).alias("same"))


_RING = "'[[[' || x0::DOUBLE || ',' || y0::DOUBLE || '],[' || x1::DOUBLE || ',' || y0::DOUBLE || '],[' || x1::DOUBLE || ',' || y1::DOUBLE || '],[' || x0::DOUBLE || ',' || y1::DOUBLE || '],[' || x0::DOUBLE || ',' || y0::DOUBLE || ']]]'"


@query(f"""SELECT n_nationkey, '{{"type":"Feature","properties":{{"name":"' || n_name || '"}},"geometry":{{"type":"Polygon","coordinates":' || {_RING} || '}}}}' AS feature FROM ({_BOX})""")
def geojson_polygons(spark, sf_dir):
    """Whole polygons for a map."""
    return _boxes(spark, sf_dir).select("n_nationkey", G.geojson(F.col("way"), F.struct(F.col("n_name").alias("name"))).alias("feature"))


# roads: a level line for each customer; cadastral units: the halves of each district


def _roads(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    x0, y = F.col("c_custkey") % 250 + 0.25, (F.col("c_custkey") * 7) % 25 + 0.25
    line = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x in (x0, x0 + 1 + F.col("c_custkey") % 4)])
    return c.select("c_custkey", F.struct(F.lit("LINESTRING").alias("kind"), F.lit(5514).alias("srid"), F.array(F.array(line)).alias("parts")).cast(G.GEOMETRY).alias("road"))


_ROADS = "SELECT c_custkey, c_custkey % 250 + 0.25 AS r0, c_custkey % 250 + 1.25 + c_custkey % 4 AS r1, (c_custkey * 7) % 25 + 0.25 AS ry FROM customer"


@query(f"""
SELECT n_nationkey, c_custkey, CAST(r1 - r0 AS DOUBLE) AS length, 'U' || n_nationkey || CASE WHEN (r0 + r1) / 2 < (x0 + x1) / 2.0 THEN 'a' ELSE 'b' END AS unit FROM (
  SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY r1 - r0 DESC, c_custkey) AS place FROM ({_BOX}) JOIN ({_ROADS}) ON x0 <= r0 AND r1 <= x1 AND y0 <= ry AND ry <= y1) WHERE place = 1""")
def longest_road(spark, sf_dir):
    """The longest road that lies in each district, and the cadastral unit that holds the road's middle: one plan."""
    boxes = _boxes(spark, sf_dir)
    inside = J.contains_polygons(boxes, _roads(spark, sf_dir), 8.0, "way", "road")
    inside = G.once(inside, "middle", G.centroid(F.col("road")))
    inside = inside.select(F.col("n_nationkey").alias("district"), "c_custkey", G.length(F.col("road")).alias("length"), G.x(F.col("middle")).alias("px"), G.y(F.col("middle")).alias("py"))
    longest = R.distinct_on(inside, ["district"], [R.desc("length"), R.asc("c_custkey")])
    n = _t(spark, sf_dir, "nation")
    x0, y0 = F.col("n_nationkey") * 10, F.col("n_regionkey") * 5
    x1, y1 = x0 + 4 + F.col("n_nationkey") % 3, y0 + 3 + F.col("n_nationkey") % 2

    def unit(name, left, right):
        ring = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((left, y0), (right, y0), (right, y1), (left, y1), (left, y0))])
        way = F.struct(F.lit("POLYGON").alias("kind"), F.lit(5514).alias("srid"), F.array(F.array(ring)).alias("parts")).cast(G.GEOMETRY)
        return n.select(F.concat(F.lit("U"), F.col("n_nationkey").cast("string"), F.lit(name)).alias("unit"), way.alias("way"))

    units = unit("a", x0, (x0 + x1) / 2).union(unit("b", (x0 + x1) / 2, x1))
    return J.contains_join(units, longest, 8.0).select(F.col("district").alias("n_nationkey"), "c_custkey", "length", "unit")


@query(f"SELECT n_nationkey, c_custkey FROM ({_BOX}) JOIN ({_ROADS}) ON ry > y0 AND ry < y1 AND ((r0 < x0 AND r1 > x0) OR (r0 < x1 AND r1 > x1))")
def roads_across_border(spark, sf_dir):
    """Roads that cross or touch the border of a district, for all districts."""
    return J.meeting(_boxes(spark, sf_dir), _roads(spark, sf_dir), "n_nationkey", "c_custkey", "way", "road", 4.0)


@query(f"SELECT n_nationkey, c_custkey FROM ({_BOX}) JOIN ({_ROADS}) ON r0 >= x0 AND r1 <= x1 AND (abs(ry - y0) <= 2 OR abs(ry - y1) <= 2)")
def roads_near_border(spark, sf_dir):
    """Roads above, below or inside a district, between its left and right borders, that lie within 2 of the upper or lower one as a whole, for all districts."""
    boxes, roads = G.once(_boxes(spark, sf_dir), "b", G.bounds(F.col("way"))), _roads(spark, sf_dir)
    level = lambda y: F.array(F.array(*[F.struct(F.col(f"b.{x}").alias("x"), F.col(f"b.{y}").alias("y")) for x in ("x0", "x1")]))
    flat = F.struct(F.lit("MULTILINESTRING").alias("kind"), F.lit(5514).alias("srid"), F.array(level("y0"), level("y1")).alias("parts")).cast(G.GEOMETRY)
    near = J.lying_near(roads, G.once(boxes, "flat", flat), "c_custkey", "n_nationkey", "road", "flat", 2.0, 4.0)
    both = near.join(boxes.select("n_nationkey", "b"), "n_nationkey").join(roads, "c_custkey")
    return G.once(both, "r", G.bounds(F.col("road"))).where("r.x0 >= b.x0 AND r.x1 <= b.x1").select("n_nationkey", "c_custkey")


_SEGMENT = "(16 * 2 * sin(radians(7.5)) / 2 - sqrt(3) / 2)"


@query(f"SELECT n_nationkey, CAST(round(4 * ((x1 - x0) + (y1 - y0)) + 48 * 2 * sin(radians(7.5)) - (y1 - y0) - 2 * {_SEGMENT}, 4) AS DOUBLE) AS zone, 2 AS rings, x0 - 1 AS x0, x1 + 2 AS x1 FROM ({_BOX})")
def zone_around(spark, sf_dir):
    """The zone within 2 of a district, without the district, and not beyond a line 1 to its left, as polygons: buffer, difference and intersection. Round corners have 12 chords a quarter."""
    rows = G.once(_boxes(spark, sf_dir), "b", G.bounds(F.col("way")))
    x0, y0, x1, y1 = F.col("b.x0") - 1, F.col("b.y0") - 50, F.col("b.x1") + 50, F.col("b.y1") + 50
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    land = F.struct(F.lit("POLYGON").alias("kind"), F.lit(5514).alias("srid"), F.array(F.array(ring)).alias("parts")).cast(G.GEOMETRY)
    zones = G.once(O.zone(G.once(rows, "land", land), "n_nationkey", "way", 2.0, "land", "way", 12, 5514), "b", G.bounds(F.col("way")))
    return zones.select(F.col("key").alias("n_nationkey"), F.round(G.area(F.col("way")), 4).alias("zone"), F.size(F.flatten("way.parts")).alias("rings"), F.col("b.x0").cast("int").alias("x0"), F.col("b.x1").cast("int").alias("x1"))


_PLOTS = "SELECT s_suppkey, s_suppkey % 250 + 0.25 AS u0, s_suppkey % 250 + 2.25 + s_suppkey % 3 AS u1, (s_suppkey * 7) % 25 + 0.25 AS v0, (s_suppkey * 7) % 25 + 2.25 AS v1 FROM supplier"


@query(f"""
SELECT n_nationkey, s_suppkey, shared, (u1 - u0) * (v1 - v0) - shared AS rest, CASE WHEN shared = 0 THEN 0 ELSE 1 END AS pieces FROM (
  SELECT *, CAST(greatest(0, least(u1, x1) - greatest(u0, x0)) * greatest(0, least(v1, y1) - greatest(v0, y0)) AS DOUBLE) AS shared FROM ({_BOX}) JOIN ({_PLOTS.replace("+ 0.25", "+ 0.25::DOUBLE").replace("+ 2.25", "+ 2.25::DOUBLE")})
  ON u0 <= x1 AND x0 <= u1 AND v0 <= y1 AND y0 <= v1)""")
def overlay_plots(spark, sf_dir):
    """Plots that reach into a district: what they share with it and what is left of them, as polygons."""
    u0, v0 = F.col("s_suppkey") % 250 + 0.25, (F.col("s_suppkey") * 7) % 25 + 0.25
    u1, v1 = u0 + 2 + F.col("s_suppkey") % 3, v0 + 2
    ring = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((u0, v0), (u1, v0), (u1, v1), (u0, v1), (u0, v0))])
    plot = F.struct(F.lit("POLYGON").alias("kind"), F.lit(5514).alias("srid"), F.array(F.array(ring)).alias("parts")).cast(G.GEOMETRY)
    plots = G.once(_t(spark, sf_dir, "supplier").select("s_suppkey"), "plot", plot)
    pairs = J.overlapping(_boxes(spark, sf_dir).select("n_nationkey", "way"), plots, "way", "plot", 4.0)
    pairs = pairs.select(F.struct("l.n_nationkey", "r.s_suppkey").alias("pair"), "r.plot", "l.way")
    shared, rest = O.intersection(pairs, "pair", "plot", "way", 5514), O.difference(pairs, "pair", "plot", "way", 5514)
    area = lambda df, name: df.select("key", F.round(G.area(F.col("way")), 6).alias(name), F.size("way.parts").alias(f"{name}_pieces"))
    both = area(shared, "shared").join(area(rest, "rest"), "key")
    return both.select("key.n_nationkey", "key.s_suppkey", "shared", "rest", F.col("shared_pieces").alias("pieces"))


@query(f"SELECT n_nationkey, 'POLYGON((' || x0 || ' ' || y0 || ',' || x1 || ' ' || y0 || ',' || x1 || ' ' || y1 || ',' || x0 || ' ' || y1 || ',' || x0 || ' ' || y0 || '))' AS wkt, 5514 AS srid FROM ({_BOX}) WHERE x0 <= 120 AND x1 >= 31 AND y0 <= 20 AND y1 >= 4")
def stored_layer(spark, sf_dir):
    """Districts stored as bytes in the order of a curve, and those that meet a window read back."""
    path = f"{shared(spark)}/layer-{uuid.uuid4().hex}"
    write_layer(_boxes(spark, sf_dir).select("n_nationkey", "way"), path, "way", 4)
    return read_layer(spark, path, (31, 4, 120, 20), "way").select("n_nationkey", G.as_wkt(F.col("way")).alias("wkt"), F.col("way.srid").alias("srid"))


@query(f"SELECT n_name AS name, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM ({_BOX})")
def geojson_import(spark, sf_dir):
    """Districts written as GeoJSON lines, read back and measured."""
    path = f"{shared(spark)}/features-{uuid.uuid4().hex}"
    _boxes(spark, sf_dir).select(G.geojson(F.col("way"), F.struct(F.col("n_name").alias("name")))).write.text(path)
    return read_geojson(spark, path, 5514).select(F.col("properties")["name"].alias("name"), F.round(G.area(F.col("geometry")), 6).alias("area"))


# map elements


def _plots(spark, sf_dir):
    """Map elements of a plot for each supplier: eight corners, its border in two ways, one of them backwards, a third way for the garden that it leaves out, and a relation of the three."""
    k = F.col("s_suppkey")
    width, height = 4 + k % 5, 3 + k % 4
    corners = [(0, 0), (width, 0), (width, height), (0, height), (1, 1), (1, 2), (2, 2), (2, 1)]
    node = lambda *i: F.array(*[k * 10 + j for j in i])
    none, tags = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda **t: F.create_map(*[x for a, b in t.items() for x in (F.lit(a), b)])
    member = lambda i, role: F.struct(F.lit("way").alias("kind"), (k * 10 + i).alias("ref"), F.lit(role).alias("role"))

    def element(kind, id_, tags_, x=None, y=None, refs=None, members=None):
        columns = {"kind": F.lit(kind), "id": id_, "version": F.lit(1), "tags": tags_, "x": x, "y": y, "refs": refs, "members": members}
        return F.struct(*[(F.lit(None) if c is None else c).cast(t).alias(n) for (n, c), t in zip(columns.items(), (f.dataType for f in schema), strict=True)])

    schema = StructType.fromDDL(ELEMENTS)
    rows = [element("node", k * 10 + i, none, F.lit(x) + k % 100, F.lit(y)) for i, (x, y) in enumerate(corners)]
    rows += [element("way", k * 10 + i, none, refs=node(*r)) for i, r in enumerate(((2, 3, 0), (2, 1, 0), (4, 5, 6, 7, 4)))]
    rows.append(element("relation", k, tags(type=F.lit("multipolygon"), name=F.col("s_name")), members=F.array(member(0, "outer"), member(2, "inner"), member(1, "outer"))))
    return _t(spark, sf_dir, "supplier").select(F.explode(F.array(*rows)).alias("e")).select("e.*")


@query("SELECT -s_suppkey AS osm_id, s_name AS name, CAST((4 + s_suppkey % 5) * (3 + s_suppkey % 4) - 1 AS DOUBLE) AS area, 2 AS rings FROM supplier")
def map_polygons(spark, sf_dir):
    """Plots put together from nodes, ways and relations: rings stitched from pieces of border, holes in their polygons."""
    elements = _plots(spark, sf_dir)
    found = features.polygons(elements, features.way_paths(elements))
    return found.select("osm_id", F.col("tags")["name"].alias("name"), F.round(G.area(F.col("geometry")), 6).alias("area"), F.size(F.flatten("geometry.parts")).alias("rings"))


@query()
def clustered_pages(spark, sf_dir):
    """What the pages of a copy of the customers say that is sorted by balance: their number, rows, NULLs and bounds, for each column; and how many pages a range of balances meets."""
    path = f"{shared(spark)}/pages-{uuid.uuid4().hex}"
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name")
    rows.repartitionByRange(4, "c_acctbal").sortWithinPartitions("c_acctbal").write.option("parquet.page.row.count.limit", 500).parquet(path)
    low, high = F.col("low").try_cast("double"), F.col("high").try_cast("double")  # names give NULL
    met = F.when((F.col("column") == "c_acctbal") & (low <= 200) & (high >= 100), 1)
    return pages(spark, path).groupBy("column").agg(
        F.count("*").alias("pages"), F.sum("row_count").alias("row_count"), F.sum("nulls").alias("nulls"), F.min(low).alias("least"), F.max(high).alias("most"), F.count(met).alias("pages_100_to_200")
    )
