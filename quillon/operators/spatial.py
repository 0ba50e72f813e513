"""Planar geometry as nested arrays: WKT, measures, predicates, the Krovak projection and GeoJSON, all in column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: parts are polygons of rings, the first of which is the outer one; a line or point is a part of one ring.
GEOMETRY = "STRUCT<kind: STRING, srid: INT, parts: ARRAY<ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>>"
_PARTS = "ARRAY<ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>"


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def from_wkt(c: Column, srid: int) -> Column:
    """A geometry from text; NULL if the kind is unknown or the text does not parse."""
    kind = F.upper(F.regexp_extract(c, r"^\s*(\w+)", 1))
    body = F.regexp_replace(F.regexp_replace(c, r"^\s*\w+\s*", ""), r"(-?[\d.]+(?:[eE][+-]?\d+)?)\s+(-?[\d.]+(?:[eE][+-]?\d+)?)", '{"x":$1,"y":$2}')
    text = F.translate(body, "()", "[]")
    return _geometry(kind, text, srid)


def _geometry(kind: Column, text: Column, srid: int) -> Column:
    """A geometry from its kind and its points, as objects in nested JSON arrays; NULL if they don't fit."""
    nested = F.when(kind.isin("POINT", "LINESTRING"), F.concat(F.lit("[["), text, F.lit("]]"))).when(kind.isin("POLYGON", "MULTILINESTRING"), F.concat(F.lit("["), text, F.lit("]"))).when(kind == "MULTIPOLYGON", text)

    def checked(parts: Column) -> Column:
        bad = parts.isNull() | F.exists(F.flatten(F.flatten(parts)), lambda p: p["x"].isNull() | p["y"].isNull())
        return F.when(~bad, F.struct(kind.alias("kind"), F.lit(srid).alias("srid"), parts.alias("parts")).cast(GEOMETRY))

    # lines of several pieces are read as rings of one part, and become parts of their own
    apart = lambda parts: F.when(kind == "MULTILINESTRING", F.transform(F.get(parts, F.lit(0)), lambda r: F.array(r))).otherwise(parts)
    return _let(_let(F.from_json(nested, _PARTS), apart), checked)


def from_geojson(c: Column, srid: int = 4326) -> Column:
    """A geometry from the text of a GeoJSON geometry; heights are left out, and kinds other than points, lines and polygons are NULL."""
    kind = F.upper(F.get_json_object(c, "$.type"))
    number = r"(-?[\d.]+(?:[eE][+-]?\d+)?)"
    text = F.regexp_replace(F.get_json_object(c, "$.coordinates"), rf"\[\s*{number}\s*,\s*{number}[^\[\]]*\]", '{"x":$1,"y":$2}')
    return _geometry(kind, F.when(kind == "POINT", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), srid)


def _number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _ring_text(r: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]))), ","), F.lit(")"))


def as_wkt(g: Column) -> Column:
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, _ring_text), ","), F.lit(")"))
    flat = F.flatten(g["parts"])
    body = (
        F.when(g["kind"].isin("POINT", "LINESTRING"), _ring_text(F.get(flat, F.lit(0))))
        .when(g["kind"] == "POLYGON", part(F.get(g["parts"], F.lit(0))))
        .when(g["kind"] == "MULTILINESTRING", F.concat(F.lit("("), F.array_join(F.transform(flat, _ring_text), ","), F.lit(")")))
        .otherwise(F.concat(F.lit("("), F.array_join(F.transform(g["parts"], part), ","), F.lit(")")))
    )
    return F.concat(g["kind"], body)


def point(x: Column, y: Column, srid: int) -> Column:
    ring = F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return F.struct(F.lit("POINT").alias("kind"), F.lit(srid).alias("srid"), F.array(F.array(ring)).alias("parts")).cast(GEOMETRY)


def set_srid(g: Column, srid: int) -> Column:
    """The same numbers under another system: nothing is transformed."""
    return F.struct(g["kind"].alias("kind"), F.lit(srid).alias("srid"), g["parts"].alias("parts"))


def _first(g: Column) -> Column:
    return F.get(F.get(F.get(g["parts"], F.lit(0)), F.lit(0)), F.lit(0))


def x(g: Column) -> Column:
    return _first(g)["x"]


def y(g: Column) -> Column:
    return _first(g)["y"]


def _edges(r: Column, closed: bool = True) -> Column:
    """(a, b) for each two neighbours of a ring, the last and the first included if it is closed."""
    n = F.size(r)
    after = F.slice(r, F.lit(2), F.greatest(n - 1, F.lit(0)))
    if closed:
        return F.zip_with(r, F.concat(after, F.slice(r, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(F.slice(r, F.lit(1), F.greatest(n - 1, F.lit(0))), after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, i: s + f(i))


def _moments(r: Column) -> Column:
    """Twice the signed area and six times the moments of a ring, about its first point for accuracy."""
    o = F.get(r, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(s, e):
        ax, ay, bx, by = e["a"]["x"] - o["x"], e["a"]["y"] - o["y"], e["b"]["x"] - o["x"], e["b"]["y"] - o["y"]
        c = ax * by - bx * ay
        return F.struct((s["a"] + c).alias("a"), (s["mx"] + (ax + bx) * c).alias("mx"), (s["my"] + (ay + by) * c).alias("my"))

    return F.aggregate(_edges(r), zero, add)


def _signed(part: Column, f) -> Column:
    """The sum of f over a part's rings, holes counted against the outer ring."""
    return F.aggregate(F.sequence(F.lit(0), F.size(part) - 1), F.lit(0.0), lambda s, i: s + F.when(i == 0, 1.0).otherwise(-1.0) * f(F.get(part, i)))


def area(g: Column) -> Column:
    """Planar area in the geometry's own units; zero for points and lines."""
    total = _sum(g["parts"], lambda p: _signed(p, lambda r: F.abs(_moments(r)["a"]) / 2))
    return F.when(g["kind"].isin("POLYGON", "MULTIPOLYGON"), total).otherwise(0.0)


def length(g: Column) -> Column:
    """The length of lines, or of all rings of polygons."""
    closed = g["kind"].isin("POLYGON", "MULTIPOLYGON")
    step = lambda e: F.hypot(e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"])
    rings = F.flatten(g["parts"])
    return F.when(closed, _sum(rings, lambda r: _sum(_edges(r), step))).otherwise(_sum(rings, lambda r: _sum(_edges(r, False), step)))


def centroid(g: Column) -> Column:
    """The centre of a polygon's area, of a line's length or of points, as a point."""

    def moment(axis: str) -> Column:
        def ring(r):
            m, o = _moments(r), F.get(r, F.lit(0))
            return F.signum(m["a"]) * (m["m" + axis] / 6 + o[axis] * m["a"] / 2)

        whole = _sum(g["parts"], lambda p: _signed(p, ring)) / F.nullif(area(g), F.lit(0.0))
        rings = F.flatten(g["parts"])
        along = _sum(rings, lambda r: _sum(_edges(r, False), lambda e: F.hypot(e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"]) * (e["a"][axis] + e["b"][axis]) / 2)) / F.nullif(length(g), F.lit(0.0))
        points = F.flatten(rings)
        mean = _sum(points, lambda p: p[axis]) / F.size(points)
        return F.when(g["kind"].isin("POLYGON", "MULTIPOLYGON"), F.coalesce(whole, mean)).otherwise(F.coalesce(along, mean))

    return F.struct(F.lit("POINT").alias("kind"), g["srid"].alias("srid"), F.array(F.array(F.array(F.struct(moment("x").alias("x"), moment("y").alias("y"))))).alias("parts")).cast(GEOMETRY)


def bounds(g: Column) -> Column:
    """The bounding box: struct of x0, y0, x1, y1."""
    points = F.flatten(F.flatten(g["parts"]))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _turn(a: Column, b: Column, px: Column, py: Column) -> Column:
    return (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])


def _on_edge(e: Column, px: Column, py: Column) -> Column:
    a, b = e["a"], e["b"]
    return (_turn(a, b, px, py) == 0) & (px >= F.least(a["x"], b["x"])) & (px <= F.greatest(a["x"], b["x"])) & (py >= F.least(a["y"], b["y"])) & (py <= F.greatest(a["y"], b["y"]))


def _all_edges(g: Column) -> Column:
    return F.flatten(F.transform(F.flatten(g["parts"]), lambda r: _edges(r)))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row, however often what follows asks for it: a generator's output is not put in place of its name, as a projection's is."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parsed_wkt(df: DataFrame, wkt: str, srid: int, name: str = "way") -> DataFrame:
    """df with the geometry of a text column, parsed once a row."""
    return once(df, name, from_wkt(F.col(wkt), srid))


def _on_border(edges: Column, px: Column, py: Column) -> Column:
    return F.exists(edges, lambda e: _on_edge(e, px, py))


def on_boundary(g: Column, px: Column, py: Column) -> Column:
    return _on_border(_all_edges(g), px, py)


def _ray(edges: Column, px: Column, py: Column) -> Column:
    """Whether a ray to the right crosses the edges an odd number of times."""

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & ((_turn(a, b, px, py) > 0) == (b["y"] > a["y"]))

    return F.aggregate(edges, F.lit(False), lambda s, e: s != crosses(e))


def inside_edges(edges: Column, px: Column, py: Column) -> Column:
    """Whether a point lies inside the rings that edges make up; a point on an edge does not. Edges that don't reach the point's height may be left out."""
    return _ray(edges, px, py) & ~_on_border(edges, px, py)


def contains_point(g: Column, px: Column, py: Column) -> Column:
    """Whether a point lies inside a polygon; its boundary is not inside."""
    return _let(_all_edges(g), lambda e: inside_edges(e, px, py))


def covers_point(g: Column, px: Column, py: Column) -> Column:
    return _let(_all_edges(g), lambda e: _ray(e, px, py) | _on_border(e, px, py))


def _cross(e: Column, f: Column) -> Column:
    """Whether two segments cross at a point inside both."""
    side = lambda s, p: F.signum(_turn(s["a"], s["b"], p["x"], p["y"]))
    return (side(e, f["a"]) * side(e, f["b"]) < 0) & (side(f, e["a"]) * side(f, e["b"]) < 0)


def _meet(e: Column, f: Column) -> Column:
    """Whether two segments share any point."""
    return _cross(e, f) | _on_edge(e, f["a"]["x"], f["a"]["y"]) | _on_edge(e, f["b"]["x"], f["b"]["y"]) | _on_edge(f, e["a"]["x"], e["a"]["y"]) | _on_edge(f, e["b"]["x"], e["b"]["y"])


def contains(a: Column, b: Column) -> Column:
    """Whether no point of b is outside a, and some inside of b is inside a. Points on the boundary alone are not contained.

    For a polygon b: its vertices and the middles of its edges are covered, no edges cross, and no vertex of a's rings lies inside b. A polygon contains itself.
    """
    parts = F.struct(_all_edges(a).alias("a"), _all_edges(b).alias("b"), F.flatten(F.flatten(a["parts"])).alias("pa"), F.flatten(F.flatten(b["parts"])).alias("pb"))

    def test(v: Column) -> Column:
        middles = F.transform(v["b"], lambda e: F.struct(((e["a"]["x"] + e["b"]["x"]) / 2).alias("x"), ((e["a"]["y"] + e["b"]["y"]) / 2).alias("y")))
        covered = F.forall(F.concat(v["pb"], middles), lambda p: _ray(v["a"], p["x"], p["y"]) | _on_border(v["a"], p["x"], p["y"]))
        crossed = F.exists(v["b"], lambda e: F.exists(v["a"], lambda f: _cross(e, f)))
        pierced = F.exists(v["pa"], lambda p: inside_edges(v["b"], p["x"], p["y"]))
        return F.when(b["kind"] == "POINT", inside_edges(v["a"], x(b), y(b))).otherwise(covered & ~crossed & ~pierced)

    return _let(parts, test)


def outline(g: Column) -> Column:
    """The edges of a geometry: closed for polygons, open for lines."""
    lines = F.flatten(F.transform(F.flatten(g["parts"]), lambda r: _edges(r, False)))
    return F.when(g["kind"].isin("POLYGON", "MULTIPOLYGON"), _all_edges(g)).otherwise(lines)


def borders_meet(a: Column, b: Column) -> Column:
    """Whether the boundaries (or lines) of two geometries cross or touch."""
    return _let(outline(b), lambda edges: F.exists(outline(a), lambda e: F.exists(edges, lambda f: _meet(e, f))))


def distance(a: Column, b: Column) -> Column:
    """The planar distance of two points."""
    return F.hypot(x(a) - x(b), y(a) - y(b))


def _to_segment(e: Column, px: Column, py: Column) -> Column:
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    t = F.coalesce(((px - e["a"]["x"]) * dx + (py - e["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (e["a"]["x"] + t * dx), py - (e["a"]["y"] + t * dy))


def border_distance(g: Column, px: Column, py: Column) -> Column:
    """The distance of a point to the nearest edge."""
    return F.array_min(F.transform(_all_edges(g), lambda e: _to_segment(e, px, py)))


def _slab(at: Column, rate: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """From where to where at + t * rate lies between low and high; NULL if nowhere."""
    one, two = (low - at) / F.nullif(rate, F.lit(0.0)), (high - at) / F.nullif(rate, F.lit(0.0))
    always = (rate == 0) & (at >= low) & (at <= high)
    return F.when(always, float("-inf")).otherwise(F.least(one, two)), F.when(always, float("inf")).otherwise(F.greatest(one, two))


def stretch(e: Column, s: Column, d: float) -> Column:
    """The part of an edge, from 0 at its start to 1 at its end, that lies within d of a segment: (lo, hi), or NULL.

    Those points form a convex set, two discs and the rectangle between them, so an edge runs through it in one stretch.
    """
    length = F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
    base = F.struct(
        e["a"]["x"].alias("px"), e["a"]["y"].alias("py"), (e["b"]["x"] - e["a"]["x"]).alias("vx"), (e["b"]["y"] - e["a"]["y"]).alias("vy"), s["a"].alias("a"), s["b"].alias("b"), length.alias("n"),
        F.coalesce((s["b"]["x"] - s["a"]["x"]) / F.nullif(length, F.lit(0.0)), F.lit(1.0)).alias("ux"), F.coalesce((s["b"]["y"] - s["a"]["y"]) / F.nullif(length, F.lit(0.0)), F.lit(0.0)).alias("uy"),
    )

    def disc(o: Column, c: Column) -> Column:
        terms = F.struct(
            (o["vx"] * o["vx"] + o["vy"] * o["vy"]).alias("q"), (o["vx"] * (o["px"] - c["x"]) + o["vy"] * (o["py"] - c["y"])).alias("h"),
            ((o["px"] - c["x"]) * (o["px"] - c["x"]) + (o["py"] - c["y"]) * (o["py"] - c["y"]) - d * d).alias("k"),
        )

        def roots(t: Column) -> Column:
            under = t["h"] * t["h"] - t["q"] * t["k"]
            root = F.sqrt(F.greatest(under, F.lit(0.0)))
            point = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
            return F.when((t["q"] == 0) & (t["k"] <= 0), point).when((t["q"] > 0) & (under >= 0), F.struct(((-t["h"] - root) / F.nullif(t["q"], F.lit(0.0))).alias("lo"), ((root - t["h"]) / F.nullif(t["q"], F.lit(0.0))).alias("hi")))

        return _let(terms, roots)

    def whole(o: Column) -> Column:
        along = _slab((o["px"] - o["a"]["x"]) * o["ux"] + (o["py"] - o["a"]["y"]) * o["uy"], o["vx"] * o["ux"] + o["vy"] * o["uy"], F.lit(0.0), o["n"])
        aside = _slab(o["ux"] * (o["py"] - o["a"]["y"]) - o["uy"] * (o["px"] - o["a"]["x"]), o["ux"] * o["vy"] - o["uy"] * o["vx"], F.lit(-d), F.lit(d))
        four = F.struct(along[0].alias("a0"), along[1].alias("a1"), aside[0].alias("s0"), aside[1].alias("s1"))

        def between(t: Column) -> Column:
            both = t["a0"].isNotNull() & t["s0"].isNotNull()
            return F.when(both & (F.greatest(t["a0"], t["s0"]) <= F.least(t["a1"], t["s1"])), F.struct(F.greatest(t["a0"], t["s0"]).alias("lo"), F.least(t["a1"], t["s1"]).alias("hi")))

        def ends(found: Column) -> Column:
            lo, hi = F.array_min(F.transform(found, lambda x: x["lo"])), F.array_max(F.transform(found, lambda x: x["hi"]))
            return F.when(F.exists(found, lambda x: x.isNotNull()), F.struct(F.greatest(F.lit(0.0), lo).alias("lo"), F.least(F.lit(1.0), hi).alias("hi")))

        return _let(F.array(disc(o, o["a"]), disc(o, o["b"]), _let(four, between)), ends)

    return _let(_let(base, whole), lambda x: F.when(x["lo"] <= x["hi"], x))


def near_border(g: Column, other: Column, d: float) -> Column:
    """Whether all of a geometry's edges (or of a line) lie within d of the other's border, exactly: the stretches of an edge that lie within d of some segment must cover it."""

    return _let(outline(other), lambda border: F.forall(outline(g), lambda e: covered(F.transform(border, lambda s: stretch(e, s, d)))))


def covered(stretches: Column) -> Column:
    """Whether the stretches of an edge cover it; NULLs among them are left out."""

    def reaches(parts: Column) -> Column:
        reach = F.aggregate(parts, F.lit(0.0), lambda r, x: F.when(x["lo"] <= r + 1e-12, F.greatest(r, x["hi"])).otherwise(r))
        return (F.size(parts) > 0) & (reach >= 1 - 1e-12)

    return _let(F.array_sort(F.filter(stretches, lambda x: x.isNotNull())), reaches)


#: Fixed values of the public transformation between the two systems (EPSG 1623): shifts in metres, turns in seconds of arc, scale in millionths.
_SHIFT, _TURN, _SCALE = (570.8, 85.7, 462.8), (4.998, 1.587, 5.261), 3.56
WGS84, BESSEL = (6378137.0, 1 / 298.257223563), (6377397.155, 1 / 299.1528128)


def shift_matrix() -> list[list[float]]:
    """What turns geocentric coordinates, less the shift, from WGS 84 to the Bessel ellipsoid."""
    x, y, z = (math.radians(t / 3600) for t in _TURN)
    return np.linalg.inv((1 + _SCALE * 1e-6) * np.array([[1, -z, y], [z, 1, -x], [-y, x, 1]])).tolist()


def to_bessel(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude on the Bessel ellipsoid of degrees of WGS 84, both in degrees at height 0."""
    (a, f), (bessel, g) = WGS84, BESSEL
    e2 = f * (2 - f)
    lam, phi = F.radians(lon), F.radians(lat)
    n = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    there = (n * F.cos(phi) * F.cos(lam) - _SHIFT[0], n * F.cos(phi) * F.sin(lam) - _SHIFT[1], n * (1 - e2) * F.sin(phi) - _SHIFT[2])
    x, y, z = (sum((m * c for m, c in zip(row[1:], there[1:], strict=True)), row[0] * there[0]) for row in shift_matrix())
    b, e2 = bessel * (1 - g), g * (2 - g)
    p = F.hypot(x, y)
    t = F.atan2(z * bessel, p * b)
    up = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(t), F.lit(3.0)), p - e2 * bessel * F.pow(F.cos(t), F.lit(3.0)))
    return F.degrees(F.atan2(y, x)), F.degrees(up)


def krovak(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing (EPSG 5514: both negative) of degrees on the Bessel ellipsoid; no datum shift is applied."""
    a, f = BESSEL
    e = math.sqrt(2 * f - f * f)
    phi_c, lon_0, alpha, phi_p, k_p = *map(math.radians, (49.5, 24 + 50 / 60, 30 + 17 / 60 + 17.30311 / 3600, 78.5)), 0.9999
    big_a = a * math.sqrt(1 - e * e) / (1 - (e * math.sin(phi_c)) ** 2)
    b = math.sqrt(1 + e * e * math.cos(phi_c) ** 4 / (1 - e * e))
    gamma = math.asin(math.sin(phi_c) / b)
    t0 = math.tan(math.pi / 4 + gamma / 2) * ((1 + e * math.sin(phi_c)) / (1 - e * math.sin(phi_c))) ** (e * b / 2) / math.tan(math.pi / 4 + phi_c / 2) ** b
    n, r0 = math.sin(phi_p), k_p * big_a / math.tan(phi_p)
    phi, lam = F.radians(lat), F.radians(lon)
    s = F.sin(phi) * e
    u = 2 * (F.atan(t0 * F.pow(F.tan(phi / 2 + math.pi / 4), F.lit(b)) / F.pow((1 + s) / (1 - s), F.lit(e * b / 2))) - math.pi / 4)
    v = b * (lon_0 - lam)
    t = F.asin(math.cos(alpha) * F.sin(u) + math.sin(alpha) * F.cos(u) * F.cos(v))
    theta = n * F.asin(F.cos(u) * F.sin(v) / F.cos(t))
    r = r0 * math.tan(math.pi / 4 + phi_p / 2) ** n / F.pow(F.tan(t / 2 + math.pi / 4), F.lit(n))
    return -(r * F.sin(theta)), -(r * F.cos(theta))


def from_krovak(e: Column, n: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees on the Bessel ellipsoid of easting and northing (EPSG 5514): the cone and the sphere in closed form, then the latitude by fixed-point steps."""
    a, f = BESSEL
    ecc = math.sqrt(2 * f - f * f)
    phi_c, lon_0, alpha, phi_p, k_p = *map(math.radians, (49.5, 24 + 50 / 60, 30 + 17 / 60 + 17.30311 / 3600, 78.5)), 0.9999
    big_a = a * math.sqrt(1 - ecc * ecc) / (1 - (ecc * math.sin(phi_c)) ** 2)
    b = math.sqrt(1 + ecc * ecc * math.cos(phi_c) ** 4 / (1 - ecc * ecc))
    gamma = math.asin(math.sin(phi_c) / b)
    t0 = math.tan(math.pi / 4 + gamma / 2) * ((1 + ecc * math.sin(phi_c)) / (1 - ecc * math.sin(phi_c))) ** (ecc * b / 2) / math.tan(math.pi / 4 + phi_c / 2) ** b
    cone, r0 = math.sin(phi_p), k_p * big_a / math.tan(phi_p)
    polar = F.struct(F.hypot(e, n).alias("r"), (F.atan2(-e, -n) / cone).alias("d"))

    def sphere(p: Column) -> Column:
        t = 2 * (F.atan(F.pow(F.lit(r0) / p["r"], F.lit(1 / cone)) * math.tan(math.pi / 4 + phi_p / 2)) - math.pi / 4)
        return _let(t, lambda t: F.struct(F.asin(math.cos(alpha) * F.sin(t) - math.sin(alpha) * F.cos(t) * F.cos(p["d"])).alias("u"), t.alias("t"), p["d"].alias("d")))

    def degrees(q: Column) -> Column:
        v = F.asin(F.cos(q["t"]) * F.sin(q["d"]) / F.cos(q["u"]))
        base = F.pow(F.tan(q["u"] / 2 + math.pi / 4) / t0, F.lit(1 / b))

        def lat(base: Column) -> Column:
            step = lambda phi, _: 2 * (F.atan(base * F.pow((1 + ecc * F.sin(phi)) / (1 - ecc * F.sin(phi)), F.lit(ecc / 2))) - math.pi / 4)
            return F.aggregate(F.sequence(F.lit(1), F.lit(7)), q["u"], step)

        return F.struct(F.degrees(F.lit(lon_0) - v / b).alias("lon"), F.degrees(_let(base, lat)).alias("lat"))

    out = _let(_let(polar, sphere), degrees)
    return out["lon"], out["lat"]


def from_bessel(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees of WGS 84 of degrees on the Bessel ellipsoid whose point of WGS 84 has height 0: the shift turned round, with the height that it needs found by fixed-point steps."""
    (a, f), (bessel, g) = WGS84, BESSEL
    e2, b2 = f * (2 - f), g * (2 - g)
    inverse = np.linalg.inv(np.array(shift_matrix())).tolist()
    lam, phi = F.radians(lon), F.radians(lat)
    curve = bessel / F.sqrt(1 - b2 * F.sin(phi) * F.sin(phi))

    def there(h: Column) -> list[Column]:
        q = ((curve + h) * F.cos(phi) * F.cos(lam), (curve + h) * F.cos(phi) * F.sin(lam), (curve * (1 - b2) + h) * F.sin(phi))
        return [row[0] * q[0] + row[1] * q[1] + row[2] * q[2] + s for row, s in zip(inverse, _SHIFT, strict=True)]

    def placed(h: Column) -> Column:
        """The point at a height above Bessel: longitude, latitude and height in WGS 84."""
        x, y, z = there(h)

        def up(c: Column) -> Column:
            p, b = F.hypot(c["x"], c["y"]), a * (1 - f)
            t = F.atan2(c["z"] * a, p * b)
            lat = F.atan2(c["z"] + e2 / (1 - e2) * b * F.pow(F.sin(t), F.lit(3.0)), p - e2 * a * F.pow(F.cos(t), F.lit(3.0)))
            return _let(lat, lambda v: F.struct(F.atan2(c["y"], c["x"]).alias("lon"), v.alias("lat"), (p * F.cos(v) + c["z"] * F.sin(v) - a * F.sqrt(1 - e2 * F.sin(v) * F.sin(v))).alias("h")))

        return _let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), up)

    height = F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.lit(0.0), lambda h, _: h - placed(h)["h"])
    out = _let(height, placed)
    return F.degrees(out["lon"]), F.degrees(out["lat"])


def transform(g: Column, srid: int) -> Column:
    """The geometry in another system: 4326 to 5514 and back, by the shift between their ellipsoids and the projection, or to its own; NULL for others."""

    def moved(p):
        lon, lat = to_bessel(p["x"], p["y"])

        def projected(q):
            e, n = krovak(q["lon"], q["lat"])
            return F.struct(e.alias("x"), n.alias("y"))

        return _let(F.struct(lon.alias("lon"), lat.alias("lat")), projected)

    def back(p):
        def unprojected(q):
            lon, lat = from_bessel(q["lon"], q["lat"])
            return F.struct(lon.alias("x"), lat.alias("y"))

        lon, lat = from_krovak(p["x"], p["y"])
        return _let(F.struct(lon.alias("lon"), lat.alias("lat")), unprojected)

    def all_of(f):
        parts = F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, f)))
        return F.struct(g["kind"].alias("kind"), F.lit(srid).alias("srid"), parts.alias("parts")).cast(GEOMETRY)

    out = F.when(g["srid"] == srid, g)
    if srid == 5514:
        out = out.when(g["srid"] == 4326, all_of(moved))
    if srid == 4326:
        out = out.when(g["srid"] == 5514, all_of(back))
    return out


def geojson(g: Column, properties: Column) -> Column:
    """A Feature as text."""
    pair = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    parts = F.transform(g["parts"], lambda p: F.transform(p, pair))
    one = F.get(parts, F.lit(0))
    line = F.get(one, F.lit(0))
    name = F.element_at(F.create_map(*[F.lit(v) for kv in (("POINT", "Point"), ("LINESTRING", "LineString"), ("POLYGON", "Polygon"), ("MULTILINESTRING", "MultiLineString"), ("MULTIPOLYGON", "MultiPolygon")) for v in kv]), g["kind"])
    coordinates = (
        F.when(g["kind"] == "POINT", F.to_json(F.get(line, F.lit(0))))
        .when(g["kind"] == "LINESTRING", F.to_json(line))
        .when(g["kind"] == "POLYGON", F.to_json(one))
        .when(g["kind"] == "MULTILINESTRING", F.to_json(F.flatten(parts)))
        .otherwise(F.to_json(parts))
    )
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":{"type":"'), name, F.lit('","coordinates":'), coordinates, F.lit("}}"))


def srid_of(df: DataFrame, column: str) -> DataFrame:
    """(srid): the systems of a geometry column's values, each once."""
    return df.select(F.col(column)["srid"].alias("srid")).where("srid IS NOT NULL").distinct()


def z_order(columns: list[Column], bits: int = 16) -> Column:
    """One number of several whole numbers from 0 to 2**bits - 1, their bits in turn: what is near in all columns is mostly near in it."""
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        for k, c in enumerate(columns):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("bigint"), i).bitwiseAND(F.lit(1).cast("bigint")), i * len(columns) + k))
    return out
