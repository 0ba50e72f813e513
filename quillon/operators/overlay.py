"""Polygon overlay: buffer, intersection, difference and union that give polygons.

Edges are rows. Spark deals those of a result into upright strips of like many corners; in each strip a sweep finds what lies inside and emits directed border pieces; the pieces of
all strips of a result are stitched to rings. A strip knows nothing of the others: what two strips say about the line between them is summed when rings are stitched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import GEOMETRY, once, outline

#: Corners of a strip, and most strips of one result.
CORNERS, STRIPS = 64, 256
#: Coordinates are whole multiples of 1 / PLACES.
PLACES = 1_000_000


def _snapped(rows: DataFrame) -> DataFrame:
    whole = lambda c: F.round(F.col(c) * PLACES).cast("bigint").alias(c)
    return rows.select("key", "tag", *[whole(c) for c in ("x1", "y1", "x2", "y2")]).where("x1 <> x2 OR y1 <> y2")


def edges(df: DataFrame, key: str, geometry: str, tag: int) -> DataFrame:
    """(key, tag, x1, y1, x2, y2): the edges of each polygon, in whole units of 1 / PLACES."""
    rows = once(df, "_o", outline(F.col(geometry))).select(F.col(key).alias("key"), F.lit(tag).alias("tag"), F.explode("_o").alias("e"))
    return _snapped(rows.select("key", "tag", *[F.col(f"e.{p}.{c}").alias(f"{c}{i}") for i, p in ((1, "a"), (2, "b")) for c in ("x", "y")]))


def capsules(df: DataFrame, key: str, geometry: str, d: float, tag: int, quarter: int = 8) -> DataFrame:
    """The edges of what lies within d of each edge of a geometry, one convex ring, counter-clockwise, for each: two half circles of 2 * quarter chords each, with corners on the circle."""
    rows = once(df, "_o", outline(F.col(geometry))).select(F.col(key).alias("key"), F.explode("_o").alias("e"))
    along = F.atan2(F.col("e.b.y") - F.col("e.a.y"), F.col("e.b.x") - F.col("e.a.x"))

    def half(centre: str, start: float) -> Column:
        turn = lambda i: F.col("_t") + (start + np.pi / 2 / quarter * i)
        return F.transform(F.sequence(F.lit(0), F.lit(2 * quarter)), lambda i: F.struct((F.col(f"e.{centre}.x") + d * F.cos(turn(i))).alias("x"), (F.col(f"e.{centre}.y") + d * F.sin(turn(i))).alias("y")))

    ring = F.concat(half("b", -np.pi / 2), half("a", np.pi / 2))
    rows = once(once(rows, "_t", along), "_r", ring)
    sides = F.zip_with("_r", F.concat(F.slice("_r", 2, 4 * quarter + 1), F.slice("_r", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.select("key", F.lit(tag).alias("tag"), F.explode(sides).alias("e"))
    return _snapped(rows.select("key", "tag", *[F.col(f"e.{p}.{c}").alias(f"{c}{i}") for i, p in ((1, "a"), (2, "b")) for c in ("x", "y")]))


def _crossings(x1, y1, x2, y2, low: float, high: float) -> np.ndarray:
    """The places between two lines where any two edges cross; edges go from left to right."""
    out, slope = [], (y2 - y1) / (x2 - x1)
    for k in range(0, len(x1), 512):  # 512 edges against all: bounded, whatever their number
        i = slice(k, k + 512)
        left, right = np.maximum(x1[i, None], x1[None]), np.minimum(x2[i, None], x2[None])
        a, b = np.nonzero((left < right) & (np.arange(len(x1))[i, None] < np.arange(len(x1))[None]))
        left, right = left[a, b], right[a, b]
        a += k
        gap = lambda x, a=a, b=b: (y1[a] + (x - x1[a]) * slope[a]) - (y1[b] + (x - x1[b]) * slope[b])
        here, there = gap(left), gap(right)
        cut = here * there < 0
        out.append((left + (right - left) * here / np.where(cut, here - there, 1))[cut])
    x = np.concatenate(out) if out else np.zeros(0)
    return x[(x > low) & (x < high)]


def strip_pieces(x1, y1, x2, y2, tag, low: float, high: float, inside: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """The border pieces of what is inside between two upright lines: rows of x, y, x, y, edge, with the inside on the left, and for upright ones edge -1 and a sign in a sixth column.

    inside: for each combination of tags (a bit each) whether it is in the result. counted: tags whose rings add up (inside where the sum is not zero); others are inside an odd number of rings.
    """
    up = x2 > x1
    sign = np.where(up, 1, -1)
    x1, y1, x2, y2 = np.where(up, x1, x2), np.where(up, y1, y2), np.where(up, x2, x1), np.where(up, y2, y1)
    slope = (y2 - y1) / (x2 - x1)
    at = np.concatenate([[low, high], x1, x2, _crossings(x1, y1, x2, y2, low, high)])
    at = np.unique(at[(at >= low) & (at <= high)])

    def height(e: np.ndarray, x: float) -> np.ndarray:
        return np.where(x1[e] == x, y1[e], np.where(x2[e] == x, y2[e], y1[e] + (x - x1[e]) * slope[e]))

    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        e = np.flatnonzero((x1 <= a) & (x2 >= b))
        if not len(e):
            continue
        y = height(e, (a + b) / 2)
        order = np.argsort(y, kind="stable")
        e, y = e[order], y[order]
        code = np.zeros(len(e), np.int64)
        for t in range(len(counted)):
            n = np.cumsum(np.where(tag[e] == t, sign[e] if counted[t] else 1, 0))
            code |= ((n != 0) if counted[t] else (n % 2 == 1)).astype(np.int64) << t
        last = np.append(np.diff(y) > 1e-6, True)  # of edges that lie on each other only the last one's count matters
        within = inside[code[last]]
        first = np.flatnonzero(np.append(True, last[:-1]))
        change = within != np.append(False, within[:-1])
        edge = e[first[change]]
        here, there = np.rint(height(edge, a)), np.rint(height(edge, b))
        xa, xb = np.full(len(edge), np.rint(a)), np.full(len(edge), np.rint(b))
        lower = np.arange(len(edge)) % 2 == 0
        pieces = np.stack([np.where(lower, xa, xb), np.where(lower, here, there), np.where(lower, xb, xa), np.where(lower, there, here), edge, np.zeros(len(edge))], axis=1)
        out.append(pieces[xa != xb])
        out += [_upright(xb[::2], there[::2], there[1::2], 1), _upright(xa[::2], here[::2], here[1::2], -1)]
        if (xa == xb).any():  # a slab thinner than a unit
            out.append(_upright(pieces[:, 0], pieces[:, 1], pieces[:, 3], 1))
    return np.concatenate(out) if out else np.zeros((0, 6))


def _upright(x, low, high, sign: int) -> np.ndarray:
    down = high < low
    return np.stack([x, np.where(down, high, low), x, np.where(down, low, high), np.full(len(x), -1.0), np.where(down, -sign, sign)], axis=1)[low != high]


def _summed(pieces: np.ndarray) -> np.ndarray:
    """Upright pieces summed on each line: what is left of those that go up and down, directed, with edge -1."""
    out = []
    if not len(pieces):
        return np.zeros((0, 5))
    order = np.argsort(pieces[:, 0], kind="stable")
    pieces = pieces[order]
    for line in np.split(pieces, np.flatnonzero(np.diff(pieces[:, 0])) + 1):
        ends = np.unique(line[:, [1, 3]])
        total = np.zeros(len(ends))
        np.add.at(total, np.searchsorted(ends, line[:, 1]), line[:, 5])
        np.add.at(total, np.searchsorted(ends, line[:, 3]), -line[:, 5])
        total = np.cumsum(total)[:-1]
        for k in np.flatnonzero(total).tolist():
            a, b = (ends[k], ends[k + 1]) if total[k] > 0 else (ends[k + 1], ends[k])
            out += [(line[0, 0], a, line[0, 0], b, -1.0)] * int(abs(total[k]))
    return np.array(out).reshape(-1, 5)


def rings(pieces: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed pieces (x, y, x, y, edge), the inside on the left. Where rings touch, each keeps to its own side; corners within an edge, or an upright line, are left out."""
    leaving = defaultdict(list)
    for i, (x, y) in enumerate(pieces[:, :2].tolist()):
        leaving[x, y].append(i)
    used, out, rows = np.zeros(len(pieces), bool), [], pieces.tolist()
    for start in range(len(rows)):
        if used[start]:
            continue
        i, line = start, []
        while not used[i]:
            used[i] = True
            line.append(i)
            ax, ay, bx, by, _ = rows[i]
            free = [j for j in leaving[bx, by] if not used[j]]
            if not free:
                break
            if len(free) > 1:
                back = np.arctan2(ay - by, ax - bx)
                turn = [(back - np.arctan2(rows[j][3] - by, rows[j][2] - bx)) % (2 * np.pi) or 2 * np.pi for j in free]
                i = free[int(np.argmin(turn))]
            else:
                i = free[0]
        kept = [rows[i][:2] for k, i in enumerate(line) if rows[i][4] != rows[line[k - 1]][4]]
        kept = [p for k, p in enumerate(kept) if not _straight(kept[k - 1], p, kept[(k + 1) % len(kept)])]
        if len(kept) > 2:
            out.append(np.array(kept))
    return out


def _straight(a: list[float], b: list[float], c: list[float]) -> bool:
    """Whether a border runs straight through b, exactly: corners are whole numbers."""
    (ax, ay), (bx, by), (cx, cy) = (map(int, p) for p in (a, b, c))
    return (bx - ax) * (cy - by) == (by - ay) * (cx - bx) and (bx - ax) * (cx - bx) + (by - ay) * (cy - by) > 0


def _ring_area(r: np.ndarray) -> float:
    r = r - r[0]
    return float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum() / 2)


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    cut = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[cut], b[cut]
    return bool((a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]) > x).sum() % 2)


def polygons(pieces: np.ndarray) -> list[list[np.ndarray]]:
    """Outer rings, counter-clockwise, each with its holes."""
    whole = np.concatenate([pieces[pieces[:, 4] >= 0][:, :5], _summed(pieces[pieces[:, 4] < 0])])
    found = [(r, _ring_area(r)) for r in rings(whole)]
    outer = sorted(([r] for r, a in found if a > 0), key=lambda p: abs(_ring_area(p[0])))
    for r, a in found:
        if a < 0:
            step = r[1] - r[0]
            side = (r[0] + r[1]) / 2 + np.array([-step[1], step[0]]) / np.hypot(*step) / 4  # just inside what the hole bounds
            next((p for p in outer if _holds(p[0], *side)), [[]]).append(r)
    return sorted(outer, key=lambda p: p[0].min(axis=0).tolist())


def combined(rows: DataFrame, rule: Callable[..., bool], tags: int, counted: tuple[int, ...] = (), srid: int = 0) -> DataFrame:
    """(key, way) for each key of some edges (see edges() and capsules()): the polygons of all places for which the rule, of a truth value for each tag, holds; without any, a geometry of no parts.

    A geometry with a null or empty shape has no edges of that tag, so it is nowhere inside. Corners move by half a unit of 1 / PLACES at most. No edges give no rows.
    """
    kind = rows.schema["key"].dataType
    inside = np.array([bool(rule(*[bool(m >> t & 1) for t in range(tags)])) for m in range(1 << tags)])
    adds = np.array([t in counted for t in range(tags)])
    assert not inside[0], "a result without bounds has no polygon"
    slanted = rows.where("x1 <> x2")  # upright edges are what is left between their neighbours
    corners = rows.groupBy("key").agg(F.array_sort(F.collect_set("x1")).alias("xs"))
    n = F.size("xs")
    step = F.greatest(F.ceil(n / F.least(F.lit(STRIPS), F.greatest(F.lit(1), F.floor(n / CORNERS)))), F.lit(1))
    cuts = F.filter("xs", lambda x, i: (i % step == 0) | (i == n - 1))
    bounds = once(corners, "cuts", cuts).select(F.col("key").alias("_key"), "cuts")
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    dealt = slanted.join(bounds, F.col("key").eqNullSafe(F.col("_key")))
    over = lambda i: F.struct(F.get("cuts", i).alias("low"), F.get("cuts", i + 1).alias("high"))
    strips = F.filter(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), over), lambda s: (s["high"] > low) & (s["low"] < high))
    dealt = dealt.where(F.size("cuts") > 1).select("key", "tag", "x1", "y1", "x2", "y2", F.explode(strips).alias("s")).select("key", "tag", "x1", "y1", "x2", "y2", "s.low", "s.high")

    def sweep(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("tag", "x1", "y1", "x2", "y2")])  # the same pieces, whatever order a shuffle gives
        column = lambda c: table.column(c).to_numpy().astype(float)
        origin = float(table.column("low")[0].as_py()), float(table.column("y1").to_numpy().min())  # near zero the sums are the more exact
        x1, x2, y1, y2 = column("x1") - origin[0], column("x2") - origin[0], column("y1") - origin[1], column("y2") - origin[1]
        pieces = strip_pieces(x1, y1, x2, y2, table.column("tag").to_numpy(), 0.0, table.column("high")[0].as_py() - origin[0], inside, adds)
        # an edge is known by its line, so that its pieces in several strips are one
        edge = pieces[:, 4].astype(int)
        name = np.where(edge >= 0, _names(table)[edge] if len(table) else 0, -1)
        whole = [np.rint(pieces[:, i] + origin[i % 2]).astype(np.int64) for i in range(4)]
        key = pa.array([table.column("key")[0].as_py()] * len(pieces), table.schema.field("key").type)
        return pa.table([key, *map(pa.array, whole), pa.array(name, pa.int64()), pa.array(pieces[:, 5].astype(np.int32))], names=["key", "x1", "y1", "x2", "y2", "edge", "sign"])

    def stitch(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2", "edge", "sign")], axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]
        origin = rows[:, :2].min(axis=0)
        rows[:, :4] -= np.tile(origin, 2)
        _, short = np.unique(rows[:, 4], return_inverse=True)  # names of edges are long, and floats hold 53 bits
        upright = rows[:, 4] < 0
        rows = rows.astype(float)
        rows[:, 4] = np.where(upright, -1, short)
        point = lambda p: {"x": (p[0] + int(origin[0])) / PLACES, "y": (p[1] + int(origin[1])) / PLACES}
        parts = [[[point(p) for p in [*map(tuple, r.astype(int).tolist()), tuple(r[0].astype(int).tolist())]] for r in one] for one in polygons(rows)]
        ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.table([table.column("key").slice(0, 1), pa.array([parts], pa.list_(pa.list_(ring)))], names=["key", "parts"])

    pieces = dealt.groupBy("key", "low", "high").applyInArrow(sweep, f"key {kind.simpleString()}, x1 bigint, y1 bigint, x2 bigint, y2 bigint, edge bigint, sign int")
    found = pieces.groupBy("key").applyInArrow(stitch, f"key {kind.simpleString()}, parts array<array<array<struct<x: double, y: double>>>>").withColumnRenamed("key", "_of")
    parts = F.coalesce("parts", F.array().cast("array<array<array<struct<x: double, y: double>>>>"))
    way = F.struct(F.when(F.size("parts") == 1, "POLYGON").otherwise("MULTIPOLYGON").alias("kind"), F.lit(srid).alias("srid"), F.col("parts")).cast(GEOMETRY)
    return corners.select("key").join(found, F.col("key").eqNullSafe(F.col("_of")), "left").select("key", parts.alias("parts")).select("key", way.alias("way"))


def _names(table: pa.Table) -> np.ndarray:
    """A number, not negative, for each edge, from its ends alone."""
    h = np.zeros(len(table), np.uint64)
    with np.errstate(over="ignore"):
        for c in ("x1", "y1", "x2", "y2"):
            h = (h ^ table.column(c).to_numpy().astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).astype(np.int64)


def intersection(pairs: DataFrame, key: str, a: str, b: str, srid: int = 0) -> DataFrame:
    """(key, way): what two polygons of a row share."""
    return combined(edges(pairs, key, a, 0).union(edges(pairs, key, b, 1)), lambda a, b: a and b, 2, srid=srid)


def difference(pairs: DataFrame, key: str, a: str, b: str, srid: int = 0) -> DataFrame:
    """(key, way): what is in the first polygon of a row and not in the second."""
    return combined(edges(pairs, key, a, 0).union(edges(pairs, key, b, 1)), lambda a, b: a and not b, 2, srid=srid)


def union(rows: DataFrame, key: str, geometry: str, srid: int = 0) -> DataFrame:
    """(key, way): all polygons of a key in one, from rows whose rings go counter-clockwise around what is inside (holes the other way)."""
    return combined(edges(rows, key, geometry, 0), lambda a: a, 1, (0,), srid)


def zone(df: DataFrame, key: str, geometry: str, d: float, within: str | None = None, without: str | None = None, quarter: int = 8, srid: int = 0) -> DataFrame:
    """(key, way): what lies within d of a geometry, inside another one and outside a third, where they are given: buffer, intersection and difference in one sweep. Round borders have `quarter` chords in a quarter circle."""
    parts = [capsules(df, key, geometry, d, 0, quarter), edges(df.where(F.col(f"{geometry}.kind").isin("POLYGON", "MULTIPOLYGON")), key, geometry, 1)]
    parts += [edges(df, key, c, t) for t, c in ((2, within), (3, without)) if c]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return combined(rows, lambda near, core, there, gone: (near or core) and (there or not within) and not gone, 4, (0,), srid)
