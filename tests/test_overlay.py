"""Polygon overlay, the edge index and the joins of lines, against plain arithmetic, grids of points and all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import overlay as O
from quillon.operators import spatial as G
from quillon.operators import spatial_joins as J
from quillon.operators.wkb import as_wkb, from_wkb
from quillon.plans import layout
from quillon.plans.catalogue import QUERIES
from quillon.sources.layers import read_geojson, read_layer, write_layer

SF = "/root/testdata/sf0.001"


def wkt(*rings):
    return "POLYGON(" + ",".join("(" + ",".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"


def star(rnd, n, cx=0.0, cy=0.0, least=3.0, most=10.0):
    """A ring without crossings around a centre, counter-clockwise."""
    return [(cx + (s := rnd.uniform(least, most)) * math.cos(2 * math.pi * k / n), cy + s * math.sin(2 * math.pi * k / n)) for k in range(n)]


def odd(rings, x, y):
    """Which of some points are inside rings, by crossings."""
    out = np.zeros(len(x), bool)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if ay != by:
                out ^= ((ay > y) != (by > y)) & (ax + (y - ay) * (bx - ax) / (by - ay) > x)
    return out


def from_border(rings, x, y):
    best = np.full(len(x), np.inf)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n, 0, 1) if n else 0
            best = np.minimum(best, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return best


def shapes(df):
    """key: the rings of each part of the result, closing points left out; each outer ring counter-clockwise, its holes the other way."""
    out = {}
    for r in df.collect():
        parts = [[[(p.x, p.y) for p in ring][:-1] for ring in part] for part in r.way.parts]
        for part in parts:
            for k, ring in enumerate(part):
                turn = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))
                assert len(ring) > 2 and (turn > 0) == (k == 0)
        assert r.way.kind == ("POLYGON" if len(parts) == 1 else "MULTIPOLYGON")
        out[r.key] = parts
    return out


def agrees(parts, x, y, want, skip):
    """No point is in two parts, and those are in one that should be."""
    each = [odd(p, x, y) for p in parts]
    n = sum(e.astype(int) for e in each) if each else np.zeros(len(x), int)
    assert (n[~skip] == want[~skip]).all()


@pytest.fixture(scope="module")
def grid():
    x, y = np.meshgrid(np.linspace(-14.03, 14.07, 57), np.linspace(-14.01, 14.05, 61))
    return x.ravel(), y.ravel()


def test_random_polygons_against_a_grid_of_points(spark, grid):
    rnd, (x, y), rows, plain = random.Random(4), grid, [], {}
    for k in range(14):
        a = [star(rnd, rnd.choice([3, 8, 40, 150]))] + ([star(rnd, 9, 0, 0, 0.5, 1.5)[::-1]] if k % 2 else [])
        b = [star(rnd, rnd.choice([4, 12, 90]), rnd.uniform(-5, 5), rnd.uniform(-5, 5))]
        if k % 3 == 0:
            b = [[(round(px), round(py)) for px, py in b[0]]]  # corners and edges on whole numbers, some upright
            a = [[(round(px), round(py)) for px, py in r] for r in a]
        plain[k] = a, b
        rows.append((k, wkt(*a), wkt(*b)))
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(3)
    df = G.parsed_wkt(G.parsed_wkt(df, "a", 5514, "ga"), "b", 5514, "gb")
    both, less = shapes(O.intersection(df, "k", "ga", "gb")), shapes(O.difference(df, "k", "ga", "gb"))
    area = lambda parts: sum(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1])) / 2 for p in parts for r in p)
    for k, (a, b) in plain.items():
        near = np.minimum(from_border(a, x, y), from_border(b, x, y)) < 1e-5
        agrees(both[k], x, y, odd(a, x, y) & odd(b, x, y), near)
        agrees(less[k], x, y, odd(a, x, y) & ~odd(b, x, y), near)
    total = {r.k: r.s for r in df.select("k", G.area(F.col("ga")).alias("s")).collect()}
    for k in range(1, 14, 3):
        assert area(both[k]) + area(less[k]) == pytest.approx(total[k], abs=1e-4)


def test_zones_against_distances(spark, grid):
    rnd, (x, y), plain = random.Random(9), grid, {}
    for k in range(6):
        plain[k] = [star(rnd, rnd.choice([3, 9, 30]))] + ([star(rnd, 7, 0, 0, 1.5, 2.5)[::-1]] if k % 2 else [])
    within = [[(-6.0, -20.0), (20.0, -20.0), (20.0, 20.0), (-6.0, 20.0)]]
    df = spark.createDataFrame([(k, wkt(*a), wkt(*within)) for k, a in plain.items()], "k int, a string, b string")
    df = G.parsed_wkt(G.parsed_wkt(df, "a", 5514, "ga"), "b", 5514, "land")
    all_of, ring = shapes(O.zone(df, "k", "ga", 1.5, quarter=16)), shapes(O.zone(df, "k", "ga", 1.5, "land", "ga", 16))
    for k, a in plain.items():
        d, core = from_border(a, x, y), odd(a, x, y)
        near = (abs(d - 1.5) < 0.01) | (d < 1e-5) | (abs(x + 6) < 1e-5)  # chords lie under the circle by 1.5 (1 - cos 2.8 degrees)
        agrees(all_of[k], x, y, core | (d < 1.5), near)
        agrees(ring[k], x, y, ~core & (d < 1.5) & (x > -6), near)


def test_overlay_cases(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rows = [
        (1, wkt(square(0, 0, 4)), wkt(square(0, 0, 4))), (2, wkt(square(0, 0, 4)), wkt(square(4, 0, 4))), (3, wkt(square(0, 0, 4)), wkt(square(4, 4, 4))), (4, wkt(square(0, 0, 9)), wkt(square(3, 3, 3))),
        (5, wkt(square(0, 0, 4)), None), (6, None, wkt(square(0, 0, 4))), (None, wkt(square(0, 0, 6), square(2, 2, 2)[::-1]), wkt(square(2, 2, 2))), (8, wkt([(0, 0), (3, 0), (3, 0), (0, 3)]), wkt(square(1, -1, 9))),
    ]
    df = G.parsed_wkt(G.parsed_wkt(spark.createDataFrame(rows, "k int, a string, b string"), "a", 1, "ga"), "b", 1, "gb")
    both, less = shapes(O.intersection(df, "k", "ga", "gb")), shapes(O.difference(df, "k", "ga", "gb"))
    assert both[1] == [[square(0, 0, 4)]] and less[1] == [] and both[2] == both[3] == [] and less[2] == less[3] == [[square(0, 0, 4)]]
    assert both[4] == [[square(3, 3, 3)]] and less[4][0][0] == square(0, 0, 9) and sorted(less[4][0][1]) == sorted(square(3, 3, 3))
    assert both[5] == both[6] == less[6] == both[None] == [] and less[5] == [[square(0, 0, 4)]]
    assert less[None][0][0] == square(0, 0, 6) and len(less[None][0]) == 2
    assert both[8] == [[[(1, 0), (3, 0), (1, 2)]]]
    one = G.parsed_wkt(spark.createDataFrame([(1, wkt(square(0, 0, 2))), (1, wkt(square(1, 0, 2))), (1, wkt(square(9, 9, 1))), (2, wkt(square(0, 0, 1)))], "k int, a string"), "a", 1, "g")
    assert shapes(O.union(one, "k", "g")) == {1: [[[(0, 0), (3, 0), (3, 2), (0, 2)]], [square(9, 9, 1)]], 2: [[square(0, 0, 1)]]}
    assert O.intersection(df.limit(0), "k", "ga", "gb").count() == 0


def test_a_long_border_is_swept_in_strips(spark):
    """Thousands of corners: many strips, one ring."""
    n = 4000
    ring = [((10 + (k % 2) / 10) * math.cos(2 * math.pi * k / n), (10 + (k % 2) / 10) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    df = G.parsed_wkt(G.parsed_wkt(spark.createDataFrame([(1, wkt(ring), wkt([(0, -20), (20, -20), (20, 20), (0, 20)]))], "k int, a string, b string"), "a", 1, "ga"), "b", 1, "gb")
    rows = O.edges(df, "k", "ga", 0)
    got = shapes(O.intersection(df, "k", "ga", "gb"))[1]
    assert rows.count() == n and len(got) == 1 and len(got[0]) == 1 and abs(len(got[0][0]) - n / 2) < 5
    halves = [r.a for r in O.intersection(df, "k", "ga", "gb").union(O.difference(df, "k", "ga", "gb")).select(G.area(F.col("way")).alias("a")).collect()]
    assert sum(halves) == pytest.approx(df.select(G.area(F.col("ga")).alias("a")).first().a, abs=1e-3) and abs(halves[0] - halves[1]) < 0.1


def test_edge_index(spark, monkeypatch):
    """Points in polygons of many corners, holes and parts, tested slab by slab, against the plain test."""
    rnd = random.Random(6)
    texts = [wkt(star(rnd, 500, 0, 0, 20, 40), star(rnd, 70, 0, 0, 3, 9)[::-1]), wkt(star(rnd, 90, 30, 30, 1, 30)), wkt([(0, 0), (9, 0), (9, 9), (0, 9)]), wkt([(round(x), round(y)) for x, y in star(rnd, 80, -10, 5, 5, 30)])]
    texts.append("MULTIPOLYGON(" + texts[0][7:] + "," + wkt(star(rnd, 66, 100, 0, 2, 5))[7:] + ")")
    df = G.parsed_wkt(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9, None, "x")], "i int, t string, `a b` string"), "t", 1)
    points = [(p, rnd.uniform(-45, 110), rnd.uniform(-45, 60)) for p in range(500)] + [(500 + p, float(rnd.randint(-40, 40)), float(rnd.randint(-40, 40))) for p in range(200)]
    where = spark.createDataFrame(points, "p int, px double, py double")
    want = sorted((r.i, r.p) for r in df.crossJoin(where).where(G.contains_point(F.col("way"), F.col("px"), F.col("py"))).collect())
    got = J.contains_join(df, where, 4.0)
    assert got.columns == ["i", "t", "a b", "p", "px", "py"] and sorted((r.i, r.p) for r in got.collect()) == want and len(want) > 200
    rows, levels = J._dealt(df, "way", 4.0)
    many = J.slabs(rows, "way", 4.0).select("i", F.size("_edges").alias("n")).groupBy("i").agg(F.max("n").alias("most"), F.sum("n").alias("all")).collect()
    assert {r.i: r.most for r in many}[0] <= 80 and max(k for _, k in levels) == 7  # of 570 edges


def test_lines_in_cells(spark):
    rnd = random.Random(8)
    line = lambda: [(x := rnd.uniform(-20, 60), y := rnd.uniform(-20, 60)), (x + rnd.choice([-1, 1]) * 2 ** rnd.uniform(-2, 6), y + rnd.choice([0, 1]) * 2 ** rnd.uniform(-2, 5))]
    text = lambda points: "LINESTRING(" + ",".join(f"{x!r} {y!r}" for x, y in points) + ")"
    roads = [(i, text(line() + ([line()[0]] if i % 4 == 0 else []))) for i in range(80)]
    lots = [(i, wkt([(x := float(rnd.randint(-20, 50)), y := float(rnd.randint(-20, 50))), (x + 2 ** rnd.randint(0, 5), y), (x + 4, y + 2 ** rnd.randint(0, 5))])) for i in range(30)]
    r, l = (G.parsed_wkt(spark.createDataFrame(rows + [(99, None)], f"{k} int, t string"), "t", 1, g) for rows, k, g in ((roads, "r", "road"), (lots, "l", "lot")))
    both = l.select("l", "lot").crossJoin(r.select("r", "road"))
    met = J.meeting(l, r, "l", "r", "lot", "road", 1.0)
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, both.where(G.borders_meet(F.col("lot"), F.col("road"))).select("l", "r").collect())) != []
    near = J.lying_near(r, l, "r", "l", "road", "lot", 3.0, 1.0)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, both.where(G.near_border(F.col("road"), F.col("lot"), 3.0)).select("r", "l").collect())) != []
    boxes = J.overlapping(l.select("l", "lot"), r.select("r", "road"), "lot", "road", 1.0)
    plain = G.once(G.once(both, "a", G.bounds(F.col("lot"))), "b", G.bounds(F.col("road"))).where("a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
    assert sorted(map(tuple, boxes.select("l.l", "r.r").collect())) == sorted(map(tuple, plain.select("l", "r").collect()))


def test_lines_of_one_file_are_spread(spark, monkeypatch):
    """A table that is one partition is worked on by many tasks, none of which gets more than SPREAD lines; few lines stay where they are."""
    monkeypatch.setattr(J, "SPREAD", 100)
    lines = lambda n: G.parsed_wkt(spark.range(0, n, 1, 1).select("id", F.concat(F.lit("LINESTRING("), F.col("id"), F.lit(" 0.5,"), F.col("id") + 1, F.lit(" 1.5)")).alias("t")), "t", 1, "g")
    sizes = J.segments(lines(2000), "id", "g").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 110
    assert J.segments(lines(1000), "id", "g").select(F.spark_partition_id()).distinct().count() == 1
    border = G.parsed_wkt(spark.createDataFrame([(7, "LINESTRING(0 0,1500 0)")], "b int, t string"), "t", 1, "border")
    assert sorted(r.id for r in J.lying_near(lines(2000), border, "id", "b", "g", "border", 1.5, 4.0).collect()) == list(range(1500))


def test_plans_parse_once_and_loop_nowhere(spark):
    for name in ("pip_join", "polygon_contains", "near_border", "longest_road", "roads_across_border", "roads_near_border", "zone_around", "overlay_plots", "border_crossed"):
        plan = layout.plan_text(QUERIES[name](spark, SF))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
        tree = plan.split("\n\n")[0]
        assert plan.count("from_json") <= tree.count("Scan parquet"), name


def test_there_and_back(spark):
    """From degrees to metres and back over a grid of the projection's country: a hundredth of a millimetre."""
    rows = [(12 + i / 4, 47.5 + j / 4) for i in range(44) for j in range(15)]
    df = spark.createDataFrame(rows, "x double, y double").withColumn("p", G.point(F.col("x"), F.col("y"), 4326))
    back = G.once(G.once(df, "m", G.transform(F.col("p"), 5514)), "b", G.transform(F.col("m"), 4326))
    far = back.select(F.max(F.abs(G.x(F.col("b")) - F.col("x")) + F.abs(G.y(F.col("b")) - F.col("y"))).alias("d"), F.max(F.col("b.srid")).alias("s")).first()
    assert far.d < 1e-10 and far.s == 4326


def test_bytes_and_features(spark, tmp_path):
    """Every kind through well-known binary and GeoJSON; bytes of either order, with heights and systems; what is broken is NULL."""
    texts = ["POINT(1 -2.5)", "LINESTRING(0 0,3 4,1e-7 2)", wkt([(0, 0), (4, 0), (4, 4)], [(1, 1), (2, 1), (2, 2)]), "MULTILINESTRING((0 0,1 0),(5 5,5 6,7 7))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((2 0,3 0,3 1,2 0),(2.2 0.1,2.3 0.1,2.3 0.2,2.2 0.1)))", None]
    df = G.parsed_wkt(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", 7, "g")
    for extended, srid in ((False, 3), (True, 7)):
        for r in df.select("g", from_wkb(as_wkb(F.col("g"), extended), 3).alias("b")).collect():
            assert (r.b and (r.b.kind, r.b.srid, r.b.parts)) == (r.g and (r.g.kind, srid, r.g.parts))
    odd = [("00000000014010000000000000C000000000000000", "POINT(4 -2)"), ("01E9030000000000000000F03F00000000000000400000000000000840", "POINT(1 2)"), ("0101", None), ("07", None), ("", None), ("0104000000", None)]
    got = spark.createDataFrame([(bytearray.fromhex(h), w) for h, w in odd], "b binary, w string").select("w", G.as_wkt(from_wkb(F.col("b"))).alias("t")).collect()
    assert all(r.w == r.t for r in got)
    lines, whole = str(tmp_path / "lines"), tmp_path / "whole"
    feature = G.geojson(F.col("g"), F.struct(F.col("i").alias("number"), F.col("t").alias("text")))
    df.where("g IS NOT NULL").select(feature).write.text(lines)
    whole.mkdir()
    (whole / "a.json").write_text('{"type": "FeatureCollection",\n "features": [' + ",\n".join(r[0] for r in df.where("g IS NOT NULL").select(feature).collect()) + ', {"type": "Feature", "properties": null, "geometry": {"type": "Point", "coordinates": [1, 2, 3]}}, {"type": "Feature", "properties": {"number": 9}, "geometry": null}]}')
    for back in (read_geojson(spark, lines, 7), read_geojson(spark, str(whole), 7, lines=False)):
        found = {r.properties["number"]: r.geometry for r in back.where("properties IS NOT NULL").collect()}
        assert {str(r.i): r.g for r in df.where("g IS NOT NULL").collect()}.items() <= found.items()
    assert [r.w for r in back.where("properties IS NULL").select(G.as_wkt(F.col("geometry")).alias("w")).collect()] == ["POINT(1 2)"] and found["9"] is None


def test_a_stored_layer_is_read_by_its_window(spark, tmp_path):
    rnd = random.Random(3)
    boxes = [(x := rnd.uniform(0, 1000), y := rnd.uniform(0, 1000), x + rnd.uniform(0, 9), y + rnd.uniform(0, 9)) for _ in range(600)]
    df = spark.createDataFrame([(i, wkt([(a, b), (c, b), (c, d), (a, d)])) for i, (a, b, c, d) in enumerate(boxes)] + [(-1, None)], "i int, t string")
    path = str(tmp_path / "layer")
    write_layer(G.parsed_wkt(df, "t", 5514, "geometry"), path, files=16)
    assert read_layer(spark, path).where("i >= 0").count() == 600 and read_layer(spark, path).where("geometry IS NULL").count() == 1
    near = read_layer(spark, path, (100, 100, 180, 160))
    assert sorted(r.i for r in near.collect()) == [i for i, (a, b, c, d) in enumerate(boxes) if a <= 180 and c >= 100 and b <= 160 and d >= 100] != []
    whole = layout.footers(spark, path).where("column IN ('x0', 'x1', 'y0', 'y1')").groupBy("file").pivot("column").agg(F.min(F.col("low").cast("double")).alias("low"), F.max(F.col("high").cast("double")).alias("high"))
    assert whole.where("x0_low <= 180 AND x1_high >= 100 AND y0_low <= 160 AND y1_high >= 100").count() <= 5  # of 16 files
    assert any("LessThanOrEqual(x0,180" in f for f in layout.pushed_filters(near))
