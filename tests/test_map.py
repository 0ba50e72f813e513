"""Map extracts: files written here by the format's public description, read in ranges of any length, and made to layers."""

import datetime
import os
import random
import struct
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.operators import features
from quillon.operators import spatial as G
from quillon.operators.relational import asc
from quillon.plans.catalogue import QUERIES
from quillon.sources.footers import footers, pages
from quillon.sources.layers import import_map, read_layer
from quillon.sources.pbf import packed, read_pbf, signed


def varint(v):
    v &= (1 << 64) - 1
    out = bytearray()
    while True:
        out.append(v & 127 | (128 if v > 127 else 0))
        v >>= 7
        if not v:
            return bytes(out)


def zig(v):
    return v << 1 if v >= 0 else (-v << 1) - 1


def field(n, v):
    return varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v


def many(values):
    return b"".join(map(varint, values))


def steps(values):
    return many(zig(b - a) for a, b in zip([0, *values], values))


def block(groups, strings, pack="zlib", kind=b"OSMData", extra=b""):
    table = b"".join(field(1, s.encode()) for s in strings)
    content = field(1, table) + b"".join(field(2, g) for g in groups) + extra
    blob = field(1, content) if pack == "plain" else field(2, len(content)) + field(3, zlib.compress(content))
    head = field(1, kind) + field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


class Words(list):
    def at(self, s):
        if s not in self:
            self.append(s)
        return self.index(s)


def extract(path, nodes, ways, relations, per_block=5, dense=True):
    """nodes: (id, lon, lat, tags) in steps of 100 billionths; ways: (id, refs, tags); relations: (id, [(kind, ref, role)], tags)."""
    out = [block([], [""], kind=b"OSMHeader")]
    for k in range(0, len(nodes), per_block):
        some, words = nodes[k : k + per_block], Words([""])
        if dense:
            pairs = [x for *_, tags in some for x in [*(i for kv in tags.items() for i in map(words.at, kv)), 0]]
            group = field(2, field(1, steps([n[0] for n in some])) + field(8, steps([n[2] for n in some])) + field(9, steps([n[1] for n in some])) + (field(10, many(pairs)) if any(pairs) else b""))
        else:
            group = b"".join(field(1, field(1, zig(i)) + field(2, many(map(words.at, t))) + field(3, many(map(words.at, t.values()))) + field(8, zig(lat)) + field(9, zig(lon))) for i, lon, lat, t in some)
        out.append(block([group], words, pack="plain" if k % 2 else "zlib"))
    words = Words([""])
    rows = [field(3, field(1, i) + field(2, many(map(words.at, t))) + field(3, many(map(words.at, t.values()))) + field(8, steps(refs)) + field(4, field(1, 3))) for i, refs, t in ways]
    number = {"node": 0, "way": 1, "relation": 2}
    more = [field(4, field(1, i) + field(2, many(map(words.at, t))) + field(3, many(map(words.at, t.values()))) + field(8, many(words.at(r) for *_, r in m)) + field(9, steps([x[1] for x in m])) + field(10, many(number[x[0]] for x in m))) for i, m, t in relations]
    path.write_bytes(b"".join([*out, block([b"".join(rows), b"".join(more)], words)]))
    return path


def test_integers():
    rng = random.Random(5)
    values = [0, 1, -1, 127, 128, -(1 << 62), (1 << 62) - 1, *(rng.randrange(-(1 << 40), 1 << 40) for _ in range(500))]
    assert signed(packed(memoryview(many(map(zig, values))))).tolist() == values
    assert packed(memoryview(b"")).tolist() == []


@pytest.mark.parametrize("dense", [True, False])
def test_any_range_reads_every_element_once(spark, tmp_path, dense):
    rng = random.Random(dense)
    nodes = [(rng.randrange(1, 1 << 40), rng.randrange(-1_800_000_000, 1_800_000_000), rng.randrange(-900_000_000, 900_000_000), {"name": "Übergang", "ele": str(k)} if k % 3 == 0 else {}) for k in range(23)]
    ways = [(7, [nodes[4][0], nodes[2][0], nodes[4][0]], {"highway": "track"}), (8, [], {})]
    extract(tmp_path / "a.pbf", nodes, ways, [(9, [("way", 7, "outer"), ("node", nodes[0][0], ""), ("relation", 3, "sub")], {"type": "site"})], dense=dense)
    (tmp_path / "empty.pbf").write_bytes(b"")
    for split in (64, 333, 1 << 20):
        got = read_pbf(spark, str(tmp_path), split).collect()
        assert sorted((r.id, r.x, r.y, tuple(r.tags.items())) for r in got if r.kind == "node") == sorted((i, lon * 100 / 1e9, lat * 100 / 1e9, tuple(t.items())) for i, lon, lat, t in nodes)
        assert sorted((r.id, r.refs, r.version) for r in got if r.kind == "way") == [(7, ways[0][1], 3), (8, [], 3)]
        [told] = [r for r in got if r.kind == "relation"]
        assert [tuple(m) for m in told.members] == [("way", 7, "outer"), ("node", nodes[0][0], ""), ("relation", 3, "sub")] and told.tags == {"type": "site"}


def test_a_cut_file_is_an_error(spark, tmp_path):
    whole = extract(tmp_path / "a.pbf", [(k + 1, k, k, {}) for k in range(40)], [], []).read_bytes()
    (tmp_path / "a.pbf").write_bytes(whole[:-9])
    for split in (64, 1 << 20):
        with pytest.raises(Exception, match="no whole block"):
            read_pbf(spark, str(tmp_path), split).collect()


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
HOLE = [(2, 2), (2, 8), (8, 8), (8, 2)]
ISLAND = [(4, 4), (6, 4), (6, 6), (4, 6)]
FAR = [(20, 0), (30, 0), (30, 10)]


@pytest.fixture(scope="module")
def target(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("map")
    at, nodes = {}, []
    for k, (x, y) in enumerate(SQUARE + HOLE + ISLAND + FAR, 1):
        at[x, y] = k
        nodes.append((k, x * 10**7, y * 10**7, {"name": "corner"} if k == 1 else {}))
    ids = lambda ring: [at[p] for p in ring]
    s, h, i, f = map(ids, (SQUARE, HOLE, ISLAND, FAR))
    ways = [
        (101, [s[2], s[3], s[0]], {}), (102, [s[2], s[1], s[0]], {}),  # the square by halves, one of them backwards
        (103, [*h, h[0]], {}), (104, [*i, i[0]], {"building": "yes"}), (105, [*f, f[0]], {"highway": "primary"}), (106, [s[0], h[0], 999], {"railway": "rail"}),
        (107, [*f, f[0]], {"area": "yes", "highway": "pedestrian"}), (108, [s[0], 998], {"highway": "motorway"}), (109, [s[0], s[2]], {"highway": "path"}), (110, [*h, h[0]], {"building": "yes", "area": "no"}),
    ]
    relations = [
        (201, [("way", 101, "outer"), ("way", 103, "inner"), ("way", 102, "outer"), ("way", 104, ""), ("way", 105, "outer"), ("way", 101, "outer"), ("node", 1, "label")], {"type": "boundary", "boundary": "administrative", "admin_level": "4", "name": "Region"}),
        (202, [("way", 101, "outer"), ("way", 106, "outer")], {"type": "multipolygon", "landuse": "forest"}), (203, [("way", 109, ""), ("way", 106, "")], {"type": "route", "name": "Trail"}), (204, [("way", 101, "outer")], {"type": "site"}),
    ]
    extract(folder / "a.pbf", nodes, ways, relations, dense=True)
    extract(folder / "b.pbf", nodes[:6], ways[:3], relations[:1], dense=False)  # an extract that overlaps the first
    counts = import_map(spark, str(folder), str(folder / "out"), files=2, split=200)
    return str(folder / "out"), counts


def told(spark, target, name):
    rows = read_layer(spark, f"{target[0]}/{name}")
    return {r.osm_id: (r.kind, r.tags, r.wkt) for r in rows.select("osm_id", "tags", "geometry.kind", G.as_wkt(F.col("geometry")).alias("wkt")).collect()}


def test_layers(spark, target):
    assert target[1] == {"point": 1, "line": 6, "polygon": 3, "roads": 3}
    assert told(spark, target, "point") == {1: ("POINT", {"name": "corner"}, "POINT(0 0)")}
    lines = told(spark, target, "line")
    assert sorted(lines) == [-203, -201, 105, 106, 109, 110]
    assert lines[106][2] == "LINESTRING(0 0,2 2)" and lines[-203][2] == "MULTILINESTRING((0 0,10 10),(0 0,2 2))"
    assert sorted(told(spark, target, "roads")) == [-201, 105, 106]


def test_polygons(spark, target):
    rows = read_layer(spark, f"{target[0]}/polygon").select("osm_id", G.area(F.col("geometry")).alias("area"), F.size("geometry.parts").alias("parts"), F.size(F.flatten("geometry.parts")).alias("rings"))
    assert sorted(map(tuple, rows.collect())) == [(-201, 100 - 36 + 4 + 50, 3, 4), (104, 4, 1, 1), (107, 50, 1, 1)]


def test_regions_by_level(spark, target):
    """The study's first question: regions of a level with their centroids."""
    found = read_layer(spark, f"{target[0]}/polygon").where(F.col("tags")["admin_level"] == "4").orderBy(asc("osm_id"))
    [row] = found.select(F.col("tags")["name"].alias("name"), G.centroid(F.col("geometry")).alias("c")).select("name", G.x(F.col("c")).alias("x"), G.y(F.col("c")).alias("y")).collect()
    # the square less its hole and with its island lies around (5, 5), the triangle around (80 / 3, 10 / 3)
    assert row.name == "Region" and row.x == pytest.approx((68 * 5 + 50 * 80 / 3) / 118) and row.y == pytest.approx((68 * 5 + 50 * 10 / 3) / 118)


def test_rings_of_random_pieces():
    """Rings cut into pieces at random, turned and shuffled, with dead ends between them: all come back, whole."""
    rng = random.Random(3)
    for _ in range(60):
        ways, area, node = [], 0, 0
        for k in range(rng.randint(1, 5)):
            n = rng.randint(3, 12)
            ids = list(range(node, node + n))
            node += n
            side = rng.randint(1, 4)
            corners = [(20 * k, 0), (20 * k + side, 0), (20 * k + side, side), *((20 * k + side * (1 - (i + 1) / (n - 2)), side) for i in range(n - 3))]
            closed, places = [*ids, ids[0]], [*corners, corners[0]]
            area += abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(places, places[1:]))) / 2
            cuts = sorted({0, n, *rng.sample(range(1, n), rng.randint(0, n - 1))})
            for a, b in zip(cuts, cuts[1:]):
                piece = closed[a : b + 1], places[a : b + 1]
                ways.append(piece if rng.random() < 0.5 else (piece[0][::-1], piece[1][::-1]))
            ways.append(([rng.choice(ids), 10_000 + k], [(0, 0), (1, 1)]))
        rng.shuffle(ways)
        parts = features.nested(features.rings(ways))
        assert sum(abs(features._area(features.np.array(r))) for p in parts for r in p) == pytest.approx(area)


def test_pages_say_what_they_hold(spark, tmp_path):
    """Every page's rows, NULLs and bounds against the rows themselves, for each type of column."""
    path = str(tmp_path / "t")
    rows = spark.range(0, 3000, 1, 2).select(
        F.when(F.col("id") % 7 > 0, F.col("id") * -3).alias("big"), (F.col("id") % 1000).cast("int").alias("small"), (F.col("id") / 8 - 99).alias("real"), F.when((F.col("id") > 600), F.format_string("ž%05d", "id")).alias("text"),
        F.date_add(F.lit("1969-12-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") / 100 - 7).cast("decimal(9,2)").alias("price"), (F.col("id") / 100 - 7).cast("decimal(25,3)").alias("wide"),
        F.timestamp_micros(F.col("id") * 1_000_001).cast("timestamp_ntz").alias("at"), (F.col("id") % 2 == 0).alias("even"), F.struct((F.col("id") + 5).alias("inner")).alias("held"),
    )
    rows.write.option("parquet.page.row.count.limit", 200).option("parquet.block.size", 1 << 14).parquet(path)
    told = pages(spark, path).collect()
    seen = 0
    for file in sorted({r.file for r in told}):
        read = pq.ParquetFile(f"{path}/{file}")
        for g in range(read.num_row_groups):
            held = read.read_row_group(g)
            for name in ("big", "small", "real", "text", "day", "price", "wide", "at", "even", "held.inner"):
                mine = sorted((r for r in told if (r.file, r.row_group, r.column) == (file, g, name)), key=lambda r: r.page)
                values = held.column(name).to_pylist() if "." not in name else [v["inner"] for v in held.column("held").to_pylist()]
                assert sum(r.row_count for r in mine) == len(values)
                for r in mine:
                    some = values[r.first_row : r.first_row + r.row_count]
                    full = [v for v in some if v is not None]
                    as_text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
                    assert (r.nulls, r.low, r.high) == (len(some) - len(full), *((as_text(min(full)), as_text(max(full))) if full else (None, None)))
                    seen += 1
    assert seen >= 150 and len({r.file for r in told}) == 2 and any(r.low is None for r in told if r.column == "text")
    groups = footers(spark, path).where("column = 'day'").agg(F.min("low"), F.max("high"), F.sum("row_count")).first()
    assert tuple(groups) == ("1969-12-01", str(datetime.date(1969, 12, 1) + datetime.timedelta(2999)), 3000)
    whole = {r.column: r for r in footers(spark, path).groupBy("column").agg(F.min(F.col("low").try_cast("double")).alias("low"), F.max(F.col("high").try_cast("double")).alias("high")).collect()}
    assert (whole["big"].low, whole["big"].high, whole["wide"].low, whole["price"].high) == (-3 * 2999, -3, -7, 22.99)


def test_pages_of_a_clustered_table(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    customer = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").agg(F.count("*"), F.min("c_acctbal"), F.max("c_acctbal"), F.min("c_custkey"), F.max("c_custkey")).first()
    got = {r.column: r for r in QUERIES["clustered_pages"](spark, "/root/testdata/sf0.01").collect()}
    assert sorted(got) == ["c_acctbal", "c_custkey", "c_name"] and all((r.row_count, r.nulls) == (customer[0], 0) for r in got.values())
    assert (got["c_acctbal"].least, got["c_acctbal"].most) == tuple(map(float, customer[1:3])) and (got["c_custkey"].least, got["c_custkey"].most) == tuple(customer[3:])
    assert 1 <= got["c_acctbal"].pages_100_to_200 < got["c_acctbal"].pages / 2
