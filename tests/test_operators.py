import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.operators import relational as R
from quillon.operators import spatial as G
from quillon.operators import spatial_joins as J
from quillon.operators.merge import append_rows, insert_ignore, upsert_greatest
from quillon.operators import search as S
from quillon.operators.search import search, trigram_search, trigram_table
from quillon.plans.layout import pushed_filters


def vals(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_insert_ignore_nulls(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "i int, k string")
    staged = spark.createDataFrame([(3, None), (4, "a"), (5, "b"), (6, "b"), (5, "b")], "i int, k string")
    assert vals(insert_ignore(target, staged, ["k"])) == [(1, "a"), (2, None), (5, "b")]
    assert vals(insert_ignore(target, staged, ["k"], nulls_distinct=True)) == [(1, "a"), (2, None), (3, None), (5, "b")]
    once = insert_ignore(target, staged, ["k"])
    assert vals(insert_ignore(once, staged, ["k"])) == vals(once)
    assert vals(insert_ignore(target.limit(0), staged.where("false"), ["k"])) == []


def test_upsert(spark):
    target = spark.createDataFrame([(1, 5, "old"), (2, None, "old")], "id int, n int, s string")
    staged = spark.createDataFrame([(1, 3, "new"), (2, 4, "new"), (3, 1, "new")], "id int, n int, s string")
    assert vals(upsert_greatest(target, staged, "id", ["n"])) == [(1, 5, "old"), (2, 4, "old"), (3, 1, "new")]


def test_upsert_of_repeated_keys(spark):
    target = spark.createDataFrame([(1, 5, "old")], "id int, n int, s string")
    staged = spark.createDataFrame([(1, 3, "a"), (1, 9, "b"), (2, None, "a"), (2, 4, "c"), (None, 7, "x")], "id int, n int, s string")
    assert vals(upsert_greatest(target, staged, "id", ["n"])) == [(1, 9, "old"), (2, 4, "a")]


def test_values(spark):
    df = append_rows(spark.createDataFrame([(1, "a", 1.5)], "i int, s string, d double"), [{"i": 2, "s": 'tab\tand "quote"'}, {"s": None, "i": 3}])
    assert vals(df) == [(1, "a", 1.5), (2, 'tab\tand "quote"', None), (3, None, None)]


def test_null_orders(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, v int")
    assert vals(R.distinct_on(df, ["k"], [R.desc("v")])) == [("a", None), ("b", 3)]
    assert [r.v for r in df.orderBy(R.asc("v")).collect()] == [1, 2, 3, None]
    names = spark.createDataFrame([("Dunaj",), ("Čadca",), ("Cena",)], "n string")
    assert [r.n for r in names.orderBy(R.collated("n")).collect()] == ["Cena", "Čadca", "Dunaj"]


def test_dangling(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, 9)], "id int, ref int")
    assert R.dangling(df, {"lost": ("ref", df, "id")}).first().lost == 1
    assert R.dangling(df.where("false"), {"lost": ("ref", df, "id")}).first().lost is None


def test_search(spark):
    df = spark.createDataFrame([(1, "Bill Gates"), (2, "gate"), (3, None), (4, "x GATES y")], "id int, t string")
    grams = trigram_table(df, "id", "t")
    for text in ("gates", "ga"):
        assert vals(trigram_search(df, "id", "t", grams, text)) == vals(search(df, "t", text, ignore_case=True))
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["İ", "i̇", "xİ", "KELVİN K", "ß.", "AB", "", "a b", None])], "i int, t string")
    for text in ("i̇", "k", ".", "ab", "B", "", "İ"):
        low = [(r.i, r.t.lower()) for r in odd.collect() if r.t is not None]
        assert sorted(r.i for r in search(odd, "t", text, "suffix", ignore_case=True).collect()) == [i for i, t in low if t.endswith(text.lower())]
        assert sorted(r.i for r in search(odd, "t", text, "prefix", ignore_case=True).collect()) == [i for i, t in low if t.startswith(text.lower())]
    assert vals(search(df, "t", "Bill", "prefix").select("id")) == [(1,)]
    assert vals(search(df, "t", "GATE", "suffix", ignore_case=True).select("id")) == [(2,)]


def test_stored_postings(spark, tmp_path, monkeypatch):
    """Two batches, one of them twice, in rows of few ids: the same as by a scan, from row groups of the search's own grams."""
    rnd = random.Random(2)
    texts = [(i, None if i % 40 == 7 else "".join(rnd.choice("abcAB é") for _ in range(rnd.randint(0, 30)))) for i in range(300)] + [(5, "abcabc"), (None, "abcabc")]
    df = spark.createDataFrame(texts, "i bigint, t string")
    monkeypatch.setattr(S, "CHUNK", 16)
    index = S.TrigramIndex(spark, str(tmp_path / "grams"))
    assert index.search(df, "i", "t", "abc").count() == 0
    for batch, rows in (("a", df.where("i < 150 OR i IS NULL")), ("b", df.where("i >= 150")), ("a", df)):
        index.add(batch, rows, "i", "t")
    assert len(index.batches()) == 2 and index.postings().agg(F.max("n")).first()[0] < 60
    for text in ("abc", "ABCA", "bca b", "zzz", "é", "", " é ", "caBabc"):
        for kind in ("contains", "prefix", "suffix"):
            for ignore in (True, False):
                want = search(df.where("i IS NOT NULL OR length(lower(%r)) < 3" % text), "t", text, kind, ignore)
                assert vals(index.search(df, "i", "t", text, kind, ignore)) == vals(want), (text, kind)
    assert any("In(gram" in f for f in pushed_filters(index.candidates("abca")))


def test_postings_by_size(spark, tmp_path, monkeypatch):
    """Long texts of few ids make many parts, none of which holds much; letters beyond those that fit a number, and many rows of one id, count as any."""
    monkeypatch.setattr(S, "TEXT", 4000)
    rnd = random.Random(4)
    texts = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(400))) for i in range(200)] + [(500, "abc" * 300)] * 40 + [(i, "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(300))) for i in range(600, 640)]
    df = spark.createDataFrame(texts, "i bigint, t string").repartition(3)
    index = S.TrigramIndex(spark, str(tmp_path / "grams"))
    index.add("a", df, "i", "t")
    sizes = [r.n for r in index.postings().groupBy(F.input_file_name()).agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < sum(sizes) / 8
    want = {(t.lower()[k : k + 3], i) for i, t in texts for k in range(len(t) - 2)}
    got = index.postings().select("gram", F.explode("ids")).collect()
    assert len(got) == len(want) == sum(sizes) and {tuple(r) for r in got} == want
    one, rows = list(range(3000)), ["".join(chr(rnd.randrange(33, 0x2FA1D)) for _ in range(40)).encode("utf-8", "ignore").decode() for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": one, "t": rows})  # 3000 texts of some 100,000 different letters: 51 bits for a gram and 12 for a text
    posted = [(g, i) for b in S._post(iter([batch, batch])) for g, ids in zip(b.column("gram").to_pylist(), b.column("ids").to_pylist(), strict=True) for i in ids]
    assert posted == sorted({(t[k : k + 3], i) for i, t in zip(one, rows, strict=True) for k in range(len(t) - 2)})


def geo(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", G.from_wkt(F.col("t"), 5514).alias("g"))


def test_measures(spark):
    df = geo(spark, "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))", "MULTIPOLYGON(((0 0,1 0,1 1,0 1,0 0)),((2 0,3 0,3 1,2 1,2 0)))", "POLYGON((0 0,2 0,2 1,1 1,1 2,0 2,0 0))", "LINESTRING(0 0,3 4)", "POINT(1.5 -2)", "nonsense", "MULTILINESTRING((0 0,1 0),(5 5,5 6))")
    got = {r.i: r for r in df.select("i", G.area(F.col("g")).alias("a"), G.length(F.col("g")).alias("l"), G.x(G.centroid(F.col("g"))).alias("cx"), G.as_wkt(F.col("g")).alias("w"), "t").collect()}
    assert [got[i].a for i in range(5)] == [15, 2, 3, 0, 0]
    assert abs(got[0].cx - (16 * 2 - 1.5) / 15) < 1e-12 and got[1].cx == 1.5 and abs(got[2].cx - 5 / 6) < 1e-12 and got[3].cx == 1.5
    assert got[3].l == 5 and got[6].l == 2 and got[5].w is None
    assert all(got[i].w == got[i].t for i in (0, 1, 2, 3, 4, 6))


def test_contains(spark):
    a = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))"
    cases = {"POINT(3 3)": True, "POINT(0 2)": False, "POINT(4 4)": False, "POINT(5 1)": False, "POINT(1.5 1.5)": False, "POLYGON((2.5 2.5,3 2.5,3 3,2.5 2.5))": True, "POLYGON((3 3,5 3,5 5,3 3))": False, a: True, "POLYGON((0.5 0.5,3 0.5,3 3,0.5 3,0.5 0.5))": False}
    df = geo(spark, *cases).withColumn("a", G.from_wkt(F.lit(a), 5514))
    assert {r.t: r.c for r in df.select("t", G.contains(F.col("a"), F.col("g")).alias("c")).collect()} == cases


def test_border_distance(spark):
    assert geo(spark, "POLYGON((0 0,10 0,10 10,0 10,0 0))").select(G.border_distance(F.col("g"), F.lit(5), F.lit(5)).alias("d")).first().d == 5


def test_near_border_is_exact(spark):
    """Edges that leave the zone between any points that one might look at, and lines; against the distances of many points."""
    rnd = random.Random(3)
    box = "POLYGON((0 0,10 0,10 10,0 10,0 0))"
    lines = ["LINESTRING(-1 5,11 5)", "LINESTRING(1 1,9 1)", "LINESTRING(0.9 1,0.9 9)", "LINESTRING(-1 -1,11 -1)", "LINESTRING(5 11,5 11)", "LINESTRING(0 0,10 10)", "LINESTRING(-0.5 -0.5,-0.5 10.5,10.5 10.5)", "LINESTRING(0 1.001,10 1.001)", "POLYGON((0 0,10 0,10 10,0 10,0 0))"]
    lines += [f"LINESTRING({rnd.uniform(-2, 12)} {rnd.uniform(-2, 2)},{rnd.uniform(-2, 12)} {rnd.uniform(-2, 2)})" for _ in range(60)]
    df = geo(spark, *lines).withColumn("b", G.from_wkt(F.lit(box), 5514))
    points = lambda e: F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: G.border_distance(F.col("b"), e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * i / 2000, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * i / 2000))
    got = df.select("t", G.near_border(F.col("g"), F.col("b"), 1.0).alias("n"), F.array_max(F.transform(G.outline(F.col("g")), lambda e: F.array_max(points(e)))).alias("far")).collect()
    for r in got:
        if abs(r.far - 1) > 1e-6:
            assert r.n == (r.far < 1), r.t
    assert {r.n for r in got} == {True, False}
    # a border of two short pieces: the middle of the edge is far from both
    gap = spark.range(1).select(G.near_border(G.from_wkt(F.lit("LINESTRING(0 0,100 0)"), 5514), G.from_wkt(F.lit("MULTILINESTRING((0 0,49 0),(51.9 0,100 0))"), 5514), 1.4).alias("n")).first().n
    assert gap is False


def test_grid_joins(spark):
    """Polygons from tiny to huge, and points and boxes inside them, against all pairs."""
    rnd = random.Random(5)
    box = lambda x, y, w, h: f"POLYGON(({x} {y},{x + w} {y},{x + w} {y + h},{x} {y + h},{x} {y}))"
    boxes = [(rnd.randint(-50, 50), rnd.randint(-50, 50), 2 ** rnd.randint(0, 9), 2 ** rnd.randint(0, 9)) for _ in range(60)]
    df = spark.createDataFrame([(i, box(*b)) for i, b in enumerate(boxes)] + [(-1, None)], "i int, t string").select("i", G.from_wkt(F.col("t"), 5514).alias("way"))
    points = [(i, rnd.uniform(-60, 400), rnd.uniform(-60, 400)) for i in range(200)]
    got = J.contains_join(df, spark.createDataFrame(points, "p int, px double, py double"), 4.0)
    assert vals(got.select("i", "p")) == sorted(((i, p) for i, (x, y, w, h) in enumerate(boxes) for p, px, py in points if x < px < x + w and y < py < y + h), key=repr)
    inner = df.select(F.col("i").alias("j"), F.col("way").alias("inner"))
    pairs = sorted(((i, j) for i, (x, y, w, h) in enumerate(boxes) for j, (u, v, s, t) in enumerate(boxes) if x <= u and y <= v and x + w >= u + s and y + h >= v + t), key=repr)
    assert vals(J.contains_polygons(df, inner, 4.0).select("i", "j")) == pairs


def test_systems(spark):
    p = G.point(F.lit(17.1211), F.lit(48.1601), 4326)
    r = spark.range(1).select(G.x(G.transform(p, 5514)).alias("e"), G.y(G.transform(p, 5514)).alias("n"), G.transform(G.set_srid(p, 9), 5514).alias("none"), G.set_srid(p, 9)["srid"].alias("s")).first()
    plain = spark.range(1).select(*[c.alias(n) for n, c in zip("en", G.krovak(F.lit(17.1211), F.lit(48.1601)), strict=True)]).first()
    assert 50 < ((r.e - plain.e) ** 2 + (r.n - plain.n) ** 2) ** 0.5 < 200 and r.none is None and r.s == 9  # the shift between the systems
    df = spark.range(2).select(G.point(F.col("id"), F.col("id"), 4326).alias("g"))
    assert vals(G.srid_of(df, "g")) == [(4326,)]


def test_band_join(spark):
    rnd = random.Random(2)
    a, b = [(i, round(rnd.uniform(-20, 20), 1)) for i in range(80)] + [(99, None)], [(i, round(rnd.uniform(-20, 20), 1)) for i in range(80)] + [(99, None)]
    got = R.band_join(spark.createDataFrame(a, "i int, v double"), spark.createDataFrame(b, "j int, w double"), "v", "w", -0.5, 1.0).select("i", "j")
    assert vals(got) == sorted(((i, j) for i, v in a for j, w in b if v is not None and w is not None and v - 0.5 < w < v + 1.0), key=repr)
    texts = spark.createDataFrame([(1, "one two three four"), (2, "stone two threes"), (3, None), (4, "two"), (5, "one  two")], "i int, t string")
    parts = spark.createDataFrame([(1, "one two three"), (2, "two three"), (3, "ne"), (4, None), (5, "e  t"), (6, "e two th")], "j int, p string")
    expected = [(t[0], p[0]) for t in texts.collect() for p in parts.collect() if t[1] and p[1] and p[1] in t[1]]
    assert vals(R.contains_join(texts, parts, "t", "p").select("i", "j")) == sorted(expected, key=repr) and len(expected) > 8


def test_shapefile(spark, tmp_path):
    import struct
    import zipfile

    def polygon(*rings):
        points = [p for r in rings for p in r]
        starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
        body = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        return struct.pack(">2i", 1, len(body) // 2) + body

    shp = bytes(100) + polygon([(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)])
    dbf = bytes(4) + struct.pack("<IHH", 1, 65, 6) + bytes(20) + b"name".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15) + b"\r" + b" hello"
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("areas.shp", shp)
        z.writestr("areas.dbf", dbf)
    from quillon.sources.layers import read_shapefiles

    r = read_shapefiles(spark, str(tmp_path)).select("layer", "attributes", G.area(F.col("geometry")).alias("a"), F.col("geometry.srid").alias("s")).first()
    assert (r.layer, r.attributes, r.a, r.s) == ("areas", {"name": "hello"}, 15.0, 4326)
