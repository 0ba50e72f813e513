"""Whitening, compaction and URL filters."""

import glob
import hashlib
import math
import os
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.llm.common import shared_folder
from quillon.llm.compaction import compact_clicks, ordinals, pack_runs, packed
from quillon.llm.queries import QUERIES
from quillon.llm.url_filter import RULES, host_rules, judged, learnt, matched, mine
from quillon.llm.whitening import pairs, whiten, whole_vectors

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


# whitening


def plain_whitening(vectors, components):
    x = np.floor(np.array(vectors, float) * 64).astype(int) + 1000000
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    values, units = np.linalg.eigh(apart.T @ apart / n**3)
    values, units = values[::-1], units[:, ::-1]
    return (apart**2).sum(axis=1), apart / n @ units[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum()


def agrees(spark, table, components):
    """The rows of whiten() against numpy, for (id, vector) rows with different ids."""
    fine = [(i, v) for i, v in table if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    deviation, white, explained = plain_whitening([v for _, v in fine], components)
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>").withColumns({"x": F.lit(1), "w": F.lit("?"), "id": F.lit(0)})
    got = defaultdict(dict)
    for r in whiten(*whole_vectors(df), components).collect():
        assert r.component not in got[r.vec_id] and r.n == len(fine) and r.identity_error < 1e-9
        got[r.vec_id][r.component] = r
    assert set(got) == {i for i, _ in fine} and all(sorted(x) == list(range(1, components + 1)) for x in got.values())
    mine = np.array([[got[i][c + 1].whitened for c in range(components)] for i, _ in fine])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-8
    assert [got[i][1].deviation for i, _ in fine] == deviation.tolist()
    assert np.allclose([got[fine[0][0]][c + 1].explained for c in range(components)], explained, rtol=1e-10)


def test_whitened_as_by_numpy(spark):
    r = np.random.default_rng(3)
    table = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 9)) @ r.normal(size=(9, 9)) + 5)]
    table += [(1000 + i, table[7][1]) for i in range(150)]  # many copies of one vector
    table += [(2000, None), (2001, [float("nan")] + [0.0] * 8), (2002, [None] + [0.0] * 8), (2003, [float("inf")] + [0.0] * 8), (-4, [0.0] * 9)]
    agrees(spark, table, 6)
    agrees(spark, table, 9)


@there
def test_whitening_of_the_embeddings(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    agrees(spark, table, 32)
    got = QUERIES["op11_whitening"](spark, SF)
    assert got.count() == 32 * len(table) and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_cases(spark):
    kind = "vec_id bigint, embedding array<float>"
    white = lambda rows: whiten(*whole_vectors(spark.createDataFrame(rows, kind)), 4).collect()
    assert white([]) == [] and white([(1, None)]) == []
    alone = white([(1, [0.5, 2.0])])
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    equal = white([(1, [0.5, 2.0]), (1, [0.5, 2.0]), (None, [1.5, 2.0])])  # equal and null ids; one dimension does not vary
    assert sorted((str(r.vec_id), r.component, r.whitened is None) for r in equal) == sorted([("1", 1, False), ("1", 2, True)] * 2 + [("None", 1, False), ("None", 2, True)])
    assert {round(r.explained, 12) for r in equal} == {1.0, 0.0}
    short = white([(1, [1.0]), (2, [1.0, 2.0]), (3, [4.0, 0.0])])  # a vector without its last component has zero there
    assert len(short) == 6 and all(r.n == 3 for r in short)
    large = white([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 2.0])])
    assert {r.deviation for r in large if r.vec_id in (1, 2)} == {None} and {r.deviation for r in large if r.vec_id == 3} == {36864}


def test_pairs_in_stretches():
    assert [len(p) for p in pairs(64)] == [2080]
    assert sorted(p for part in pairs(7, 5) for p in part) == [(i, j) for i in range(7) for j in range(i, 7)] and max(map(len, pairs(7, 5))) == 5


def test_wide_vectors_take_several_passes(spark):
    r = np.random.default_rng(4)
    rows, d = whole_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(40, 6)))], "vec_id bigint, embedding array<float>"))
    one, many = (sorted(whiten(rows, d, 3, most).select("vec_id", "component", F.abs("whitened")).collect()) for most in (8192, 4))
    assert [x[:2] for x in one] == [x[:2] for x in many] and np.allclose([x[2] for x in one], [x[2] for x in many])


# compaction


def first_fit(sizes, capacity):
    """Groups as lists of places, by the definition."""
    groups = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for g in groups:
            if sum(sizes[j] for j in g) + sizes[i] <= capacity:
                g.append(i)
                break
        else:
            groups.append([i])
    return groups


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_first_fit(seed):
    rnd = random.Random(seed)
    capacity = rnd.randint(1, 60)
    sizes = [rnd.randint(1, rnd.choice([3, capacity, capacity + 5])) for _ in range(rnd.randint(0, 120))]
    counts = {s: sizes.count(s) for s in sizes}
    group = {}
    for size, start, stop, first, each in pack_runs(list(counts), list(counts.values()), capacity):
        for o in range(start, stop):
            assert (size, o) not in group
            group[size, o] = first + (o - start) // each
    seen, mine = defaultdict(int), defaultdict(list)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        mine[group[sizes[i], seen[sizes[i]]]].append(i)
        seen[sizes[i]] += 1
    assert [mine[g] for g in sorted(mine)] == first_fit(sizes, capacity)
    assert sorted(mine) == list(range(len(mine)))


def test_many_equal_files_are_few_runs():
    assert pack_runs([7, 3], [10**9, 5], 20) == [(7, 0, 10**9, 0, 2), (3, 0, 5, 0, 2)] or pack_runs([7, 3], [10**9, 5], 20)[0] == (7, 0, 10**9, 0, 2)


def test_ordinals_and_packing_of_one_hot_family(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else rnd.choice(["a", None]), rnd.choice([5, 5, 5, 2, 9]), rnd.randint(0, 10**6), i) for i in range(900)]
    df = spark.createDataFrame(rows, "day string, n bigint, lot bigint, name bigint").repartition(7)
    for r in ordinals(df, ["day", "n"], ["lot", "name"]).collect():
        assert r.ordinal == sum((x[0], x[1]) == (r.day, r.n) and x[2:] < (r.lot, r.name) for x in rows)
    got = packed(df, "day", "n", ["lot", "name"], 21).collect()
    assert len(got) == len(rows)
    for day in ("hot", "a", None):
        own = sorted((x for x in rows if x[0] == day), key=lambda x: x[2:])
        found = defaultdict(list)
        for r in sorted((r for r in got if r.day == day), key=lambda r: (r.group, r.position)):
            assert r.position == len(found[r.group])
            found[r.group].append(r.name)
        assert [found[g] for g in sorted(found)] == [[own[i][3] for i in g] for g in first_fit([x[1] for x in own], 21)]


def clicks(n, seed=2):
    """Rows with a hot day, null and repeated ids, null values and arrivals, equal times."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        day = rnd.choice([3, 3, 3, rnd.randint(-2, 12)])
        at = datetime(1970, 1, 1) + timedelta(days=day, seconds=rnd.randint(0, 86399), microseconds=rnd.choice([0, 7]))
        out.append((i if rnd.random() < 0.98 else None, None if rnd.random() < 0.02 else at, rnd.choice([None, 1.005, -2.5, 7.0, 0.125]), "xyz"[i % 3], i % 4, f"p{i % 5}"))
    return out + out[:40]


def plain_compaction(rows, lots=150, small=600, full=400):
    share, when = lambda x: 1 + len(rows) // x, lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or 0)
    day = lambda r: None if r[1] is None else (r[1] - datetime(1970, 1, 1)).days
    many, files, out = defaultdict(int), defaultdict(list), []
    for r in rows:
        many[day(r)] += 1
    for r in rows:
        h = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
        files[day(r), h // 16 % (1 + many[day(r)] // share(lots)), min(h % 4, h // 4 % 4)].append(r)
    for d in many:
        keys = sorted(k for k in files if k[0] == d)
        little = [k for k in keys if len(files[k]) < share(small)]
        groups = [[little[i] for i in g] for g in first_fit([len(files[k]) for k in little], share(full))]
        for g in groups + [[k] for k in keys if k not in little]:
            own = [r for k in g for r in sorted(files[k], key=when)]
            ids = [r[0] for r in own if r[0] is not None]
            text = ",".join("" if r[0] is None else str(r[0]) for r in own)
            cents = sum(math.floor(100 * r[2] + 0.5) for r in own if r[2] is not None and math.isfinite(r[2]))
            out.append((*g[0], len(own), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{k[1]}-{k[2]}" for k in g), hashlib.sha256(text.encode()).hexdigest(), len(g) > 1, text.split(",")))
    return out


def compacted(spark, rows, **how):
    df = spark.createDataFrame(rows, "click_id bigint, arrived_at timestamp_ntz, value double, day string, _path int, `a b` string")
    folder = shared_folder(spark, "clicks-test")
    got = compact_clicks(df.repartition(3), folder, **how).collect()
    local = folder.removeprefix("file://")
    assert {os.path.basename(r.path) for r in got} == {os.path.basename(f) for f in glob.glob(f"{local}/**/*.parquet", recursive=True)}
    for r in got:
        table = pq.ParquetFile(f"{local}/{os.path.basename(r.path)}").read()
        assert ",".join(table.column_names) == r.columns == "click_id,arrived_at,value,day,_path,a b"
        assert ["" if x is None else str(x) for x in table.column("click_id").to_pylist()] == next(w[-1] for w in plain_compaction(rows, **how) if w[8] == r.ids_sha256)
    return got, [(r.day, r.lot, r.piece, r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in got]


def test_compaction_as_by_the_definition(spark):
    rows, how = clicks(400), {"lots": 8, "small": 30, "full": 10}
    _, mine = compacted(spark, rows, **how)
    assert sorted(mine, key=repr) == sorted((w[:-1] for w in plain_compaction(rows, **how)), key=repr)
    assert any(x[-1] for x in mine) and not all(x[-1] for x in mine)


@there
def test_compaction_of_the_clicks(spark):
    rows = [(r["click_id"], r["arrived_at"], r["value"]) for r in pq.read_table(f"{SF}/clicks.parquet").to_pylist()]
    got = [(r.day, r.lot, r.piece, r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in QUERIES["op12_compaction"](spark, SF).collect()]
    assert sorted(got) == sorted(w[:-1] for w in plain_compaction(rows)) and any(r[-1] for r in got)


def test_other_files_stay_as_they_are(spark):
    got, _ = compacted(spark, clicks(200), lots=4, small=30, full=8)
    untouched = {r.path.rpartition("/")[2].split("-")[2] for r in got if not r.rewritten}
    assert len(untouched) == 1 and {r.path.rpartition("/")[2].split("-")[2] for r in got if r.rewritten}.isdisjoint(untouched)  # the name of the first job's files


def test_compaction_of_nothing(spark):
    df = spark.createDataFrame([], "click_id bigint, arrived_at timestamp_ntz, value double")
    out = compact_clicks(df, shared_folder(spark, "clicks-test"))
    assert out.count() == 0 and out.columns == ["day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", "path", "rewritten"]
    one, mine = compacted(spark, [(7, None, float("nan"), None, None, None)])
    assert mine[0][:8] == (None, 0, mine[0][2], 1, 7, 7, 0, f"0-{mine[0][2]}") and not one[0].rewritten


# URL filters


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:].split("?")[0].split("#")[0]


def plain_rule(host, path):
    best = None
    for verdict, rule in (line.split() for line in RULES.strip().split("\n")):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


URLS = [
    None, "", "no scheme", "://", "http://", "http:///x", "http://ORG/", "http://a.ORG", "http://a.org/x", "http://aorg/x", "HTTP://Example.ORG/es/1", "http://www.example.org/es", "http://www.example.org/es/?q=/en/1",
    "http://example.org/en/12", "http://xexample.org/en/12", "http://a.com/fr/", "http://a.com/de/#x", "http://a.com?/de/", "http://a.com#/de/", "http://b.net/http://casino.org/", "http://casino-win.net/", "http://free-BETS.com/en/1",
    "http://cheap.pills.example.net/de/2", "https://ÄÖ.net/Ü?casino", "http://u:p@host.com:80/de/1", "http://x.com/de\n/y?z", "a://b://c.org/d", "http://farm-link.example.net/1", "http://farm.example.net/1", "http://link.example.net/1",
]


@pytest.fixture(scope="module")
def rules(spark):
    return learnt(spark).cache()


def test_urls_by_definition(spark, rules):
    pages = spark.createDataFrame([(i % 7 if i % 5 else None, u, "h", "r", 3) for i, u in enumerate(URLS * 2)], "page_id bigint, url string, host string, found string, by int")
    table = [(r.tokens, r.confidence) for r in rules.collect()]
    got = judged(pages, host_rules(RULES), rules).collect()
    assert len(got) == 2 * len(URLS)
    want = []
    for i, u in enumerate(URLS * 2):
        host, path = plain_parts(u)
        rule = plain_rule(host, path)
        words = {"h:" + w for w in "".join(c if c.isalnum() else " " for c in (host.lower())).split() if any(x.isalpha() for x in w)}
        rest = "" if u is None or "://" not in u else u[u.index("://") + 3 :][len(host) :]
        words |= {"p:" + w for w in "".join(c if c.isalnum() else " " for c in rest.lower()).split() if any(x.isalpha() for x in w)}
        hit = any(set(t) <= words for t, _ in table)
        want.append((i % 7 if i % 5 else None, host, path, rule and rule[0], rule[1] if rule else "block" if hit else "allow"))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=repr) == sorted(want, key=repr)
    verdicts = {w[1]: w[4] for w in want}
    assert verdicts["farm-link.example.net"] == "block" and verdicts["farm.example.net"] == verdicts["link.example.net"] == "allow"


def test_rules_join_as_they_look_up(spark, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 3)], "page_id bigint, url string")
    assert sorted(matched(pages, rules).collect(), key=repr) == sorted(matched(pages, rules, most=3).collect(), key=repr)
    assert matched(pages.limit(0), rules).count() == 0
    none = rules.limit(0)
    assert {r.found for r in matched(pages, none).collect()} == {None} == {r.found for r in matched(pages, none, most=-1).collect()}


def test_mined_rules_have_support_and_confidence(spark):
    rows = [(f"http://bad-{w}.com/", "block") for w in "abcdefgh"] + [("http://bad-z.com/", "allow"), ("http://bad-dog.com/x", "block"), (None, "allow"), ("http://q.com", None)] + [("http://fine.com/dog", "allow")] * 9
    got = {tuple(r.tokens): r for r in mine(spark.createDataFrame(rows, "url string, label string"), support=0.05, confidence=0.8).collect()}
    assert got["h:bad",].confidence == pytest.approx(0.9) and got["h:bad",].support == pytest.approx(9 / 20)
    assert ("h:bad", "h:com") not in got  # no surer than its part
    assert got["h:a",].confidence == 1.0 and ("h:com",) not in got and not any("p:dog" in t for t in got)
    assert mine(spark.createDataFrame([], "url string, label string")).count() == 0


@there
def test_verdicts_of_the_pages(spark):
    got = QUERIES["op13_url_filter"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 250
    for r in got:
        rule = plain_rule(r.host, r.path)
        assert r.rule == (rule and rule[0]) and (rule is None or r.verdict == rule[1])
        if rule is None:
            assert (r.verdict == "block") == any(w in r.host for w in ("casino", "bets", "adult", "spam", "pills", "ads"))
