"""Records with known rows, as FIXTURES.md lists them."""

import gzip
import json
import zlib
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators.flatten import coercion_losses, flatten, lead_bounds
from quillon.plans import archive_queries, etl, layout
from quillon.plans.store import Store, kept, shared
from quillon.schemas import REQUIRED, TABLES
from quillon.sources.archive import accepted, lines, parsed, rejects
from quillon.streaming.incremental import follow

FULL = {
    "id": 1, "created_at": "Sat Aug 01 01:59:54 +0200 2020", "full_text": "hello\u0000 world", "lang": "en", "source": '<a href="x">App</a>', "in_reply_to_status_id": 99, "quoted_status_id": "2",
    "retweeted_status": {"id": 3}, "retweet_count": 4, "favorite_count": "5", "possibly_sensitive": False, "display_text_range": [0, 140],
    "user": {"id": 10, "screen_name": "ab", "followers_count": 3000000000, "friends_count": 7, "verified": True, "created_at": "2020-08-01T01:59:54Z", "url": "", "entities": {"url": {"urls": [{"expanded_url": "http://u"}]}}},
    "place": {"id": "p1", "full_name": "Here"},
    "entities": {"hashtags": [{"text": "COVID19"}, {"text": "covid19"}, None, {"text": ""}], "urls": [{"url": "s", "expanded_url": "e", "unwound_url": ""}, {"url": "s2", "expanded_url": "e"}],
                 "user_mentions": [{"id": 8, "screen_name": "x"}, {"id": 8, "screen_name": "y"}, {"screen_name": "Ab"}, {"screen_name": "aB"}], "media": [{"id": 5, "type": "photo"}]},
    "extended_entities": {"media": [{"id": 6, "type": "video"}, {"id": 6, "type": "video"}]},
}
CASES = [
    FULL,
    {"id": "abc"},
    {"full_text": "no id"},
    {"id": " 2 ", "truncated": True, "text": "cut", "extended_tweet": {"full_text": "whole", "display_text_range": [1, 2], "entities": {"hashtags": [{"text": "Covid19"}]}}, "entities": {"hashtags": [{"text": "no"}]}},
    {"id": 3, "truncated": True, "text": "cut", "extended_tweet": {"full_text": "only text"}},
    {"id": 4, "full_text": "", "text": "x", "display_text_range": [3], "source": "plain", "place": {}, "extended_entities": {"media": []}, "entities": {"media": [{"id": 7}]}},
    {"id": 5, "source": "", "created_at": "nonsense", "user": {"name": "nobody"}, "place": {"id": ""}, "retweet_count": "1.9", "truncated": True, "extended_tweet": {"entities": {}}, "text": "kept"},
]


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    folder = tmp_path_factory.mktemp("archive")
    with gzip.open(folder / "a.jsonl.gz", "wb") as f:
        for c in CASES:
            f.write(json.dumps(c).encode() + b"\n")
        f.write(b"\n   \n" + b'{"id":1' + b"\n[1,2]\n")
        f.write(b'{"id":6,"text":"bad \xff byte"}\n')
        f.write(b'{"id":7,"truncated":"yes","text":"one mistyped field"}\n')
    with gzip.open(folder / "b.jsonl.gz", "wb") as f:
        f.write(json.dumps(FULL).encode() + b"\n" + json.dumps({"id": 8, "quoted_status_id": 1, "in_reply_to_status_id": 2, "retweeted_status": {"id": 77}}).encode() + b"\n")
    (folder / "c.txt").write_text("not read")
    return folder


@pytest.fixture(scope="module")
def records(spark, archive):
    return parsed(lines(spark, str(archive), "a.jsonl.gz")).cache()


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def test_lines_and_rejects(records):
    assert records.count() == len(CASES) + 4
    assert sorted(r.value[:6] for r in rejects(records).collect()) == ["[1,2]", '{"id":'] or {r.value for r in rejects(records).collect()} == {"[1,2]", '{"id":1'}
    assert accepted(records).count() == 7


def test_tweets(records):
    t = {r.id: r for r in flatten(records)["tweets"].collect()}
    assert sorted(t) == [1, 2, 3, 4, 5, 6, 7]
    one = t[1]
    assert (one.created_at, one.full_text, one.display_from, one.display_to) == (datetime(2020, 8, 1, 1, 59, 54), "hello world", 0, 140)
    assert (one.source, one.in_reply_to_status_id, one.quoted_status_id, one.retweeted_status_id, one.retweet_count, one.favorite_count, one.user_id, one.place_id) == ("App", 99, 2, 3, 4, 5, 10, "p1")
    assert (t[2].full_text, t[2].display_from, t[3].full_text, t[4].full_text, t[4].display_from, t[4].source) == ("whole", 1, "only text", "x", None, "plain")
    assert (t[5].source, t[5].created_at, t[5].retweet_count, t[5].user_id, t[5].place_id, t[5].full_text) == (None, None, None, None, None, "kept")
    assert t[7].full_text == "one mistyped field"


def test_children(records):
    t = flatten(records)
    assert rows(t["users"].select("id", "screen_name", "followers_count", "friends_count", "url", "created_at")) == [(10, "ab", None, 7, "http://u", datetime(2020, 8, 1, 1, 59, 54))]
    assert rows(t["places"].select("id")) == [("p1",)]
    tag = zlib.crc32(b"covid19")
    assert tag == 950695209
    assert rows(t["hashtags"]) == [(tag, "COVID19"), (tag, "Covid19"), (tag, "covid19")]
    assert rows(t["tweet_hashtag"]) == [(1, tag), (1, tag), (2, tag)]
    assert rows(t["tweet_urls"].select("url", "unwound_url")) == [("s", "e"), ("s2", "e")]
    assert rows(t["tweet_media"].select("tweet_id", "media_id")) == [(1, 6), (1, 6), (4, 7)]
    assert t["tweet_user_mentions"].count() == 4
    for name, ddl in TABLES.items():
        assert t[name].columns == [c.split()[0] for c in ddl.split(", ")]


def test_losses(records):
    lost = coercion_losses(records).first()
    assert (lost.id, lost.followers_count, lost.retweet_count, lost.favorite_count) == (1, 1, 1, 0)


def test_load_twice_and_overlap(spark, archive, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = etl.ingest(spark, str(archive), store, "a", "a.jsonl.gz")
    assert (first["lines"], first["rejected"]) == (11, 2)
    assert first["added"] == {"users": 1, "places": 1, "hashtags": 1, "tweets": 7, "tweet_hashtag": 2, "tweet_urls": 1, "tweet_user_mentions": 2, "tweet_media": 2}
    assert sum(etl.ingest(spark, str(archive), store, "a", "a.jsonl.gz")["added"].values()) == 0  # the batch is known
    assert sum(etl.ingest(spark, str(archive), store, "again", "a.jsonl.gz")["added"].values()) == 0  # the rows are
    assert etl.ingest(spark, str(archive), store, "b", "b.jsonl.gz")["added"]["tweets"] == 1
    assert {r.table_name: r.row_count for r in etl.table_counts(store).collect()}["tweets"] == 8
    assert etl.dangling_references(store.table("tweets")).first() == Row(replies_without_parent=1, quotes_without_parent=0, retweets_without_parent=1)
    assert rows(store.find_text("tweets", "full_text", "ELLO W").select("id")) == [(1,)] and len(store.text_index("tweets", "full_text").batches()) == 3
    assert {(r.child, r.reference): r.dangling for r in etl.foreign_key_audit(store).collect()}[("tweet_urls", "tweet_id")] == 0
    path = store.compact("tweets", ["user_id", "created_at"], 2, bloom=["quoted_status_id"])
    found = layout.footers(spark, path)
    assert found.where("column = 'id'").agg(F.sum("row_count")).first()[0] == 8
    clustered = spark.read.parquet(path)
    assert clustered.count() == 8
    assert any("EqualTo(user_id,10)" in f for f in layout.pushed_filters(clustered.where("user_id = 10").select("id")))
    assert layout.advice(spark, "users").count() == 3
    assert sorted((r.layout, r.columns, r.files) for r in layout.describe_layout(store, "tweets").collect()) == [("bloom filter", "quoted_status_id", 2), ("clustered", "user_id, created_at", 2), ("snapshot", "", None), ("snapshot", "", None), ("snapshot", "", None)]
    assert [r.layout for r in layout.describe_layout(store, "places").collect()] == ["snapshot"] * 3
    assert found.where("column = 'id'").agg(F.min(F.col("low").cast("long")), F.max(F.col("high").cast("long"))).first()[:] == (1, 8)
    assert layout.footers(spark, path, 1).select("file").distinct().count() == 1
    clustered.createOrReplaceTempView("clustered_tweets")
    spark.sql("CREATE TABLE tweets_of_test USING parquet AS SELECT id, user_id FROM clustered_tweets")
    layout.analyze(spark, "tweets_of_test")
    assert "8 rows" in str([r.data_type for r in spark.sql("DESCRIBE EXTENDED tweets_of_test").collect() if r.col_name == "Statistics"])
    spark.sql("DROP TABLE tweets_of_test")
    assert etl.system_info(spark)["spark"] == spark.version


def test_a_folder_that_grows(spark, tmp_path):
    """Each load reads the files that it has not seen, under the default name: new ones, and those that changed."""
    folder, store = tmp_path / "grows", Store(spark, str(tmp_path / "store"))
    folder.mkdir()

    def put(name, ids):
        with gzip.open(folder / name, "wt") as f:
            f.write("".join(json.dumps({"id": i, "text": f"t{i}"}) + "\n" for i in ids))

    def load():
        told = etl.ingest(spark, str(folder), store)
        return told["files"], told["lines"], told["added"]["tweets"], sorted(r.id for r in store.table("tweets").collect())

    assert load() == (0, 0, 0, [])
    put("a.jsonl.gz", [1, 2])
    assert load() == (1, 2, 2, [1, 2])
    put("b.jsonl.gz", [2, 3])
    assert load() == (1, 2, 1, [1, 2, 3])
    assert load() == (0, 0, 0, [1, 2, 3])
    put("a.jsonl.gz", [1, 2, 4, 5])  # written anew
    put("c.jsonl.gz", [])
    assert load() == (2, 4, 2, [1, 2, 3, 4, 5])
    assert load() == (0, 0, 0, [1, 2, 3, 4, 5])
    assert len(store.batches()) == 3
    assert etl.ingest(spark, str(folder), store, "named")["added"]["tweets"] == 0


def test_ranges_over_a_clustered_copy(spark, tmp_path):
    """Two ranges read few row groups of a copy along a curve, and rows of later batches are found too."""
    store, folder = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    folder.mkdir()

    def put(name, ids):
        with gzip.open(folder / f"{name}.jsonl.gz", "wt") as f:
            f.write("".join(json.dumps({"id": i, "user": {"id": i, "followers_count": (i * 7919) % 1000 if i % 50 else None, "friends_count": (i * 104729) % 997}}) + "\n" for i in ids))
        etl.ingest(spark, str(folder), store)

    put("a", range(4000))
    path = store.compact("users", ["followers_count", "friends_count"], 32, curve=True)
    store.compact("users", ["id"], 2)
    put("b", range(4000, 4100))
    ranges = {"followers_count": (100, 180), "friends_count": (None, 90)}
    got = store.find("users", ranges)
    want = [i for i in range(4100) if i % 50 and 100 <= (i * 7919) % 1000 <= 180 and (i * 104729) % 997 <= 90]
    assert sorted(r.id for r in got.collect()) == want and any(i >= 4000 for i in want)
    assert any(path in f for f in got.inputFiles()) and len(got.inputFiles()) > 32
    plain = store.find("users", {"statuses_count": (0, None)})
    assert plain.count() == 0 and not any("/clustered/" in f for f in plain.inputFiles())
    assert [r.id for r in store.find("users", {"id": (7, 8)}).orderBy("id").collect()] == [7, 8]
    groups = layout.footers(spark, path).where("column IN ('followers_count', 'friends_count')").groupBy("file", "row_group").pivot("column").agg(F.min(F.col("low").cast("int")).alias("low"), F.max(F.col("high").cast("int")).alias("high"))
    assert groups.where("followers_count_low <= 180 AND followers_count_high >= 100 AND friends_count_low <= 90").count() <= 0.3 * groups.count()


def test_a_load_reads_the_batches_of_its_keys(spark, tmp_path, monkeypatch):
    """Five batches of ids that grow, then rows of the last, of two and of all of them: what is read does not grow with the number of batches, and what is added is the same as without bounds."""
    store, folder, read = Store(spark, str(tmp_path / "store")), tmp_path / "in", []
    folder.mkdir()

    def load(name, ids):
        with gzip.open(folder / f"{name}.jsonl.gz", "wt") as f:
            f.write("".join(json.dumps({"id": i, "text": f"t{i}"}) + "\n" for i in ids))
        read.clear()
        return etl.ingest(spark, str(folder), store)["added"]["tweets"]

    plain = Store.table
    monkeypatch.setattr(Store, "table", lambda self, name, batches=None: (read.append(len(batches)) if name == "tweets" and batches is not None else None) or plain(self, name, batches))
    for k in range(5):
        assert load(f"a{k}", range(100 * k, 100 * k + 20)) == 20 and read == []
    assert load("b", range(400, 430)) == 10 and read == [1]
    assert load("c", range(110, 205)) == 80 and read == [2]
    assert load("d", [0, 5000, 219]) == 1 and read == [7]
    assert store.table("tweets").count() == store.table("tweets").select("id").distinct().count() == 5 * 20 + 10 + 80 + 1


def test_undecodable_bytes_vanish(spark, archive, records):
    """Broken sequences go, replacement characters that are there stay."""
    assert {r.id: r.full_text for r in flatten(records)["tweets"].collect()}[6] == "bad  byte"
    rows = [bytearray(b) for b in (b"a\xffb", b"\xe2\x82", "é\ufffdx".encode() + b"\xc3(", "plain \ufffd".encode(), b"\xf0\x9f\x98\x80\xed\xa0\x80", b"")]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(rows)], "i int, b binary").select("i", S.utf8_without_errors(F.col("b")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [bytes(b).decode("utf-8", "ignore") for b in rows]


def test_first_of_a_key_by_file_and_line(spark, tmp_path):
    """Of several rows of a key the one that stands first in the first file stays, whatever its values are."""
    for name, users in (("a", ["zz", "mm"]), ("b", ["aa"])):
        with gzip.open(tmp_path / f"{name}.jsonl.gz", "wt") as f:
            for k, u in enumerate(users):
                f.write(json.dumps({"id": k, "user": {"id": 1, "screen_name": u}}) + "\n")
    store = Store(spark, str(tmp_path / "store"))
    etl.ingest(spark, str(tmp_path), store)
    assert rows(store.table("users").select("id", "screen_name")) == [(1, "zz")]
    follow(spark, str(tmp_path), stream := Store(spark, str(tmp_path / "stream")), str(tmp_path / "cp"), files_at_a_time=2).awaitTermination(120)
    assert rows(stream.table("users").select("id", "screen_name")) == [(1, "zz")]


def test_wall_clock_in_any_zone(spark):
    """No session time zone, and no hour that a zone leaves out, moves a time."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("Europe/Bratislava", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.createDataFrame([("Sun Mar 29 02:30:00 +0000 2020",), ("2020-03-29T02:30:00Z",), ("Sun Mat 29 02:30:00 +0000 2020",), ("Sun Feb 30 02:30:00 +0000 2020",)], "s string")
            assert [r.t for r in df.select(S.timestamp(F.col("s")).cast("string").alias("t")).collect()] == ["2020-03-29 02:30:00", "2020-03-29 02:30:00", None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_values_survive_a_round_trip(spark, tmp_path):
    """NULL, tab, quote, newline and backslash through the files of a table, and through a delimited text."""
    values = [(1, None), (2, "tab\there"), (3, 'a "quote"'), (4, "line\nbreak"), (5, "back\\slash"), (6, "")]
    df = spark.createDataFrame(values, "i int, s string")
    df.write.parquet(str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == values
    options = {"sep": "\t", "nullValue": "\\N", "emptyValue": "", "multiLine": True, "escape": '"', "quoteAll": True}
    df.coalesce(1).write.options(**options).csv(str(tmp_path / "c"))
    back = spark.read.options(**options).schema("i int, s string").csv(str(tmp_path / "c"))
    assert rows(back.where("s IS NOT NULL AND s <> ''")) == [v for v in values if v[1]]


def test_stream_equals_batch(spark, archive, tmp_path):
    batch, stream = Store(spark, str(tmp_path / "batch")), Store(spark, str(tmp_path / "stream"))
    etl.ingest(spark, str(archive), batch)
    follow(spark, str(archive), stream, str(tmp_path / "checkpoint")).awaitTermination(120)
    for name in ("tweets", "users", "tweet_hashtag", "tweet_urls", "tweet_media"):
        assert rows(batch.table(name)) == rows(stream.table(name)), name
    assert len(stream.batches()) == 2


@pytest.mark.parametrize("text,expected", [("Sat Aug 01 01:59:54 +0000 2020", datetime(2020, 8, 1, 1, 59, 54)), ("2020-08-01T01:59:54+02:00", datetime(2020, 8, 1, 1, 59, 54)), ("2020-08-01 01:59:54", datetime(2020, 8, 1, 1, 59, 54)), ("nonsense", None), ("", None), (None, None)])
def test_timestamp(spark, text, expected):
    assert spark.createDataFrame([(text,)], "s string").select(S.timestamp(F.col("s")).alias("t")).first().t == expected


def test_scalars(spark):
    df = spark.createDataFrame([(" 5 ", '<a href="x">App</a>tail', "", bytearray(b"a\xffb"), "abcab")], "i string, s string, e string, b binary, t string")
    r = df.select(S.to_long(F.col("i")), S.clean_source(F.col("s")), S.clean_source(F.col("e")), S.utf8_without_errors(F.col("b")), S.trigrams(F.col("t")), S.trigrams(F.col("e")), S.round_half_up(F.lit("2.345"), 2).cast("string")).first()
    assert tuple(r) == (5, "App", None, "ab", ["abc", "bca", "cab"], [], "2.35")


def test_load_asks_the_records_once(spark, tmp_path, monkeypatch):
    """A load's counts and the bounds of its keys come from one pass: no table with bounds is read for them, and the batches that are met are the same."""
    record = lambda i: json.dumps({"id": i, "user": {"id": i % 7 + 1}, "text": "a\u0000b", "created_at": "Sat Aug 1 01:59:54 +0000 2020", "entities": {"urls": [{"url": "s", "expanded_url": f"e{i}"}], "user_mentions": [{"id": 3}], "hashtags": [{"text": "x"}]}})
    lines = [record(i) for i in range(5, 40)] + ['{"id": "abc"}', "[1]"]
    records = parsed(spark.createDataFrame([("f", n, v) for n, v in enumerate(lines)], "file string, line bigint, value string"))
    ends = {name: tuple(records.agg(*b).first()) for name, b in lead_bounds().items()}
    staged = flatten(records, placed=True)
    for name, (low, high) in ends.items():
        lead = F.col(REQUIRED[name][0])
        assert all(x is None or low <= x <= high for x in staged[name].agg(F.min(lead), F.max(lead)).first()), name
    assert ends["tweets"] == ends["tweet_urls"] == (5, 39) and ends["users"] == (1, 7)
    assert [tuple(r) for r in staged["tweets"].select("full_text", F.col("created_at").cast("string")).distinct().collect()] == [("ab", "2020-08-01 01:59:54")]
    store, asked, touched = Store(spark, str(tmp_path / "store")), [], Store.touched
    monkeypatch.setattr(Store, "touched", lambda self, name, done, rows, bounds=None: asked.append((name, bounds)) or touched(self, name, done, rows, bounds))
    for n, part in enumerate((lines[:20], lines)):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.jsonl.gz").write_bytes(gzip.compress("\n".join(part).encode()))
        told = etl.ingest(spark, str(tmp_path / "in"), store)
        assert (told["lines"], told["rejected"], told["lost"]["id"]) == (len(part), n, 0)
    assert told["added"]["tweets"] == 15 and told["added"]["users"] == 0 and dict(asked[-8:]) == {name: ends.get(name) for name in TABLES}


def test_records_are_kept_in_files(spark, archive, tmp_path, monkeypatch):
    """While eight tables are merged the records lie in files, not in Spark's cache; each table reads the fields that it has, and the files go, also after an error."""
    left = lambda folder: [p.name for p in folder.glob("kept-*")]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    here, seen = tmp_path.__class__(shared(spark).removeprefix("file://")), []
    before = left(here)
    monkeypatch.setattr(archive_queries, "counts", lambda tables, told=archive_queries.counts: seen.extend((n, plan(df), df.inputFiles()) for n, df in tables.items()) or told(tables))
    got = {r.table_name: r.row_count for r in archive_queries.archive_table_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got["tweets"] == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count() and len(seen) == 8
    for name, text, files in seen:
        assert "InMemoryTableScan" not in text and all("/kept-" in f for f in files), name
    places = next(text for name, text, _ in seen if name == "places")
    assert "place_type" in places and "retweet_count" not in places
    assert left(here) == before

    store, held = Store(spark, str(tmp_path / "store")), []
    monkeypatch.setattr(Store, "load", lambda self, batch, tables, load=Store.load, **more: held.append((plan(tables["tweets"]), left(tmp_path / "store" / "_kept"))) or load(self, batch, tables, **more))
    assert etl.ingest(spark, str(archive), store)["added"]["tweets"] == 8
    follow(spark, str(archive), Store(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint"), files_at_a_time=2).awaitTermination(120)
    assert len(held) == 2 and all("InMemoryTableScan" not in text and len(paths) == 1 for text, paths in held) and not left(tmp_path / "store" / "_kept")
    with pytest.raises(ZeroDivisionError), kept(spark.range(3), str(tmp_path / "other")) as rows_kept:
        assert rows_kept.count() == 3 and len(left(tmp_path / "other")) == 1
        1 / 0
    assert not left(tmp_path / "other")
