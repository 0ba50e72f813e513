"""Queries over a whole archive made from the driver's tables: raw JSON lines, parsed, flattened and merged, beside the same counted in SQL."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.flatten import flatten
from ..operators.merge import append_rows, new_rows, stamped
from ..operators.relational import counts
from ..schemas import KEYS, REQUIRED, TABLES
from ..sources.archive import parsed
from .catalogue import _t, query
from .etl import dangling_references
from .etl import ingest as etl_ingest
from .store import Store, kept, shared


def raw_lines(spark, sf_dir: str) -> DataFrame:
    """(file, line, value): a record for each order, every tenth one twice, and some lines that are none."""
    key = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    user = F.struct(
        F.col("o_custkey").alias("id"), F.concat(F.lit("u"), text(F.col("o_custkey"))).alias("screen_name"), F.when(F.col("o_custkey") % 50 == 0, "3000000000").otherwise(text(F.col("o_custkey") * 10)).alias("followers_count"), F.lit("").alias("url")
    )
    tags = F.array(F.struct(F.col("o_orderpriority").alias("text")), F.when(key % 2 == 1, F.struct(F.lower("o_orderpriority").alias("text"))))
    url = lambda n, e: F.struct(F.concat(F.lit(n), text(key)).alias("url"), e.alias("expanded_url"))
    expanded = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("e"), text(key)))
    urls = F.when(key % 2 == 0, F.array(url("s", expanded), url("s", expanded), url("t", expanded)))
    mention = lambda i, n: F.struct(i.cast("bigint").alias("id"), F.lit(n).alias("screen_name"))
    mentions = F.when(key % 5 == 0, F.array(mention(key % 7, None), mention(key % 7, "X"), mention(F.lit(None), "Ab"), mention(F.lit(None), "aB")))
    media = F.when(key % 6 == 0, F.array(F.struct(key.alias("id"), F.lit("photo").alias("type")), F.struct(key.alias("id"), F.lit("photo").alias("type"))))
    record = F.struct(
        key.alias("id"), F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "'Sat 'MMM dd HH:mm:ss' +0200 'yyyy").alias("created_at"), F.col("o_orderstatus").alias("lang"), (key % 9 == 0).alias("truncated"),
        F.concat(F.lit("cut "), F.col("o_orderpriority")).alias("text"), F.when(key % 9 == 0, F.struct(F.concat(F.lit("whole "), F.col("o_orderpriority")).alias("full_text"), F.struct(tags.alias("hashtags"), urls.alias("urls"), mentions.alias("user_mentions")).alias("entities"))).alias("extended_tweet"),
        F.concat(F.lit('<a href="x">'), F.col("o_orderstatus"), F.lit("</a>")).alias("source"), F.when(key % 3 == 0, key + 7).alias("in_reply_to_status_id"), F.when(key % 11 == 0, text(key + 1)).alias("quoted_status_id"),
        F.when(key % 4 == 1, F.struct((-key - 1).alias("id"))).alias("retweeted_status"), (key % 100).alias("retweet_count"), user.alias("user"), F.when(key % 3 == 0, F.struct(F.concat(F.lit("p"), text(key % 25)).alias("id"))).alias("place"),
        F.struct(tags.alias("hashtags"), urls.alias("urls"), mentions.alias("user_mentions")).alias("entities"), F.struct(media.alias("media")).alias("extended_entities"), F.array(F.lit(0), F.lit(140)).alias("display_text_range"),
    )
    rows = _t(spark, sf_dir, "orders").select(F.lit("orders").alias("file"), key.alias("line"), F.to_json(record).alias("value"))
    broken = spark.createDataFrame([("broken", 0, '{"id": "abc"}'), ("broken", 1, '{"id": 5'), ("broken", 2, "[1, 2]"), ("broken", 3, '{"text": "no id"}')], "file string, line bigint, value string")
    return rows.union(rows.where("line % 10 = 0")).union(broken)


def loaded(records: DataFrame) -> dict[str, DataFrame]:
    """The eight tables after one load of parsed lines."""
    staged = flatten(records, placed=True)
    return {name: new_rows(None, staged[name], KEYS[name], REQUIRED[name], [F.col("_at")]).drop("_at") for name in TABLES}


@query("""
SELECT 'users' AS table_name, count(DISTINCT o_custkey) AS row_count FROM orders
UNION ALL SELECT 'places', count(DISTINCT o_orderkey % 25) FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'hashtags', count(DISTINCT lower(o_orderpriority)) FROM orders
UNION ALL SELECT 'tweets', count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'tweet_hashtag', count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'tweet_urls', sum(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END)::BIGINT FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'tweet_user_mentions', 2 * count(*) FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'tweet_media', count(*) FROM orders WHERE o_orderkey % 6 = 0""")
def archive_table_counts(spark, sf_dir):
    """Raw lines to eight merged tables, counted: parsed once and kept for that long, as in a load."""
    with kept(parsed(raw_lines(spark, sf_dir)).drop("value"), shared(spark)) as records:
        found = counts(loaded(records)).collect()  # a row for each table
    return spark.createDataFrame(found, "table_name string, row_count bigint")


@query("""
SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderkey % 9 = 0 THEN 'whole ' ELSE 'cut ' END || o_orderpriority AS full_text,
       CASE WHEN o_orderkey % 9 <> 0 THEN 140 END AS display_to, o_orderstatus AS lang, o_orderstatus AS source, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 7 END AS in_reply_to_status_id,
       CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1 END AS quoted_status_id, CASE WHEN o_orderkey % 4 = 1 THEN -o_orderkey - 1 END AS retweeted_status_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_orderkey % 25) END AS place_id, CAST(o_orderkey % 100 AS INTEGER) AS retweet_count FROM orders""")
def archive_tweets(spark, sf_dir):
    """The rows of the largest table after the load."""
    return loaded(parsed(raw_lines(spark, sf_dir)))["tweets"].select("id", "created_at", "full_text", "display_to", "lang", "source", "user_id", "in_reply_to_status_id", "quoted_status_id", "retweeted_status_id", "place_id", "retweet_count")


@query("SELECT DISTINCT o_custkey AS id, 'u' || o_custkey AS screen_name, CASE WHEN o_custkey % 50 <> 0 THEN CAST(o_custkey * 10 AS INTEGER) END AS followers_count FROM orders")
def archive_users(spark, sf_dir):
    """Users with counters, NULL where a counter is out of range."""
    return loaded(parsed(raw_lines(spark, sf_dir)))["users"].select("id", "screen_name", "followers_count")


@query("""
SELECT o_orderkey AS tweet_id, unnest(CASE WHEN o_orderkey % 4 = 0 THEN ['s' || o_orderkey, 't' || o_orderkey] ELSE ['s' || o_orderkey] END) AS url FROM orders WHERE o_orderkey % 2 = 0""")
def archive_urls(spark, sf_dir):
    """Links, one for each tweet and target; the first of the line wins."""
    return loaded(parsed(raw_lines(spark, sf_dir)))["tweet_urls"].select("tweet_id", "url")


@query("""
SELECT CAST(sum(CASE WHEN o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey + 7) THEN 1 ELSE 0 END) AS BIGINT) AS replies_without_parent,
       CAST(sum(CASE WHEN o_orderkey % 11 = 0 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey + 1) THEN 1 ELSE 0 END) AS BIGINT) AS quotes_without_parent,
       CAST(sum(CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS retweets_without_parent FROM orders o""")
def archive_dangling(spark, sf_dir):
    """Replies, quotes and retweets of tweets that the archive lacks. The lines are parsed and merged once; what is kept for the look-ups is four numbers a tweet."""
    keys = loaded(parsed(raw_lines(spark, sf_dir)))["tweets"].select("id", "in_reply_to_status_id", "quoted_status_id", "retweeted_status_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = dangling_references(keys).collect()  # one row
    finally:
        keys.unpersist()
    return spark.createDataFrame(found, "replies_without_parent bigint, quotes_without_parent bigint, retweets_without_parent bigint")


@query("""
SELECT o_orderkey % 10 AS load_group, count(*) AS tweets, CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS of_first_load FROM orders GROUP BY 1""")
def archive_two_loads(spark, sf_dir):
    """A folder that is loaded, grows and is loaded again, the third load finding nothing: the first file has every fourth record, the second all of them."""
    folder = f"{shared(spark)}/grows-{uuid.uuid4().hex}"
    raw, store = raw_lines(spark, sf_dir).where("file = 'orders'").select("line", "value"), Store(spark, f"{folder}/store")

    def put(rows):
        rows.select("value").write.mode("append").option("compression", "gzip").text(f"{folder}/files")
        return etl_ingest(spark, f"{folder}/files", store, pattern="*.txt.gz")

    put(raw.where("line % 4 = 0"))
    first = store.table("tweets").select("id").withColumn("early", F.lit(1))
    put(raw)
    again = etl_ingest(spark, f"{folder}/files", store, pattern="*.txt.gz")
    assert not again["files"], "a third load finds no file that is new"
    both = store.table("tweets").select("id").join(first, "id", "left")
    return both.groupBy((F.col("id") % 10).alias("load_group")).agg(F.count("*").alias("tweets"), F.sum(F.coalesce("early", F.lit(0))).cast("bigint").alias("of_first_load"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT -1, 'Somebody new', NULL")
def insert_values(spark, sf_dir):
    """One row of values, a column left out."""
    return append_rows(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), [{"c_custkey": -1, "c_name": "Somebody new"}])


@query("SELECT c_custkey, true AS is_recent FROM customer UNION ALL SELECT -1, true")
def insert_now(spark, sf_dir):
    """Rows with the time of their load, and one more: all are of the last hour."""
    new = stamped(append_rows(_t(spark, sf_dir, "customer").select("c_custkey"), [{"c_custkey": -1}]))
    return new.select("c_custkey", (F.col("created_at") > F.current_timestamp().cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")).alias("is_recent"))
