"""Physical layout in place of indexes: what to cluster by, what the files say, what a plan reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.footers import footers, pages
from .store import Store

#: (table, lookup) and the layout that serves it.
ADVICE = [
    ("users", "lower(screen_name)", "stored lower-case column with a Parquet bloom filter"),
    ("users", "followers_count, friends_count, statuses_count", "range partitions sorted by the three columns"),
    ("users", "lower(description)", "trigram table clustered by gram, else scan"),
    ("tweets", "user_id, created_at desc", "range partitions by user_id, sorted by both"),
    ("tweets", "lang", "partition folders or dictionary pruning"),
    ("tweets", "in_reply_to_status_id", "Parquet bloom filter"),
    ("tweets", "quoted_status_id", "Parquet bloom filter"),
    ("tweets", "retweeted_status_id", "Parquet bloom filter"),
    ("tweets", "place_id", "Parquet bloom filter"),
    ("tweets", "retweet_count", "row-group bounds after sorting by it"),
    ("tweets", "full_text", "trigram table clustered by gram, else scan"),
    ("tweet_hashtag", "tweet_id", "buckets by tweet_id"),
    ("tweet_hashtag", "hashtag_id", "Parquet bloom filter"),
    ("tweet_urls", "tweet_id", "buckets by tweet_id"),
    ("tweet_user_mentions", "tweet_id", "buckets by tweet_id"),
    ("tweet_media", "tweet_id", "buckets by tweet_id"),
]


def advice(spark: SparkSession, table: str) -> DataFrame:
    """(table_name, lookup, layout): what would serve a table's look-ups."""
    return spark.createDataFrame([r for r in ADVICE if r[0] == table], "table_name STRING, lookup STRING, layout STRING")


def describe_layout(store: Store, table: str) -> DataFrame:
    """(table_name, layout, columns, files, batches, path): what there is. The snapshots of the published batches, in no order, and the clustered copies with their bloom filters."""
    done = store.batches()
    rows = [(table, "snapshot", "", None, 1, f"{b['path']}/{table}") for b in done]
    for x in store.layouts():
        if x["table"] == table:
            rows.append((table, "clustered", ", ".join(x["order"]), x["files"], x["batches"], x["path"]))
            rows += [(table, "bloom filter", c, x["files"], x["batches"], x["path"]) for c in x["bloom"]]
    return store.spark.createDataFrame(rows, "table_name STRING, layout STRING, columns STRING, files INT, batches INT, path STRING")


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def pushed_filters(df: DataFrame) -> list[str]:
    """What the scans of a plan are asked to filter by."""
    return [x.strip() for line in plan_text(df).splitlines() if line.startswith("PushedFilters:") for x in line.removeprefix("PushedFilters: [").rstrip("]").split(", ") if x.strip()]


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of a catalogue table for the cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
