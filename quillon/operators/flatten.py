"""One nested record to rows of eight tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import TABLES, struct


def _any_field(c: Column, names: list[str]) -> Column:
    """Whether a struct has any of its fields: an empty object is a struct of NULLs."""
    out = F.lit(False)
    for n in names:
        out = out | c[n].isNotNull()
    return out


def _record(records: DataFrame) -> DataFrame:
    """id, r (the record), long (whether the extended text counts), entities, media and _at (file and line, where the records have them), for records with an integer id."""
    r = F.col("record")
    ext = r["extended_tweet"]
    use = F.coalesce(r["truncated"], F.lit(False)) & ((F.coalesce(ext["full_text"], F.lit("")) != "") | F.coalesce(_any_field(ext["entities"], ["hashtags", "urls", "user_mentions", "media"]), F.lit(False)))
    place = F.struct("file", "line") if {"file", "line"} <= set(records.columns) else F.lit(0)
    out = records.select(S.to_long(r["id"]).alias("id"), r.alias("r"), use.alias("long"), place.alias("_at")).where("id is not null")
    out = out.withColumn("entities", F.when(F.col("long"), F.col("r.extended_tweet.entities")).otherwise(F.col("r.entities")))
    return out.withColumn("media", F.when(F.size("r.extended_entities.media") > 0, F.col("r.extended_entities.media")).otherwise(F.col("entities.media")))


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table in order, texts without NUL, then _at."""
    fields = struct(table)
    return df.select(*[(S.strip_nul(F.col(f.name)) if f.dataType.typeName() == "string" else F.col(f.name).cast(f.dataType)).alias(f.name) for f in fields], "_at")


def _items(rows: DataFrame, column: str) -> DataFrame:
    """(tweet_id, _at, e) for each item that is not NULL."""
    return rows.select(F.col("id").alias("tweet_id"), "_at", F.explode(column).alias("e")).where("e is not null")


def flatten(records: DataFrame, placed: bool = False) -> dict[str, DataFrame]:
    """The rows of each table of schemas.TABLES, repeats included, from a DataFrame with a column record (schemas.RAW). Keep records before (plans.store.kept): eight tables read it.

    placed: a last column, _at, says where a row comes from, if records have the columns file and line; of several rows of a key a merge keeps the first.
    """
    rows = _record(records)
    r, user, place = F.col("r"), F.col("r.user"), F.col("r.place")
    span = F.when(F.col("long"), F.col("r.extended_tweet.display_text_range")).otherwise(F.col("r.display_text_range"))
    begin, end = S.text_range(span)
    out = {}
    out["users"] = rows.select(
        S.to_long(user["id"]).alias("id"), user["screen_name"].alias("screen_name"), user["name"].alias("name"), user["description"].alias("description"), user["verified"].alias("verified"),
        user["protected"].alias("protected"), *[S.to_int(user[c]).alias(c) for c in ("followers_count", "friends_count", "statuses_count")], S.timestamp(user["created_at"]).alias("created_at"),
        user["location"].alias("location"), F.coalesce(S.non_empty(user["url"]), F.try_element_at(user["entities"]["url"]["urls"], F.lit(1))["expanded_url"]).alias("url"), "_at",
    ).where("id is not null")
    out["places"] = rows.select(*[place[c].alias(c) for c in ("id", "full_name", "country", "country_code", "place_type")], "_at").where("id is not null and id <> ''")
    out["tweets"] = rows.select(
        "id", S.timestamp(r["created_at"]).alias("created_at"), F.when(F.col("long"), r["extended_tweet"]["full_text"]).otherwise(F.coalesce(S.non_empty(r["full_text"]), r["text"])).alias("full_text"),
        begin.alias("display_from"), end.alias("display_to"), r["lang"].alias("lang"), S.to_long(user["id"]).alias("user_id"), S.clean_source(r["source"]).alias("source"),
        S.to_long(r["in_reply_to_status_id"]).alias("in_reply_to_status_id"), S.to_long(r["quoted_status_id"]).alias("quoted_status_id"), S.to_long(r["retweeted_status"]["id"]).alias("retweeted_status_id"),
        S.non_empty(place["id"]).alias("place_id"), S.to_int(r["retweet_count"]).alias("retweet_count"), S.to_int(r["favorite_count"]).alias("favorite_count"), r["possibly_sensitive"].alias("possibly_sensitive"), "_at",
    )
    tags = _items(rows, "entities.hashtags").select("tweet_id", S.hashtag_id(F.col("e.text")).alias("hashtag_id"), F.col("e.text").alias("tag"), "_at").where("tag <> ''")
    out["hashtags"] = tags.select(F.col("hashtag_id").alias("id"), "tag", "_at")
    out["tweet_hashtag"] = tags.select("tweet_id", "hashtag_id", "_at")
    out["tweet_urls"] = _items(rows, "entities.urls").select("tweet_id", "e.url", "e.expanded_url", "e.display_url", F.coalesce(S.non_empty(F.col("e.unwound_url")), F.col("e.expanded_url")).alias("unwound_url"), "_at")
    out["tweet_user_mentions"] = _items(rows, "entities.user_mentions").select("tweet_id", S.to_long(F.col("e.id")).alias("mentioned_user_id"), F.col("e.screen_name").alias("mentioned_screen_name"), F.col("e.name").alias("mentioned_name"), "_at")
    out["tweet_media"] = _items(rows, "media").select("tweet_id", S.to_long(F.col("e.id")).alias("media_id"), "e.type", "e.media_url", "e.media_url_https", "e.display_url", "e.expanded_url", "_at")
    return {name: _shaped(out[name], name) if placed else _shaped(out[name], name).drop("_at") for name in TABLES}


def lead_bounds() -> dict[str, tuple[Column, Column]]:
    """Aggregates over records: the least and largest first key column that rows of some tables can have; ids bound those of a tweet's parts too."""
    tweet, user = S.to_long(F.col("record.id")), S.to_long(F.col("record.user.id"))
    return {name: (F.min(c), F.max(c)) for name, c in {"users": user, **dict.fromkeys(("tweets", "tweet_hashtag", "tweet_urls", "tweet_user_mentions", "tweet_media"), tweet)}.items()}


def coercion_losses(records: DataFrame) -> DataFrame:
    """One row: for each integer field the number of non-empty texts that became NULL, out-of-range counters included."""
    return records.agg(*losses(F.lit(True)))


def losses(among: Column) -> list[Column]:
    """The aggregates of coercion_losses() over the records that fulfil a condition."""
    r = F.col("record")
    wide = {"id": r["id"], "user_id": r["user"]["id"], "in_reply_to_status_id": r["in_reply_to_status_id"], "quoted_status_id": r["quoted_status_id"]}
    narrow = {"followers_count": r["user"]["followers_count"], "friends_count": r["user"]["friends_count"], "statuses_count": r["user"]["statuses_count"], "retweet_count": r["retweet_count"], "favorite_count": r["favorite_count"]}
    lost = lambda c, f: F.sum(F.when(among, F.when(S.non_empty(c).isNotNull() & f(c).isNull(), 1).otherwise(0)))
    return [*[lost(c, S.to_long).alias(n) for n, c in wide.items()], *[lost(c, S.to_int).alias(n) for n, c in narrow.items()]]
