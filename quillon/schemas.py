"""Raw record, table schemas and merge keys of the social archive."""

from pyspark.sql import types as T

_MEDIA = "ARRAY<STRUCT<id STRING, type STRING, media_url STRING, media_url_https STRING, display_url STRING, expanded_url STRING>>"
_ENTITIES = (
    "STRUCT<hashtags ARRAY<STRUCT<text STRING>>, urls ARRAY<STRUCT<url STRING, expanded_url STRING, display_url STRING, unwound_url STRING>>, "
    f"user_mentions ARRAY<STRUCT<id STRING, screen_name STRING, name STRING>>, media {_MEDIA}>"
)
#: Integers are read as text: a quoted number would be lost otherwise.
RAW = (
    "id STRING, created_at STRING, text STRING, full_text STRING, truncated BOOLEAN, lang STRING, source STRING, in_reply_to_status_id STRING, quoted_status_id STRING, "
    "retweeted_status STRUCT<id STRING>, retweet_count STRING, favorite_count STRING, possibly_sensitive BOOLEAN, display_text_range ARRAY<STRING>, "
    "user STRUCT<id STRING, screen_name STRING, name STRING, description STRING, verified BOOLEAN, protected BOOLEAN, followers_count STRING, friends_count STRING, statuses_count STRING, "
    "created_at STRING, location STRING, url STRING, entities STRUCT<url STRUCT<urls ARRAY<STRUCT<expanded_url STRING>>>>>, "
    "place STRUCT<id STRING, full_name STRING, country STRING, country_code STRING, place_type STRING>, "
    f"entities {_ENTITIES}, extended_entities STRUCT<media {_MEDIA}>, extended_tweet STRUCT<full_text STRING, display_text_range ARRAY<STRING>, entities {_ENTITIES}>, _corrupt STRING"
)

#: Columns of each table, in order.
TABLES = {
    "users": "id BIGINT, screen_name STRING, name STRING, description STRING, verified BOOLEAN, protected BOOLEAN, followers_count INT, friends_count INT, statuses_count INT, created_at TIMESTAMP_NTZ, location STRING, url STRING",
    "places": "id STRING, full_name STRING, country STRING, country_code STRING, place_type STRING",
    "hashtags": "id BIGINT, tag STRING",
    "tweets": "id BIGINT, created_at TIMESTAMP_NTZ, full_text STRING, display_from INT, display_to INT, lang STRING, user_id BIGINT, source STRING, in_reply_to_status_id BIGINT, quoted_status_id BIGINT, retweeted_status_id BIGINT, place_id STRING, retweet_count INT, favorite_count INT, possibly_sensitive BOOLEAN",
    "tweet_hashtag": "tweet_id BIGINT, hashtag_id BIGINT",
    "tweet_urls": "tweet_id BIGINT, url STRING, expanded_url STRING, display_url STRING, unwound_url STRING",
    "tweet_user_mentions": "tweet_id BIGINT, mentioned_user_id BIGINT, mentioned_screen_name STRING, mentioned_name STRING",
    "tweet_media": "tweet_id BIGINT, media_id BIGINT, type STRING, media_url STRING, media_url_https STRING, display_url STRING, expanded_url STRING",
}

#: Merge keys as SQL expressions. A row conflicts if all of them are equal; see operators.merge for nulls.
KEYS = {
    "users": ["id"],
    "places": ["id"],
    "hashtags": ["id"],
    "tweets": ["id"],
    "tweet_hashtag": ["tweet_id", "hashtag_id"],
    "tweet_urls": ["tweet_id", "coalesce(nullif(expanded_url, ''), url)"],
    "tweet_user_mentions": ["tweet_id", "CASE WHEN mentioned_user_id IS NOT NULL THEN concat('i:', mentioned_user_id) WHEN mentioned_screen_name IS NOT NULL THEN concat('s:', lower(mentioned_screen_name)) END"],
    "tweet_media": ["tweet_id", "media_id", "type", "media_url", "media_url_https", "display_url", "expanded_url"],
}

#: Columns without which a row is dropped.
REQUIRED = {"users": ["id"], "places": ["id"], "hashtags": ["id"], "tweets": ["id"], "tweet_hashtag": ["tweet_id", "hashtag_id"], "tweet_urls": ["tweet_id"], "tweet_user_mentions": ["tweet_id"], "tweet_media": ["tweet_id"]}

#: (table, column, referenced table, column): what a delete of the referenced row does.
REFERENCES = [
    ("tweets", "user_id", "users", "id", "set null"),
    ("tweets", "place_id", "places", "id", "set null"),
    ("tweet_hashtag", "tweet_id", "tweets", "id", "cascade"),
    ("tweet_hashtag", "hashtag_id", "hashtags", "id", "cascade"),
    ("tweet_urls", "tweet_id", "tweets", "id", "cascade"),
    ("tweet_user_mentions", "tweet_id", "tweets", "id", "cascade"),
    ("tweet_media", "tweet_id", "tweets", "id", "cascade"),
]


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
