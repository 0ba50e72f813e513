"""URL filters: explicit rules for hosts and paths, else association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

import json
import zlib
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_examples import examples

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of an index that goes to the tasks as a constant of the plan; more are matched by a join.
INDEX_RULES = 20_000
_RULE = "array<array<struct<anchor: string, tokens: array<string>, confidence: double>>>"


class HostRule(NamedTuple):
    """A verdict for a host with all its subdomains and the paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_rules(text: str) -> list[HostRule]:
    """Rules from lines such as `block example.org/es/`; the first slash ends the host."""
    out = []
    for line in filter(None, map(str.strip, text.split("\n"))):
        verdict, _, rule = line.partition(" ")
        host, slash, rest = rule.strip().partition("/")
        out.append(HostRule(verdict, host, slash + rest))
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host is what stands after the first :// up to /, ? or # or the end, with A-Z lowered; the path is what follows up to ? or # or the end. Both empty if the url is null or has no ://."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The different tokens of a URL: letters and digits of its host (`h:`, zones too) and of its path and query (`p:`) that hold a letter, lowered."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host, tail = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), F.regexp_extract(rest, r"(?s)\A[^/?#]*(.*)", 1)
    words = lambda c, kind: F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*)"), 1), lambda w: F.concat(F.lit(kind), w))
    return F.coalesce(F.array_distinct(F.concat(words(host, "h:"), words(tail, "p:"))), F.array().cast("array<string>"))


def by_rules(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does. Of equally long ones the first wins; rules are a list in the plan, so they are few."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):  # the longest is asked first: the last one wrapped around the others
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "label", target: str = "block", support: float = 0.001, confidence: float = 0.9) -> DataFrame:
    """(tokens, confidence, lift, support): sets of tokens whose URLs have the target label, from all labelled URLs.

    FP-growth runs on Spark over the tokens of each URL and its label. Rules under the support or confidence are dropped, and so are those that hold the tokens of a
    shorter one of no less confidence. Null labels take no part; null URLs have no tokens; no rows give no rules.
    """
    mark = F.concat(F.lit("="), F.col(label_col))
    baskets = labelled.where(F.col(label_col).isNotNull()).select(F.array_append(tokens(F.col(url_col)), mark).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == f"={target}"))
    rules = found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support").where(~F.exists("tokens", lambda t: t.startswith("=")))
    short, long = rules.alias("short"), rules.alias("long")
    # rules meet by a token of the shorter one, not each with each
    inside = long.withColumn("t", F.explode("tokens")).join(short.withColumn("t", F.element_at("tokens", 1)).alias("short"), "t").where(
        (F.size("short.tokens") < F.size("long.tokens")) & (F.size(F.array_except("short.tokens", "long.tokens")) == 0) & (F.col("short.confidence") >= F.col("long.confidence"))
    )
    return rules.join(inside.select(F.col("long.tokens").alias("tokens")).distinct(), "tokens", "left_anti")


def _anchored(rules: DataFrame) -> DataFrame:
    """rules with `anchor`, the token of each that the fewest rules hold (then the first in order): an inverted index has each rule once."""
    held = rules.select(F.explode("tokens").alias("anchor"), "tokens", "confidence")
    many = held.groupBy("anchor").agg(F.count("*").alias("n"))
    return held.join(many, "anchor").groupBy("tokens", "confidence").agg(F.min(F.struct("n", "anchor"))["anchor"].alias("anchor"))


def _place(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


def matched(urls: DataFrame, rules: DataFrame, url_col: str = "url", most: int = INDEX_RULES) -> DataFrame:
    """urls with `found`: the surest rule (struct of confidence and tokens) whose tokens the URL has all; null if there is none.

    The rules form an inverted index by their rarest token. Up to `most` rules it is a constant of the plan, an array of buckets by the tokens' checksum, so that no row is shuffled
    and a URL asks only the buckets of its own tokens. More rules than that are joined by their anchors: URLs are told apart by a row number of their own, and only candidates are shuffled with it.
    """
    spark, rules = urls.sparkSession, _anchored(rules)
    table = rules.limit(most + 1).collect()
    if len(table) > most:
        return _joined(urls, rules, url_col)
    buckets = 1 << max(len(table) * 2 - 1, 1).bit_length()
    index: list[list[dict]] = [[] for _ in range(buckets)]
    for r in sorted(table, key=lambda r: (-r.confidence, r.tokens)):
        index[_place(r.anchor, buckets)].append({"anchor": r.anchor, "tokens": r.tokens, "confidence": r.confidence})
    constant = F.from_json(F.lit(json.dumps(index)), _RULE)
    words = F.col("_tokens")
    hits = F.flatten(F.transform(words, lambda t: F.filter(F.get(constant, (F.crc32(t.cast("binary")) % buckets).cast("int")), lambda r: (r["anchor"] == t) & (F.size(F.array_except(r["tokens"], words)) == 0))))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["confidence"].alias("confidence"), r["tokens"].alias("tokens"))))
    held = [F.col(f"`{c}`") for c in urls.columns]
    return urls.select(F.struct(*held).alias("_row"), tokens(F.col(f"`{url_col}`")).alias("_tokens")).select("_row", best.alias("found")).select("_row.*", "found")


def _joined(urls: DataFrame, rules: DataFrame, url_col: str) -> DataFrame:
    """matched() for any number of rules. Equal URLs are asked once, and only the URLs themselves meet the rules."""
    asked = urls.select(F.col(f"`{url_col}`").alias("_url")).distinct()
    words = asked.select("_url", tokens(F.col("_url")).alias("_tokens"))
    met = words.select("_url", "_tokens", F.explode("_tokens").alias("anchor")).join(rules, "anchor").where(F.size(F.array_except("tokens", "_tokens")) == 0)
    best = met.groupBy("_url").agg(F.max(F.struct("confidence", "tokens")).alias("found"))
    held = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("_row"), F.col(f"`{url_col}`").alias("_key"))
    return held.join(best, F.col("_key") == F.col("_url"), "left").select("_row.*", "found")


def judged(pages: DataFrame, explicit: list[HostRule], rules: DataFrame, id_col: str = "page_id", url_col: str = "url", most: int = INDEX_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence, tokens) for each row: the verdict of the longest explicit rule that fits, else block if an association rule matches, else allow.

    A null url, or one without ://, has empty host and path and is allowed. Rows with equal or null ids are judged each by itself; no rows give none.
    """
    host, path = url_parts(F.col("url"))
    rows = matched(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), rules, "url", most)
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "found")
    rows = rows.withColumn("by", by_rules(F.col("host"), F.col("path"), explicit))
    verdict = F.coalesce(F.col("by.verdict"), F.when(F.col("found").isNotNull(), F.lit("block")).otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), F.col("found.confidence").alias("confidence"), F.col("found.tokens").alias("tokens"))


RULES = """
allow org/
block example.org/es/
block example.org/en/1
allow com/fr/
block com/de/
"""


def learnt(spark: SparkSession) -> DataFrame:
    """The association rules of the labelled URLs that come with the package."""
    return mine(spark.createDataFrame(examples(), "url string, label string"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), host_rules(RULES), learnt(spark)).drop("confidence", "tokens")
