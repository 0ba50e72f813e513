"""The registered queries of the archive and spatial operators on the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import spatial as G
from ..operators import spatial_joins as J
from ..operators.merge import insert_ignore, upsert_greatest
from ..operators.search import TrigramIndex, search
from .store import clustered, exists, shared, within

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# scans and predicates


@query("SELECT * FROM customer WHERE c_name = 'Customer#000000042'")
def exact_match(spark, sf_dir):
    return _t(spark, sf_dir, "customer").where(F.col("c_name") == "Customer#000000042")


@query("SELECT * FROM customer WHERE c_acctbal BETWEEN 100 AND 200")
def range_narrow(spark, sf_dir):
    return _t(spark, sf_dir, "customer").where(F.col("c_acctbal").between(100, 200))


@query("SELECT * FROM customer WHERE c_acctbal BETWEEN 100 AND 1000")
def range_wide(spark, sf_dir):
    return _t(spark, sf_dir, "customer").where(F.col("c_acctbal").between(100, 1000))


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%the%'")
def contains_ci(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(F.col("text").ilike("%the%")).select("doc_id", "source")


def _mark(spark, sf_dir, table) -> str:
    """A name for the state of a table's files: their paths, lengths and times of change."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/{table}.parquet").select("path", "length", "modificationTime")
    return str(files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))).first()[0])


def _text_index(spark, sf_dir, table, key, column) -> TrigramIndex:
    """The stored postings of a table's column, below the shared folder. The first query over some files writes them, all later ones, of other applications too, find them there."""
    index = TrigramIndex(spark, f"{shared(spark)}/trigrams/{table}.{column}.{_mark(spark, sf_dir, table)}")
    index.add("all", _t(spark, sf_dir, table), key, column)
    return index


@query("SELECT doc_id FROM documents WHERE text ILIKE '%license%'")
def contains_trigram(spark, sf_dir):
    return _text_index(spark, sf_dir, "documents", "doc_id", "text").search(_t(spark, sf_dir, "documents"), "doc_id", "text", "license").select("doc_id")


@query("SELECT page_id, url FROM pages WHERE url ILIKE '%casino%'")
def contains_trigram_url(spark, sf_dir):
    return _text_index(spark, sf_dir, "pages", "page_id", "url").search(_t(spark, sf_dir, "pages"), "page_id", "url", "Casino").select("page_id", "url")


@query("""
SELECT gram, count(*) AS n, sum(page_id)::BIGINT AS ids FROM (SELECT DISTINCT page_id, unnest(list_transform(range(1, length(url) - 1), lambda i: substring(lower(url), i, 3))) AS gram FROM pages) GROUP BY gram""")
def trigram_postings(spark, sf_dir):
    """The stored postings themselves: how many texts hold each gram, and the sum of their ids."""
    rows = _text_index(spark, sf_dir, "pages", "page_id", "url").postings()
    return rows.groupBy("gram").agg(F.sum("n").alias("n"), F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, i: s + i)).alias("ids"))


@query("SELECT doc_id, source FROM documents WHERE text LIKE 'The %'")
def prefix(spark, sf_dir):
    return search(_t(spark, sf_dir, "documents"), "text", "The ", "prefix").select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%.'")
def suffix_ci(spark, sf_dir):
    return search(_t(spark, sf_dir, "documents"), "text", ".", "suffix", ignore_case=True).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%'")
def contains_lower(spark, sf_dir):
    return search(_t(spark, sf_dir, "documents"), "text", "license", ignore_case=True).select("doc_id")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 1000 AND c_nationkey > 10 ORDER BY c_name ASC NULLS LAST")
def filter_sort(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").where((F.col("c_acctbal") < 1000) & (F.col("c_nationkey") > 10))
    return c.select("c_custkey", "c_name", "c_acctbal").orderBy(R.asc("c_name"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000 AND o_custkey BETWEEN 100 AND 300 ORDER BY o_orderkey")
def filter_sort_clustered(spark, sf_dir):
    """Two ranges over a copy that is clustered by both columns along a curve, made once for the files it is of."""
    path = f"{shared(spark)}/clustered/orders.{_mark(spark, sf_dir, 'orders')}"
    if not exists(spark, f"{path}/_SUCCESS"):
        clustered(_t(spark, sf_dir, "orders"), path, ["o_totalprice", "o_custkey"], 8, curve=True, row_group=256 << 10)
    rows = spark.read.parquet(path).where(within({"o_totalprice": (100000, 120000), "o_custkey": (100, 300)}))
    return rows.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice <= 50000 OR o_totalprice > 300000")
def disjoint_ranges(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where((F.col("o_totalprice") <= 50000) | (F.col("o_totalprice") > 300000)).select("o_orderkey")


# joins


_NO_LINES = "NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"


@query(f"""
SELECT o_orderkey, c_custkey, o_orderpriority, o_totalprice FROM (
  SELECT o.o_orderkey, c.c_custkey, o.o_orderpriority, o.o_totalprice,
         row_number() OVER (PARTITION BY o.o_orderpriority, c.c_nationkey ORDER BY c.c_acctbal DESC NULLS FIRST, o.o_orderkey) AS n
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE {_NO_LINES} AND lower(c.c_mktsegment) LIKE '%build%' AND lower(o.o_orderpriority) LIKE '%urgent%'
    AND (o.o_totalprice <= 100000 OR o.o_totalprice > 200000)) WHERE n = 1""")
def join_anti_distinct_on(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").where(F.lower("o_orderpriority").contains("urgent") & ((F.col("o_totalprice") <= 100000) | (F.col("o_totalprice") > 200000)))
    customers = _t(spark, sf_dir, "customer").where(F.lower("c_mktsegment").contains("build"))
    open_ = R.anti(orders.join(customers, orders.o_custkey == customers.c_custkey), _t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return R.distinct_on(open_, ["o_orderpriority", "c_nationkey"], [R.desc("c_acctbal"), "o_orderkey"]).select("o_orderkey", "c_custkey", "o_orderpriority", "o_totalprice")


@query(f"""
SELECT o_orderpriority, o_orderkey, c_acctbal FROM (
  SELECT o.o_orderpriority, o.o_orderkey, c.c_acctbal, row_number() OVER (PARTITION BY o.o_orderpriority ORDER BY c.c_acctbal DESC NULLS FIRST, o.o_orderkey) AS n
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE {_NO_LINES}) WHERE n = 1""")
def distinct_on(spark, sf_dir):
    orders, customers = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    open_ = R.anti(orders, _t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    joined = open_.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return R.distinct_on(joined, ["o_orderpriority"], [R.desc("c_acctbal"), "o_orderkey"]).select("o_orderpriority", "o_orderkey", "c_acctbal")


@query("""
SELECT d, b FROM (SELECT d, b, row_number() OVER (PARTITION BY d ORDER BY b DESC NULLS FIRST) AS n
FROM (SELECT c_nationkey AS d, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS b FROM customer)) WHERE n = 1""")
def distinct_on_null_first(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("d"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("b"))
    return R.distinct_on(rows, ["d"], [R.desc("b")])


@query("SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL")
def left_join_isnull(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").where("l_orderkey is null").select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders o WHERE {_NO_LINES}")
def anti_join(spark, sf_dir):
    return R.anti(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders o WHERE {_NO_LINES}")
def not_exists(spark, sf_dir):
    return spark.sql("SELECT o_orderkey FROM {o} o WHERE NOT EXISTS (SELECT 1 FROM {l} l WHERE l.l_orderkey = o.o_orderkey)", o=_t(spark, sf_dir, "orders"), l=_t(spark, sf_dir, "lineitem"))


@query("SELECT a.c_custkey AS a_key, b.c_custkey AS b_key FROM customer a JOIN customer b ON a.c_acctbal < b.c_acctbal AND b.c_acctbal < a.c_acctbal + 1")
def theta_join(spark, sf_dir):
    """A band join: values meet in buckets as wide as the band, so that only neighbours are compared."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return R.band_join(c, c, "c_acctbal", "c_acctbal", 0, 1).select(F.col("a.c_custkey").alias("a_key"), F.col("b.c_custkey").alias("b_key"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(substring(b.text, 1, 40)))")
def contains_join(spark, sf_dir):
    """Documents that hold the first 40 characters of an item."""
    docs, items = _t(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t")), _t(spark, sf_dir, "benchmark").select("item_id", F.lower(F.substring("text", 1, 40)).alias("b"))
    return R.contains_join(docs, items, "t", "b").select("doc_id", "item_id")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_nationkey = 3 AND b.n_nationkey = 7")
def cross_single_rows(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return n.where("n_nationkey = 3").select(F.col("n_name").alias("a_name")).crossJoin(n.where("n_nationkey = 7").select(F.col("n_name").alias("b_name")))


# aggregates, unions, orders


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")))
def table_counts(spark, sf_dir):
    return R.counts({t: _t(spark, sf_dir, t) for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")})


def _dangling_sql(where: str = "") -> str:
    return f"""
SELECT CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey < 5) THEN 1 ELSE 0 END) AS BIGINT) AS without_customer,
       CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) THEN 1 ELSE 0 END) AS BIGINT) AS without_lines,
       CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM labels d WHERE d.doc_id = o.o_orderkey) THEN 1 ELSE 0 END) AS BIGINT) AS without_label
FROM orders o {where}"""


def _dangling(spark, sf_dir, orders):
    some = _t(spark, sf_dir, "customer").where("c_nationkey < 5")
    return R.dangling(orders, {"without_customer": ("o_custkey", some, "c_custkey"), "without_lines": ("o_orderkey", _t(spark, sf_dir, "lineitem"), "l_orderkey"), "without_label": ("o_orderkey", _t(spark, sf_dir, "labels"), "doc_id")})


@query(_dangling_sql())
def orphan_counts(spark, sf_dir):
    return _dangling(spark, sf_dir, _t(spark, sf_dir, "orders"))


@query(_dangling_sql("WHERE false"))
def orphan_counts_empty(spark, sf_dir):
    return _dangling(spark, sf_dir, _t(spark, sf_dir, "orders").where("false"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber")
def group_all_columns(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal ASC NULLS LAST, s_suppkey LIMIT 1")
def top_1(spark, sf_dir):
    return R.top_k(_t(spark, sf_dir, "supplier"), [R.asc("s_acctbal"), R.asc("s_suppkey")]).select("s_suppkey", "s_acctbal")


@query("SELECT c_custkey, b FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer) ORDER BY b DESC NULLS FIRST, c_custkey LIMIT 50")
def sort_desc_nulls_first(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("b"))
    return R.top_k(rows, [R.desc("b"), R.asc("c_custkey")], 50)


@query("SELECT n_name FROM nation ORDER BY n_regionkey, n_name")
def sort_by_hidden_column(spark, sf_dir):
    return _t(spark, sf_dir, "nation").orderBy("n_regionkey", "n_name").select("n_name")


# merges


@query("SELECT c_custkey, c_name FROM customer")
def insert_ignore_rows(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return insert_ignore(c.where("c_custkey % 2 = 0"), c, ["c_custkey"], ["c_custkey"])


@query("SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang")
def insert_ignore_functional_key(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return insert_ignore(docs.limit(0), docs, ["source", "coalesce(nullif(lang, ''), source)"], ["doc_id"], [F.col("doc_id").asc()])


@query("""
SELECT min(event_id) AS event_id, i, s FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id END AS i, CASE WHEN user_id % 3 = 0 THEN event_type END AS s FROM events)
WHERE i IS NOT NULL GROUP BY i, s HAVING min(event_id) = (SELECT min(e.event_id) FROM events e WHERE e.user_id = i)
UNION ALL
SELECT min(event_id) AS event_id, NULL AS i, s FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id END AS i, CASE WHEN user_id % 3 = 0 THEN event_type END AS s FROM events)
WHERE i IS NULL AND s IS NOT NULL GROUP BY s""")
def insert_ignore_partial_key(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("i"), F.when(F.col("user_id") % 3 == 0, F.col("event_type")).alias("s")).where("i is not null or s is not null")
    key = "CASE WHEN i IS NOT NULL THEN concat('i:', i) WHEN s IS NOT NULL THEN concat('s:', lower(s)) END"
    return insert_ignore(e.limit(0), e, [key], ["event_id"], [F.col("event_id").asc()])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN greatest(c_acctbal, c_acctbal + (c_custkey % 5) - 2) ELSE c_acctbal + (c_custkey % 5) - 2 END AS c_acctbal, c_name FROM customer")
def upsert_greatest_rows(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name")
    return upsert_greatest(c.where("c_custkey % 2 = 0"), c.withColumn("c_acctbal", F.col("c_acctbal") + F.col("c_custkey") % 5 - 2), "c_custkey", ["c_acctbal"])


@query("SELECT c_custkey, c_name FROM customer")
def idempotent_twice(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    once = insert_ignore(c.where("c_custkey % 2 = 0"), c, ["c_custkey"], ["c_custkey"])
    return insert_ignore(once, c.union(c), ["c_custkey"], ["c_custkey"])


@query("SELECT 'CUSTOMER' AS kind, c_custkey AS key FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'ORDER', o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey <> 3)")
def delete_cascade(spark, sf_dir):
    tables = {"customer": _t(spark, sf_dir, "customer"), "orders": _t(spark, sf_dir, "orders")}
    out = R.delete(tables, [("orders", "o_custkey", "customer", "c_custkey", "cascade")], "customer", F.col("c_nationkey") == 3)
    return out["customer"].select(F.lit("CUSTOMER").alias("kind"), F.col("c_custkey").alias("key")).union(out["orders"].select(F.lit("ORDER"), "o_orderkey"))


@query("SELECT o_orderkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def delete_set_null(spark, sf_dir):
    tables = {"customer": _t(spark, sf_dir, "customer"), "orders": _t(spark, sf_dir, "orders")}
    return R.delete(tables, [("orders", "o_custkey", "customer", "c_custkey", "set null")], "customer", F.col("c_nationkey") == 3)["orders"].select("o_orderkey", "o_custkey")


# scalar functions and flattening


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_json(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", S.to_long(F.from_json("props", "k STRING")["k"]).alias("k"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def explode_links(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def strip_tag(spark, sf_dir):
    title = F.regexp_extract("html", "<title>[^<]*</title>", 0)
    return _t(spark, sf_dir, "pages").select("page_id", S.clean_source(title).alias("title"))


_STEP = "list_reduce(list_concat([xor(c, b)], [1, 1, 1, 1, 1, 1, 1, 1]), lambda x, one: xor(x >> one, 3988292384 * (x & one)))"


@query(f"""
SELECT n_name, CAST(xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(n_name) + 1), lambda i: CAST(ord(substring(lower(n_name), i, 1)) AS BIGINT))),
       lambda c, b: {_STEP}), 4294967295) AS BIGINT) AS hashtag_id FROM nation""")
def hashtag_id(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_name", S.hashtag_id(F.col("n_name")).alias("hashtag_id"))


@query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS back, CAST(o_orderdate AS TIMESTAMP) AS iso_back FROM orders")
def ts_legacy(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    legacy = F.concat(F.lit("Mon "), F.date_format(at, "MMM dd HH:mm:ss"), F.lit(" +0200 "), F.date_format(at, "yyyy"))
    iso = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", S.timestamp(legacy).alias("back"), S.timestamp(iso).alias("iso_back"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), p_type) AS label FROM part")
def coalesce_chain(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", S.first_filled(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")), F.col("p_type")).alias("label"))


@query("SELECT r_regionkey, r_name FROM region")
def nul_strip(spark, sf_dir):
    return _t(spark, sf_dir, "region").select("r_regionkey", S.strip_nul(F.concat("r_name", F.char(F.lit(0)))).alias("r_name"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class FROM part")
def case_when(spark, sf_dir):
    size = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", F.when(size < 10, "small").when(size < 30, "middle").otherwise("large").alias("size_class"))


@query("SELECT p_partkey, greatest(p_size, CASE WHEN p_size > 25 THEN NULL ELSE 20 END) AS most FROM part")
def greatest(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.greatest("p_size", F.when(F.col("p_size") <= 25, 20)).alias("most"))


@query("SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(38,10)) / 8, 2) AS DOUBLE) AS price FROM part")
def round_half_up(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", S.round_half_up(F.col("p_retailprice").cast("decimal(30,10)") / 8, 2).cast("double").alias("price"))


@query("SELECT r_name, array_to_string(list_sort(list_distinct(list_transform(range(1, length(r_name) - 1), lambda i: substring(lower(r_name), i, 3)))), ',') AS grams FROM region")
def trigram_decomposition(spark, sf_dir):
    return _t(spark, sf_dir, "region").select("r_name", F.array_join(F.array_sort(S.trigrams(F.lower("r_name"))), ",").alias("grams"))


# geometry: axis-parallel rectangles from table columns, so that plain arithmetic gives the same


def _boxes(spark, sf_dir):
    """A rectangle for each nation: lower left corner (10 n, 5 r), width 4 + n % 3, height 3 + n % 2."""
    n = _t(spark, sf_dir, "nation")
    x0, y0 = F.col("n_nationkey") * 10, F.col("n_regionkey") * 5
    x1, y1 = x0 + 4 + F.col("n_nationkey") % 3, y0 + 3 + F.col("n_nationkey") % 2
    pair = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    wkt = F.concat(F.lit("POLYGON(("), F.concat_ws(",", pair(x0, y0), pair(x1, y0), pair(x1, y1), pair(x0, y1), pair(x0, y0)), F.lit("))"))
    return n.select("n_nationkey", "n_name", wkt.alias("wkt")).transform(G.parsed_wkt, "wkt", 5514)


_BOX = "SELECT n_nationkey, n_name, n_nationkey * 10 AS x0, n_regionkey * 5 AS y0, n_nationkey * 10 + 4 + n_nationkey % 3 AS x1, n_regionkey * 5 + 3 + n_nationkey % 2 AS y1 FROM nation"


@query(f"SELECT n_nationkey, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM ({_BOX})")
def polygon_area(spark, sf_dir):
    return _boxes(spark, sf_dir).select("n_nationkey", F.round(G.area(F.col("way")), 6).alias("area"))


@query(f"SELECT n_nationkey, CAST(x0 + x1 AS DOUBLE) / 2 AS cx, CAST(y0 + y1 AS DOUBLE) / 2 AS cy FROM ({_BOX})")
def polygon_centroid(spark, sf_dir):
    c = G.centroid(F.col("way"))
    return _boxes(spark, sf_dir).select("n_nationkey", F.round(G.x(c), 6).alias("cx"), F.round(G.y(c), 6).alias("cy"))


@query(f"SELECT n_nationkey, CAST(2 * ((x1 - x0) + (y1 - y0)) AS DOUBLE) AS perimeter FROM ({_BOX})")
def polygon_length(spark, sf_dir):
    return _boxes(spark, sf_dir).select("n_nationkey", F.round(G.length(F.col("way")), 6).alias("perimeter"))


@query(f"SELECT n_nationkey, 'POLYGON((' || x0 || ' ' || y0 || ',' || x1 || ' ' || y0 || ',' || x1 || ' ' || y1 || ',' || x0 || ' ' || y1 || ',' || x0 || ' ' || y0 || '))' AS wkt FROM ({_BOX})")
def wkt_roundtrip(spark, sf_dir):
    return _boxes(spark, sf_dir).select("n_nationkey", G.as_wkt(F.col("way")).alias("wkt"))


@query("SELECT s_suppkey, round(sqrt((s_acctbal / 100 - 10) * (s_acctbal / 100 - 10) + (s_nationkey - 5.0) * (s_nationkey - 5.0)), 6) AS distance FROM supplier")
def distance_planar(spark, sf_dir):
    a, b = G.point(F.col("s_acctbal") / 100, F.col("s_nationkey"), 5514), G.point(F.lit(10), F.lit(5), 5514)
    return _t(spark, sf_dir, "supplier").select("s_suppkey", F.round(G.distance(a, b), 6).alias("distance"))


@query(f"""
WITH p AS (SELECT c_custkey, c_custkey % 250 + 0.5 AS px, (c_custkey * 7) % 25 + 0.5 AS py FROM customer)
SELECT n_nationkey, c_custkey FROM ({_BOX}) b JOIN p ON px > x0 AND px < x1 AND py > y0 AND py < y1""")
def pip_join(spark, sf_dir):
    points = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 250 + 0.5).alias("px"), ((F.col("c_custkey") * 7) % 25 + 0.5).alias("py"))
    return J.contains_join(_boxes(spark, sf_dir), points, 5.0).select("n_nationkey", "c_custkey")


@query(f"SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM ({_BOX}) a, ({_BOX}) b WHERE a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 UNION ALL SELECT n_nationkey, -1 FROM ({_BOX}) WHERE x0 <= 20 AND x1 >= 21 AND y0 <= 6 AND y1 >= 7")
def polygon_contains(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).select("n_nationkey", "way")
    inner = boxes.select(F.col("n_nationkey").alias("b_key"), F.col("way").alias("inner"))
    pairs = J.contains_polygons(boxes, inner, 8.0, "way", "inner").select(F.col("n_nationkey").alias("a_key"), "b_key")
    small = G.from_wkt(F.lit("POLYGON((20 6,21 6,21 7,20 7,20 6))"), 5514)
    return pairs.union(boxes.where(G.contains(F.col("way"), small)).select("n_nationkey", F.lit(-1)))


@query(f"""
WITH p AS (SELECT s_suppkey, s_suppkey % 250 AS px, (s_suppkey * 7) % 25 AS py FROM supplier)
SELECT n_nationkey, s_suppkey, px > x0 AND px < x1 AND py > y0 AND py < y1 AS inside FROM ({_BOX}) JOIN p ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1""")
def published_point_in_polygon(spark, sf_dir):
    """Points in a polygon or on its border, where many land: on the border is not inside."""
    px, py = F.col("s_suppkey") % 250, (F.col("s_suppkey") * 7) % 25
    points = _t(spark, sf_dir, "supplier").select("s_suppkey", G.point(px, py, 5514).alias("p"))
    pairs = J.overlapping(_boxes(spark, sf_dir).select("n_nationkey", "way"), points, "way", "p", 8.0)
    return pairs.select("l.n_nationkey", "r.s_suppkey", G.contains(F.col("l.way"), F.col("r.p")).alias("inside"))


@query(f"SELECT n_nationkey, (x1 - x0) * (y1 - y0) AS area FROM ({_BOX}) ORDER BY 2, 1 LIMIT 1")
def smallest_polygon(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).select("n_nationkey", G.area(F.col("way")).cast("int").alias("area"))
    return R.top_k(boxes, [R.asc("area"), R.asc("n_nationkey")])


@query(f"SELECT n_nationkey FROM ({_BOX}) WHERE y0 <= 7 AND y1 >= 7")
def border_crossed(spark, sf_dir):
    line = G.from_wkt(F.lit("LINESTRING(-1 7,1000 7)"), 5514)
    return _boxes(spark, sf_dir).where(G.borders_meet(F.col("way"), line)).select("n_nationkey")


@query(f"SELECT n_nationkey FROM ({_BOX}) WHERE x1 - x0 <= 5")
def near_border(spark, sf_dir):
    """Rectangles whose own left edge, taken as a thin polygon, has all of them within 5."""
    b = G.bounds(F.col("way"))
    strip = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((b.x0, b.y0), (b.x0, b.y1))])
    left = F.struct(F.lit("POLYGON").alias("kind"), F.lit(5514).alias("srid"), F.array(F.array(strip)).alias("parts"))
    return _boxes(spark, sf_dir).where(G.near_border(F.col("way"), left, 5.0)).select("n_nationkey")


@query(f"SELECT n_nationkey, '{{\"type\":\"Feature\",\"properties\":{{\"name\":\"' || n_name || '\"}},\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || CAST(x0 AS DOUBLE) || ',' || CAST(y0 AS DOUBLE) || ']}}}}' AS feature FROM ({_BOX})")
def geojson_export(spark, sf_dir):
    g = G.point(F.get(F.get(F.get(F.col("way.parts"), F.lit(0)), F.lit(0)), F.lit(0)).x, F.get(F.get(F.get(F.col("way.parts"), F.lit(0)), F.lit(0)), F.lit(0)).y, 4326)
    return _boxes(spark, sf_dir).select("n_nationkey", G.geojson(g, F.struct(F.col("n_name").alias("name"))).alias("feature"))


from . import archive_queries, spatial_queries  # noqa: E402, F401  they add their queries
