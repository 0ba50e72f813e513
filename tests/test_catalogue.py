"""Every registered query with SQL against DuckDB on the smallest tables, and the driver's entry."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans.catalogue import QUERIES, SQL
from quillon.plans.layout import pushed_filters

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df, result = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "c_custkey", "o_orderpriority", "o_totalprice"]
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    assert any("EqualTo(c_name" in f for f in pushed_filters(QUERIES["exact_match"](spark, SF)))
    assert any("StringStartsWith(text" in f for f in pushed_filters(QUERIES["prefix"](spark, SF)))


def test_trigrams_of_whole_texts(spark, duck):
    df = QUERIES["contains_trigram"](spark, SF)
    assert df.columns == ["doc_id"] and any(f.endswith("documents.parquet") for f in df.inputFiles())
    found = duck.sql("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')").fetchall()
    assert found and sorted(r.doc_id for r in df.collect()) == sorted(x for (x,) in found)
