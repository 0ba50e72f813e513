"""The queries that SQL can express, against DuckDB on the driver's tables and on small odd ones."""

import os

import duckdb
import pytest

from quillon.llm.queries import QUERIES, SQL

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def same(spark, folder, name):
    df, c = QUERIES[name](spark, folder), duckdb.connect()
    for table in ("documents", "embeddings"):
        if os.path.exists(f"{folder}/{table}.parquet"):
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{table}.parquet') else ''}')")
    result = c.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    at = [result.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name, folder):
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    same(spark, folder, name)


@pytest.mark.parametrize("name", [n for n in sorted(SQL) if n != "op8_exact_topk"])
def test_same_rows_of_odd_texts(spark, rows, name, tmp_path):
    """Nulls, empty texts, copies, near copies and letters of several bytes; ids are made unique, as SQL tells documents by them."""
    frame = spark.createDataFrame([(i, r[1], "en", "s", 0) for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, str(tmp_path), name)
