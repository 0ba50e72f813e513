"""Joins, duplicates and orders, with the null semantics stated in each name or argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of left without a partner."""
    return left.join(right, on, "left_anti")


def exists(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of left with a partner."""
    return left.join(right, on, "left_semi")


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, low: float, high: float) -> DataFrame:
    """Pairs (as "a" and "b") with low < b - a < high, both ends open.

    Values fall into buckets as wide as the band, and each left row meets the buckets that the band can reach: an equi-join, with at most three rows for each left one. NULLs have no partner.
    """
    width = high - low
    dealt = left.alias("a").withColumn("_bucket", F.explode(F.sequence(F.floor((F.col(f"a.{a}") + low) / width), F.floor((F.col(f"a.{a}") + high) / width))))
    placed = right.alias("b").withColumn("_bucket", F.floor(F.col(f"b.{b}") / width))
    joined = dealt.join(placed, "_bucket")
    return joined.where((F.col(f"b.{b}") > F.col(f"a.{a}") + low) & (F.col(f"b.{b}") < F.col(f"a.{a}") + high)).drop("_bucket")


def contains_join(left: DataFrame, right: DataFrame, text: str, part: str) -> DataFrame:
    """Pairs where a left text holds a right part. NULLs have no partner; left and right have no column in common.

    A text that holds a part has each word inside it, between blanks, as a word of its own. So parts meet the texts by the longest of their inner words, in an equi-join on one row for each
    different word of a text, which carries a hash of the text and not the text; only texts of such pairs are fetched, and then is the whole part looked for. Parts without an inner word are looked for in all texts.
    """
    pieces = F.split(F.col(part), " ", -1)
    inner = F.when(F.size(pieces) > 2, F.array_max(F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 2), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))))
    parts = right.withColumn("_inner", inner["w"])
    asked = parts.where(F.col("_inner").isNotNull())
    words = left.select(F.xxhash64(text).alias("_hash"), F.explode(F.array_distinct(F.split(F.col(text), " ", -1))).alias("_word"))
    words = words.join(asked.select(F.col("_inner").alias("_word")).distinct(), "_word", "left_semi").distinct()  # equal texts are one
    found = words.join(asked, F.col("_word") == F.col("_inner")).drop("_word").withColumnRenamed("_hash", "_of")
    met = left.join(found, F.xxhash64(text) == F.col("_of")).where(F.col(text).contains(F.col(part))).drop("_of")
    return met.union(left.join(parts.where(F.col("_inner").isNull()), F.col(text).contains(F.col(part))).select(*met.columns)).drop("_inner")


def with_existence(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str) -> DataFrame:
    """left with a flag: whether a non-null left_key is among the right keys. Each left row stays one row."""
    ids = right.select(F.col(right_key).alias("_key")).where("_key is not null").distinct().withColumn(name, F.lit(True))
    return left.join(ids, F.col(left_key) == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(False)))


def asc(c: str | Column) -> Column:
    """Ascending, nulls last."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    """Descending, nulls first."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def distinct_on(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order; a null in the order counts, unlike for max()."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def top_k(df: DataFrame, order: list, k: int = 1) -> DataFrame:
    return df.orderBy(*order).limit(k)


def collated(c: str | Column, locale: str = "sk") -> Column:
    """A sort key in a language's order."""
    return F.collate(F.col(c) if isinstance(c, str) else c, locale)


def counts(tables: dict[str, DataFrame], name: str = "table_name", value: str = "row_count") -> DataFrame:
    """One row for each table with its number of rows."""
    out = None
    for key, df in tables.items():
        row = df.agg(F.count("*").alias(value)).select(F.lit(key).alias(name), value)
        out = row if out is None else out.unionByName(row)
    return out


def dangling(df: DataFrame, references: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """One row: for each name (column, referenced table, its column) the rows whose non-null column has no partner; NULL if df is empty.

    One join with distinct keys for each reference, then a single aggregate.
    """
    out, sums = df, []
    for name, (column, table, key) in references.items():
        out = with_existence(out, table, column, key, f"_{name}")
        sums.append(F.sum(F.when(F.col(column).isNotNull() & ~F.col(f"_{name}"), 1).otherwise(0)).alias(name))
    return out.agg(*sums)


def delete(tables: dict[str, DataFrame], references: list[tuple], table: str, condition: Column) -> dict[str, DataFrame]:
    """All tables without the rows of `table` that match; referencing rows go too or lose their reference, as each reference says."""
    out = dict(tables)
    gone = tables[table].where(condition)
    out[table] = tables[table].where(~F.coalesce(condition, F.lit(False)))
    for child, column, parent, key, action in references:
        if parent == table:
            ids = gone.select(F.col(key).alias("_gone")).where("_gone is not null").distinct()
            if action == "cascade":
                out[child] = anti(out[child], ids, F.col(column) == F.col("_gone"))
            else:
                joined = out[child].join(ids, F.col(column) == F.col("_gone"), "left")
                out[child] = joined.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")
    return out
