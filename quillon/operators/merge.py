"""Insert-if-absent and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumns({f"_k{i}": F.expr(k) for i, k in enumerate(keys)})


def new_rows(target: DataFrame | None, staged: DataFrame, keys: list[str], required: list[str] = (), order: list[Column] | None = None, nulls_distinct: bool = False) -> DataFrame:
    """The staged rows that insert_ignore() adds.

    keys: SQL expressions over the columns. Rows with a NULL in `required` are dropped, then one row for each key is kept: the first by `order`, or by all columns
    where order is not given or leaves a tie. nulls_distinct: a NULL key conflicts with nothing, as in a SQL unique index; otherwise NULLs are equal to each other.
    """
    rows = staged
    for c in required:
        rows = rows.where(F.col(c).isNotNull())
    columns = staged.columns
    # without an order of its own all columns decide, and equal rows collapse before the window; a given order may use columns that target lacks
    if order is None:
        rows = rows.distinct()
    names = [f"_k{i}" for i in range(len(keys))]
    rows = _keyed(rows, keys)
    by = Window.partitionBy(*names).orderBy(*(order or []), *[F.col(f"`{c}`").asc_nulls_last() for c in columns if _orderable(staged, c)])
    any_null = F.lit(False)
    for n in names:
        any_null = any_null | F.col(n).isNull()
    rows = rows.withColumn("_n", F.row_number().over(by))
    rows = rows.where((F.col("_n") == 1) | any_null) if nulls_distinct else rows.where(F.col("_n") == 1)
    if target is not None:
        old = _keyed(target, keys).select(*[F.col(n).alias(f"_t{n}") for n in names])
        same = F.lit(True)
        for n in names:
            same = same & (F.col(n) == F.col(f"_t{n}") if nulls_distinct else F.col(n).eqNullSafe(F.col(f"_t{n}")))
        rows = rows.join(old, same, "left_anti")
    return rows.select(*[F.col(f"`{c}`") for c in columns])


def append_rows(target: DataFrame, rows: list[dict]) -> DataFrame:
    """target and some rows of values; columns that a row does not name are NULL, and values are cast to the target's types."""
    names = [c for c in target.columns if any(c in r for r in rows)]
    added = target.sparkSession.createDataFrame([tuple(r.get(c) for c in names) for r in rows], target.select(*names).schema)
    return target.unionByName(added, allowMissingColumns=True)


def stamped(df: DataFrame, column: str = "created_at") -> DataFrame:
    """df with the time of the load in a column."""
    return df.withColumn(column, F.current_timestamp().cast("timestamp_ntz"))


def _orderable(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() not in ("map", "variant")


def insert_ignore(target: DataFrame, staged: DataFrame, keys: list[str], required: list[str] = (), order: list[Column] | None = None, nulls_distinct: bool = False) -> DataFrame:
    """target and the staged rows whose key it lacks; stored rows win. Running it again changes nothing, unless nulls_distinct lets NULL keys in each time."""
    fresh = new_rows(target, staged, keys, required, order, nulls_distinct)
    return target.unionByName(fresh.select(*target.columns))


def upsert_greatest(target: DataFrame, staged: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Both sides by key: counters take the largest value, NULLs aside, of all staged rows of the key too; other columns keep the stored value if the row was there."""
    same = Window.partitionBy(F.col(key))
    one = new_rows(None, staged.withColumns({c: F.max(c).over(same) for c in counters}), [key], [key])
    t, s = target.alias("t"), one.alias("s")
    joined = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    stored = F.col(f"t.{key}").isNotNull()
    pick = lambda c: F.greatest(f"t.{c}", f"s.{c}") if c in counters else F.when(stored, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
    return joined.select(*[pick(c).alias(c) for c in target.columns])
