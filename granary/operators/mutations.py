"""INSERT, UPDATE, DELETE and ALTER as functions from one immutable version of a table to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.tables import INT_MAX, capacities, whole_numbers


class KeyError_(ValueError):
    """A primary key is missing or there already."""


class ValueTooLarge(ValueError):
    """A text is over its column's capacity in bytes, or a number out of its column's range."""


def check_value(df: DataFrame, name: str, value: object) -> None:
    """Refuse a value that the column's declaration has no room for; null always fits."""
    if isinstance(value, str) and name in capacities(df) and len(value.encode()) > capacities(df)[name]:
        raise ValueTooLarge(f"{name}: {len(value.encode())} bytes, capacity {capacities(df)[name]}")
    if isinstance(value, int) and name in whole_numbers(df) and not 0 <= value <= INT_MAX:
        raise ValueTooLarge(f"{name}: {value} is not from 0 to {INT_MAX}")


def insert_row(df: DataFrame, key: str, row: dict[str, object]) -> DataFrame:
    """Append a row; a duplicate key is refused, a key of None or 0 becomes the largest one plus 1.

    Values have to fit what `tables.declared` says of their columns.
    """
    for name, value in row.items():
        check_value(df, name, value)
    new = df.sparkSession.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema if f.name != key])
    if row.get(key):
        if not df.filter(F.col(key) == row[key]).isEmpty():
            raise KeyError_(f"key {row[key]} exists")
        new = new.withColumn(key, F.lit(row[key]))
    else:
        new = new.join(F.broadcast(df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias(key))), how="cross")
    return df.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in df.schema]))


def update_where(df: DataFrame, where: Column, values: dict[str, Column], key: str) -> DataFrame:
    """Set columns on the matching rows; all of `values` see the old row and the key can't be set.

    Where a set column is declared with a capacity or a range, the matching rows are checked first.
    """
    if key in values:
        raise KeyError_("the key can't be assigned")
    hit = F.coalesce(where, F.lit(False))
    large = [F.octet_length(values[c].cast("string")) > n for c, n in capacities(df).items() if c in values]
    large += [(values[c] < 0) | (values[c] > INT_MAX) for c in whole_numbers(df) if c in values]
    for test in large:
        if not df.filter(hit & test).isEmpty():
            raise ValueTooLarge(f"a value is too large for {sorted(values)}")
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c, metadata=df.schema[c].metadata) if c in values else F.col(c) for c in df.columns])


def update_by_key(df: DataFrame, key: str, value: object, values: dict[str, Column]) -> DataFrame:
    """`update_where` on the row of one key, which has to exist."""
    require_key(df, key, value)
    return update_where(df, F.col(key) == value, values, key)


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    """Drop matching rows; rows for which the predicate is null stay."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def delete_by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """Drop the row of one key, which has to exist."""
    require_key(df, key, value)
    return delete_where(df, F.col(key) == value)


def require_key(df: DataFrame, key: str, value: object) -> None:
    """Raise if no row has this key: what UPDATE and DELETE by key do."""
    if df.filter(F.col(key) == value).isEmpty():
        raise KeyError_(f"key {value} not found")


def cascade_delete(child: DataFrame, child_key: str, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is not among the deleted ones."""
    return child.join(deleted.select(F.col(key).alias("_gone")), child[child_key] == F.col("_gone"), "left_anti")


def add_column(df: DataFrame, name: str, sql_type: str) -> DataFrame:
    """A new last column: 0 for numbers, '' for texts."""
    return df.withColumn(name, F.lit("" if sql_type == "string" else 0).cast(sql_type))


def integrity_report(df: DataFrame, key: str, capacities: dict[str, int] | None = None, int_columns: tuple[str, ...] = ()) -> DataFrame:
    """One row for each check and the number of rows or keys that break it, in one pass over the rows and one over the keys."""
    checks = {f"null {key}": F.col(key).isNull()}
    checks |= {f"capacity {c}": F.octet_length(c) > n for c, n in (capacities or {}).items()}
    checks |= {f"range {c}": (F.col(c) < 0) | (F.col(c) > INT_MAX) for c in int_columns}
    sums = df.agg(*[F.count_if(p).alias(n) for n, p in checks.items()])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("n_bad")) for n in checks])).alias("r")).select("r.*")
    twice = df.groupBy(key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(f"duplicate {key}").alias("check_name"), "n_bad")
    return rows.union(twice)
