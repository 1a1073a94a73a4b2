"""Joins, set operations, ordering, aggregation and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on keys; Catalyst picks broadcast or sort-merge from the sizes it sees."""
    return left.join(right, left[left_key] == right[right_key], "inner")


def members(df: DataFrame, key: str, sub: DataFrame, sub_key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is (or with keep=False is not) in a subquery's column, with SQL's rules for nulls.

    NOT IN over a column with a null has no rows, over an empty one has all, and else none with a null key.
    """
    keys = sub.select(F.col(sub_key).alias("_sub_key"))
    if keep:
        return df.join(keys, df[key] == F.col("_sub_key"), "left_semi")
    # One row; the anti-join itself needs no broadcast of the subquery.
    state = keys.agg(F.count(F.lit(1)).alias("_n_sub"), F.count_if(F.col("_sub_key").isNull()).alias("_n_null"))
    out = df.join(keys, df[key] == F.col("_sub_key"), "left_anti").join(F.broadcast(state), how="cross")
    return out.filter((F.col("_n_sub") == 0) | ((F.col("_n_null") == 0) & F.col(key).isNotNull())).drop("_n_sub", "_n_null")


def if_exists(df: DataFrame, sub: DataFrame) -> DataFrame:
    """All rows if the subquery has a row, else none. The joined side is one row."""
    one = sub.limit(1).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0").select(F.lit(True).alias("_any"))
    return df.join(F.broadcast(one), how="left_semi")


def with_scalar(df: DataFrame, sub: DataFrame, name: str) -> DataFrame:
    """Add the value of a subquery of one aggregated row and column as a column."""
    one = sub.select(F.col(sub.columns[0]).alias(name))
    return df.join(F.broadcast(one), how="cross")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def ordered(df: DataFrame, keys: list[tuple[str, bool]], tie: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sort by (column, descending) keys, ties by the unique key.

    With a limit this is one top-k operator; an offset alone goes by global row numbers, not through one task.
    """
    by = [*keys, (tie, False)]
    sort = [F.desc(k) if down else F.asc(k) for k, down in by]
    if limit is None:
        return (global_row_numbers(df, by, "_place").filter(F.col("_place") > offset).drop("_place") if offset else df).orderBy(*sort)
    return df.orderBy(*sort).offset(offset).limit(limit) if offset else df.orderBy(*sort).limit(limit)


def grouped(df: DataFrame, keys: list[str], aggs: dict[str, Column], having: Column | None = None) -> DataFrame:
    """GROUP BY with named aggregates, partial before the shuffle, and HAVING."""
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out if having is None else out.filter(having)


def row_numbers(df: DataFrame, part: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """ROW_NUMBER within partitions; `order` has to end in a unique key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long"))


Order = list[str] | list[tuple[str, bool]]
#: Most ranges of a running sum, and sampled rows for each bound between two. A range's rows are sorted, which spills.
MOST_RANGES, PER_BOUND = 2000, 50


def pairs(order: Order) -> list[tuple[str, bool]]:
    return [(k, False) if isinstance(k, str) else k for k in order]


def before(order: list[tuple[str, bool]], bound: dict) -> Column:
    """The row stands before `bound` in this order; nulls first, or last where descending."""
    same, out = F.lit(True), F.lit(False)
    for k, down in order:
        # As structs, so that nulls compare too.
        mine, other = F.struct(F.col(k).alias("x")), F.struct(F.lit(bound[k]).alias("x"))
        out = out | (same & ((mine > other) if down else (mine < other)))
        same = same & F.col(k).eqNullSafe(F.lit(bound[k]))
    return out


def in_ranges(df: DataFrame, order: Order, parts: int | None = None, name: str = "_part") -> DataFrame:
    """`df` with the number of the range that a row falls into, ranges being in the order of `order` (unique).

    The bounds are taken once, from rows picked by a hash, and are constants in the plan: however often the plan is run
    or used, a row has the same range. `parts` is by default that of the session's shuffles.
    """
    by, spark = pairs(order), df.sparkSession
    parts = min(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    cols = [k for k, _ in by]
    picked = df.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(parts * PER_BOUND)
    # At most parts * PER_BOUND rows, in the session's own order.
    found = [r.asDict() for r in picked.orderBy(*[F.desc(k) if down else F.asc(k) for k, down in by]).collect()]
    bounds = [found[len(found) * i // parts] for i in range(1, parts)] if found else []
    bounds = [b for i, b in enumerate(bounds) if not i or b != bounds[i - 1]]

    def number(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(before(by, bounds[mid]), number(lo, mid)).otherwise(number(mid + 1, hi))

    return df.withColumn(name, number(0, len(bounds)))


def sorted_by(order: Order) -> list[Column]:
    return [F.desc(k) if down else F.asc(k) for k, down in pairs(order)]


def running_total(df: DataFrame, order: Order, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Running sum over the whole table in the order of `order` (unique), without a single-task window.

    Each range sums alone and gets the total of the ranges before it, one row a range.
    """
    ranged = in_ranges(df.withColumn("_v", value.cast("long")), order, parts)
    sums = ranged.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    earlier = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = ranged.withColumn("_run", F.sum("_v").over(Window.partitionBy("_part").orderBy(*sorted_by(order)).rowsBetween(Window.unboundedPreceding, 0)))
    # One row for each range: at most MOST_RANGES.
    return within.join(F.broadcast(earlier), "_part").withColumn(name, F.col("_run") + F.col("_before")).drop("_part", "_v", "_run", "_before")


def global_row_numbers(df: DataFrame, order: Order, name: str = "rn", parts: int | None = None) -> DataFrame:
    """ROW_NUMBER over the whole table, in parallel."""
    return running_total(df, order, F.lit(1), name, parts)


def run_numbers(df: DataFrame, order: str, key: str, name: str = "rn", parts: int | None = None) -> DataFrame:
    """Numbers that restart whenever `key` changes from one row to the next in the order of the unique `order`.

    A row's number is its place less that of the last change. Both are known within a range; from the ranges before it
    come the number of their rows, the last one's key and the last change, one row a range.
    """
    ranged, w = in_ranges(df, [order], parts), Window.partitionBy("_part").orderBy(order)
    over = Window.orderBy("_part")
    ends = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(F.col(key).alias("k")), order).alias("_last"))
    ends = ends.select("_part", (F.sum("_n").over(over) - F.col("_n")).alias("_rows"), F.lag("_last").over(over).alias("_left"))
    own = F.struct(F.col(key).alias("k"))
    rows = ranged.withColumns({"_i": F.row_number().over(w), "_was": F.lag(own).over(w)}).join(F.broadcast(ends), "_part")
    at = F.col("_rows") + F.col("_i")
    marked = rows.withColumn("_start", F.when(~F.coalesce("_was", "_left").eqNullSafe(own), at))
    starts = marked.groupBy("_part").agg(F.max("_start").alias("_s")).select("_part", F.max("_s").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    latest = F.coalesce(F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_carried")
    out = marked.join(F.broadcast(starts), "_part").withColumn("_from", latest)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (at - F.col("_from") + 1).cast("long").alias(name))
