"""Column profiles: most common values, equi-depth samples, pair counts, and the rows these let one expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import running_total

#: The sizes of the profiles.
COMMON_VALUES, SAMPLES, COMMON_PAIRS = 16, 33, 32
#: Fixed values of the report on an index lookup against a scan: costs of a scanned and a looked-up row, and the least rows.
SCAN_ROW, LOOKUP_ROW, SCAN_FROM_ROWS = 3, 5, 32


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("freq"))


def common_values(df: DataFrame, c: str, n: int = COMMON_VALUES) -> DataFrame:
    """The n most frequent values, ties to the smaller, with the number of rows of smaller values."""
    freq = value_counts(df, c)
    top = freq.orderBy(F.desc("freq"), "value").limit(n)
    # `top` has n rows at most; each is met by every distinct value, and the sums are partial before the shuffle.
    less = freq.select(F.col("value").alias("_v"), F.col("freq").alias("_f"))
    return less.join(F.broadcast(top), F.col("_v") <= F.col("value")).groupBy("value", "freq").agg(F.sum(F.when(F.col("_v") < F.col("value"), F.col("_f")).otherwise(0)).alias("rows_before"))


def depth_samples(df: DataFrame, c: str, n: int = SAMPLES, parts: int | None = None) -> DataFrame:
    """(i, rank, value): n values at equal distances in the sorted column, found from the running sum of value counts."""
    freq = running_total(value_counts(df, c), ["value"], F.col("freq"), "upto", parts)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    ranks = total.select("total", F.least(F.lit(n).cast("long"), F.col("total")).alias("s")).filter("s > 0").select("total", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("i"))
    ranks = ranks.select("i", F.when(F.col("s") == 1, 0).otherwise(F.expr("i * (total - 1) div greatest(s - 1, 1)")).cast("long").alias("rank"))
    # `ranks` has n rows.
    hit = (F.col("rank") >= F.col("upto") - F.col("freq")) & (F.col("rank") < F.col("upto"))
    return freq.join(F.broadcast(ranks), hit).select("i", "rank", "value")


def common_pairs(df: DataFrame, a: str, b: str, n: int = COMMON_PAIRS) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "a", "b").limit(n)


def equality_estimates(df: DataFrame, c: str, wanted: DataFrame) -> DataFrame:
    """For each `value` of `wanted`: rows expected for c = value, and what looking them up would cost beside a scan.

    Outside the column's range 0, a common value its count, else the mean count of the rest, rounded up.
    """
    freq, top = value_counts(df, c), common_values(df, c).select("value", "freq")
    whole = freq.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("ndv"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    held = top.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("top_rows"), F.count(F.lit(1)).alias("top_n"))
    rest = F.when(F.col("ndv") > F.col("top_n"), F.ceil((F.col("total") - F.col("top_rows")) / F.nullif(F.col("ndv") - F.col("top_n"), F.lit(0)))).otherwise(0)
    out = wanted.join(F.broadcast(whole), how="cross").join(F.broadcast(held), how="cross").join(F.broadcast(top), "value", "left")
    est = F.when((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")), 0).otherwise(F.coalesce(F.col("freq"), rest)).cast("long")
    out = out.select("value", est.alias("est_rows"), (F.col("total") * SCAN_ROW).alias("scan_cost"), "total")
    cost = F.col("est_rows") * LOOKUP_ROW
    choice = F.when((F.col("total") >= SCAN_FROM_ROWS) & (cost > F.col("scan_cost")), "scan").otherwise("index")
    return out.select("value", "est_rows", cost.alias("index_cost"), "scan_cost", choice.alias("choice"))


def at_most_estimates(df: DataFrame, c: str, wanted: DataFrame) -> DataFrame:
    """For each distinct `value` of `wanted`: rows expected for c <= value, for a whole-number column.

    A common value is exact; else the rank is interpolated between the samples around it.
    """
    # The samples and the common values are SAMPLES and COMMON_VALUES rows.
    samples = depth_samples(df, c).select(F.struct("rank", F.col("value").alias("at")).alias("s"))
    top = common_values(df, c).select("value", (F.col("rows_before") + F.col("freq")).alias("exact"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    under = F.col("s.at") <= F.col("value")
    around = wanted.select("value").distinct().join(F.broadcast(samples), how="cross").groupBy("value").agg(F.max(F.when(under, F.col("s"))).alias("lo"), F.min(F.when(~under, F.col("s"))).alias("hi"))
    between = F.expr("lo.rank + (hi.rank - lo.rank) * (value - lo.at) div (hi.at - lo.at) + 1")
    est = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("lo").isNull(), 0).when(F.col("hi").isNull(), F.col("total")).otherwise(between)
    return around.join(F.broadcast(top), "value", "left").join(F.broadcast(total), how="cross").select("value", est.cast("long").alias("est_rows"))


def pair_estimates(df: DataFrame, a: str, b: str, wanted: DataFrame) -> DataFrame:
    """For each pair (a, b) of `wanted`: rows expected to have both; a common pair is exact, others share the rest evenly."""
    pairs, top = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("freq")), common_pairs(df, a, b)
    whole = pairs.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("ndv"))
    held = top.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("top_rows"), F.count(F.lit(1)).alias("top_n"))
    rest = F.when(F.col("ndv") > F.col("top_n"), F.ceil((F.col("total") - F.col("top_rows")) / F.nullif(F.col("ndv") - F.col("top_n"), F.lit(0)))).otherwise(0)
    out = wanted.join(F.broadcast(whole), how="cross").join(F.broadcast(held), how="cross").join(F.broadcast(top), ["a", "b"], "left")
    return out.select("a", "b", F.coalesce("freq", rest).cast("long").alias("est_rows"))
