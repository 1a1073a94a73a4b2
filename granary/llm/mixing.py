"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output over its size. Each document's number of copies
is a Poisson draw with that mean, by inversion of a number hashed from the seed and the document's key, so the draw of a
document depends on nothing else and any lost task repeats it. Copies are spread by a second hash, which also orders them.

Sizes are over all documents, whole texts in bytes. A source with no weight gets `rest`; a null source is one of its own,
named by None in `weights`. A source of size zero keeps rate zero. Null keys draw alike; equal keys draw equally, and
their copies share order keys. Weights are relative; they are a parameter, so their number is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved

#: A mean above this is drawn as a sum of that many equal parts, so that no exponential underflows.
PART = 16.0
#: Sources whose rates are broadcast: some megabytes at most.
FEW = 10_000
#: Draws end here: for a mean of at most PART, counts beyond have probability below 1e-17, less than one step of `unit`.
MOST = 80


def unit(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5; plain enough for any SQL engine to repeat."""
    return (hashed(seed, *parts, digits=13) + 0.5) / float(1 << 52)


def hashed(seed: int, *parts: Column, digits: int = 15) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def poisson(u: Column, mean: Column) -> Column:
    """The smallest count whose cumulative probability exceeds u."""

    def step(acc: Column, k: Column) -> Column:
        more = u >= acc["sum"]
        term = acc["term"] * mean / k
        return F.struct(F.when(more, term).otherwise(acc["term"]).alias("term"), F.when(more, acc["sum"] + term).otherwise(acc["sum"]).alias("sum"), (acc["n"] + more.cast("long")).alias("n"))

    p0 = F.exp(-mean)
    start = F.struct(p0.alias("term"), p0.alias("sum"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step)["n"]


def rates(df: DataFrame, weights: dict[str | None, float], source: str = "source", text: str = "text", rest: float = 0.0, total: float = 1.0) -> DataFrame:
    """(source, rate): `total` times the input's size, dealt by weight. One row for each source."""
    sizes = df.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("size"))
    weight = F.lit(float(rest))
    for name, w in weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    one = sizes.withColumn("weight", weight)
    whole = one.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * (F.col("all_size") * float(total)) / F.col("size")
    return one.join(F.broadcast(whole), how="cross").select("source", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate).otherwise(0.0).alias("rate"))


def mix(df: DataFrame, weights: dict[str | None, float], key: str = "doc_id", source: str = "source", text: str = "text", rest: float = 0.0, total: float = 1.0, seed: int = 42, copy: str = "copy_no", order: str = "mix_key") -> DataFrame:
    """`df` with each row as often as drawn, in a global random order; adds the copy's number and the order key."""
    if clash := {copy.lower(), order.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} exist")
    rate, name = fresh(df, "_rate", "_source")
    per_source = rates(df, weights, source, text, rest, total)
    # One row for each source. Few of them are broadcast, checked by count; many meet the rows by a shuffle.
    per_source = saved(per_source.select(F.col("source").alias(name), F.col("rate").alias(rate)))
    small = per_source.limit(FEW + 1).count() <= FEW
    rated = df.join(F.broadcast(per_source) if small else per_source, F.col(f"`{source}`").eqNullSafe(F.col(name)), "left").drop(name).withColumn(rate, F.coalesce(rate, F.lit(0.0)))
    parts = F.greatest(F.lit(1), F.ceil(F.col(rate) / PART)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), parts), lambda i: poisson(unit(seed, F.col(key), i), F.col(rate) / parts))
    n = F.aggregate(draws, F.lit(0).cast("long"), lambda a, x: a + x)
    copies = rated.withColumn(rate, n).filter(F.col(rate) > 0).select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(rate))).alias(copy))
    keyed = copies.withColumn(order, hashed(seed + 1, F.col(key), F.col(copy)))
    # The key is uniform, so dealing by its hash and sorting within is a global shuffle without a sampling pass.
    return keyed.repartition(order).sortWithinPartitions(order, key)


def sql(weights: dict[str | None, float], columns: str, rest: float = 0.0, seed: int = 42) -> str:
    """The same rows in DuckDB's SQL, for means of up to PART."""
    cases = " ".join(f"WHEN source = '{s}' THEN {float(w)!r}" for s, w in weights.items())
    return f"""
WITH RECURSIVE sizes AS (SELECT source, sum(strlen(text)) AS size, CASE {cases} ELSE {float(rest)!r} END AS weight FROM documents GROUP BY source),
rates AS (SELECT source, weight / sum(weight) OVER () * CAST(sum(size) OVER () AS DOUBLE) / CAST(size AS DOUBLE) AS rate FROM sizes),
cdf(source, rate, k, term, total) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM cdf WHERE k < {MOST}),
draws AS (SELECT doc_id, source, (CAST('0x' || substr(md5('{seed}:' || doc_id || ':1'), 1, 13) AS BIGINT) + 0.5) / {1 << 52}::DOUBLE AS u FROM documents),
counts AS (SELECT d.doc_id, count(c.k) AS n FROM draws d LEFT JOIN cdf c ON c.source = d.source AND c.k < {MOST} AND d.u >= c.total GROUP BY d.doc_id),
copies AS (SELECT doc_id, unnest(range(1, n + 1)) AS copy_no FROM counts)
SELECT {columns}, copy_no, CAST('0x' || substr(md5('{seed + 1}:' || d.doc_id || ':' || copy_no), 1, 15) AS BIGINT) AS mix_key
FROM copies JOIN documents d ON d.doc_id = copies.doc_id"""
