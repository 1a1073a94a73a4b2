"""Helpers that the operators share: unused column names, work tables in the shared folder, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` doesn't have, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors have to see.

    Where that is unset, a session on one machine uses its warehouse folder, and one on a cluster is refused.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


_written: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: a cut of the lineage that outlives lost executors."""
    path = shared_dir(df.sparkSession)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_saved(df: DataFrame) -> None:
    """Delete the files behind a frame that `saved` gave and nothing reads any more."""
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, parent)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what `saved` wrote within, but for a table that the function given has written."""
    before, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        out = saved(df)
        kept.add(_written[-1])
        return out

    try:
        yield keep
    finally:
        for path in _written[before:]:
            if path not in kept:
                delete(spark, path)
        _written[before:] = [p for p in _written[before:] if p in kept]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each of n nodes' smallest reachable node over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge.

    Alternating large-star and small-star steps: each is one aggregation for the smallest neighbour and one join, the
    number of edges never grows, and the rounds grow with the logarithm of the longest path. A node with very many
    neighbours costs rows, not one task's memory: no neighbour list is ever gathered.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, mark = saved(pairs), None
    while True:
        # Large-star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small-star: every smaller-or-equal neighbour of u, and u itself, is tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = saved(small)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_saved(now)
        now = after
        if seen == mark:
            break
        mark = seen
    # All edges now lead from a node to its component's smallest node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
