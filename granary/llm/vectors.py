"""Embedding columns as rows of bytes, and splitting groups that hold too many rows for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups on which a count-checked broadcast is still small: keys and counts of this many.
FEW = 100_000


def usable(column: str) -> F.Column:  # type: ignore[name-defined]
    """Not null, not empty, without null or non-finite components, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.coalesce((F.size(column) > 0) & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a float64 matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def chunked(df: DataFrame, keys: list[str], most: int, *salt: str) -> DataFrame:
    """`df` with n_chunks per group of `keys` (1 unless it has over `most` rows) and a chunk number hashed from `salt`."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > most)
    large = large.select(*keys, F.ceil(F.col("n_rows") / most).cast("int").alias("n_chunks"))
    small_side = large.limit(FEW + 1).count() <= FEW
    out = df.join(F.broadcast(large) if small_side else large, keys, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1)))
    return out.withColumn("chunk", F.pmod(F.xxhash64(*salt), F.col("n_chunks")).cast("int"))


def in_blocks(df: DataFrame) -> DataFrame:
    """Rows with `chunk` of `n_chunks` dealt to blocks (x, y) of two chunks of their group, each two of which meet once.

    In a block of one chunk (x = y) all rows have `side` 2; else those of x have 0 and those of y 1.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))
    side = F.when(F.col("chunk") == F.col("_other"), 2).when(F.col("chunk") < F.col("_other"), 0).otherwise(1)
    met = df.withColumn("_other", other).withColumns({"x": F.least("chunk", "_other"), "y": F.greatest("chunk", "_other"), "side": side})
    return met.drop("_other", "chunk", "n_chunks")


def by_rows(df: DataFrame, schema: str, make: object, rows: int = 512) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows; `make` gets a RecordBatch and gives a list of Arrow columns."""
    names = [p.strip().split(" ")[0].strip("`") for p in schema.split(",")] if "<" not in schema else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                out = make(whole.slice(k, rows))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out)) if isinstance(out, dict) else pa.RecordBatch.from_arrays(out, names=names)

    return df.mapInArrow(run, schema)
