"""The bounded sample of labelled documents that a classifier is fitted on, and the held-out fold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """One fifth of the documents, by the CRC-32 of the id as text; null ids are held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most `per_class` whole texts of either label that aren't held out, in an order hashed from the id.

    The bound on rows is a parameter of the fit alone: scoring takes every document. Of several texts with one id the least
    one stands for it, and an id with both labels counts for both.
    """
    known = labels.filter(~held_out(F.col(key)) & F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).distinct()
    order = [F.xxhash64("_key"), F.col("_key")]
    picked = [known.filter(F.col("_label") == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    ids = picked[0].union(picked[1])
    # At most 2 * per_class ids.
    joined = docs.select(F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")).join(F.broadcast(ids), F.col("_id") == F.col("_key"))
    rows = joined.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    return [(r._text, r._label) for r in sorted(rows, key=lambda r: (str(r._id), r._label))]


def with_score(df: DataFrame, model: object, text: str, out: str) -> DataFrame:
    """`df` with `model.score` of each whole text; only the texts travel to Python and only scores come back."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists")
    held = df.sparkSession.sparkContext.broadcast(model)  # of a size fixed by the model's parameters

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([held.value.score(t.as_py()) for t in texts], pa.float64())

    return df.withColumn(out, score(F.col(f"`{text}`")))
