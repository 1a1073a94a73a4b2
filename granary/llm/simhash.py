"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where over half of the hashes of the text's word shingles have it. Fingerprints within
`radius` bits link. Each fingerprint is cut into segments; two fingerprints within the radius differ in at most
radius // segments bits of some segment, so a table of exact segment values is met by small Hamming balls around every
value, and full distances are verified. Equal fingerprints are one class from the start, so copies never meet in pairs.

Null and empty texts have the fingerprint zero and link like any other. Case folds for A-Z only. Texts are whole, in
bytes, of any length. Every row gives a row, also where ids repeat; a null id names no component, and rows that have one
are linked through but never named by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, saved

SEED, CHUNK = 42, 1 << 14
BITS = np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and just the six ASCII blanks
    if not w:
        return 0
    n, counts = max(1, len(w) - words + 1), np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(at, min(n, at + CHUNK))], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * c > n else "0" for c in counts), 2)


def fingerprint_of(text: Column, words: int) -> Column:
    """The fingerprint as a signed long of the same 64 bits."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64))

    return run(text.cast("string"))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp) of every row."""
    return df.select(F.col(f"`{key}`").alias("key"), fingerprint_of(F.col(f"`{text}`"), words).alias("fp"))


def ball(bits: int, radius: int) -> list[int]:
    """The masks of at most `radius` of `bits` bits; radius // segments keeps this small."""
    out = level = [0]
    for _ in range(radius):
        level = sorted({m | 1 << i for m in level for i in range(bits)} - {*out})
        out = out + level
    return out


def segment(fp: Column, i: int, segments: int) -> Column:
    lo, hi = 64 * i // segments, 64 * (i + 1) // segments
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def links(fps: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """(a, b): all pairs a < b of the distinct `fp` that differ in 1 to `radius` bits."""
    near = radius // segments
    sides = [(i, ball(64 * (i + 1) // segments - 64 * i // segments, near)) for i in range(segments)]
    keyed = lambda masks: F.array(*[F.struct(F.lit(i).alias("i"), segment(F.col("fp"), i, segments).bitwiseXOR(F.lit(m)).alias("v")) for i, ms in sides for m in masks(ms)])
    table = fps.select(F.explode(keyed(lambda _: [0])).alias("k"), F.col("fp").alias("b"))
    probes = fps.select(F.explode(keyed(lambda ms: ms)).alias("k"), F.col("fp").alias("a"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return probes.join(table, "k").filter((F.col("a") < F.col("b")) & (differ <= radius)).select("a", "b").distinct()


def grouped(df: DataFrame, key: str, text: str, words: int, radius: int) -> DataFrame:
    """(key, fp, component_id) of every row."""
    docs = saved(fingerprints(df, key, text, words))
    classes = saved(docs.groupBy("fp").agg(F.min("key").alias("rep")))
    joined = components(links(classes.select("fp"), radius))
    # The component of a fingerprint is named by a fingerprint; its smallest document is an aggregate over the classes.
    group = F.coalesce("component", "fp")
    named = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "rep", group.alias("group"))
    least = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    return docs.join(named.join(least, "group").select("fp", "component_id"), "fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(key, fingerprint, component_id): 16 hex digits, and the smallest key reachable over links, its own included."""
    found = grouped(df, key, text, words, radius)
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """`df` without the rows that aren't the smallest of their component; rows with a null key all stay.

    Rows with one key are told apart by their fingerprints, so a text that is alone stays whatever else has its key.
    """
    name, other, mark = fresh(df, "_fp", "_dropped", "_mark")
    dropped = grouped(df, key, text, words, radius).filter(F.col("key") != F.col("component_id")).select(F.col("key").alias(other), F.col("fp").alias(mark)).distinct()
    marked = df.withColumn(name, fingerprint_of(F.col(f"`{text}`"), words))
    return marked.join(dropped, (marked[key] == dropped[other]) & (marked[name] == dropped[mark]), "left_anti").drop(name)
